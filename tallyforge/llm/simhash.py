"""SimHash fingerprints and searches over permuted block tables, in DataFrame operations only.

A text's terms are its pairs of neighbouring words (a text of one word has that word); a term is hashed to 128 bits, and each of its occurrences votes on every bit with the term's weight, which grows with its length. Votes are counted 64 lanes at a time: two bits of a hash ride in one 64-bit sum, 32 bits each, so a text would need a thousand million terms to overflow. A bit is set if more than half of the weight votes for it.

Searches split fingerprints into blocks. Two fingerprints within Hamming radius r differ in at most r blocks, so with b blocks they agree in some choice of b - r; a table for each such choice holds every fingerprint under those blocks, permuted to the front, and an equi-join on them finds all candidates, which are verified. A pair is taken only from the first table in which it agrees. Equal fingerprints are joined once, with their number.

Defined cases: a null or empty text has no terms and the fingerprint 0, likeness of two such is 1; whole texts are used; rows that tie in doc_id follow each other in the order of their text's hash, and a null doc_id comes first; the document after the last is the first, of a single document itself; an empty table gives an empty result; other columns are ignored. In searches, rows with a null half of a fingerprint find nothing and aren't found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAST_ID = -(1 << 63)
HALF = 32
LANES = 0x0000000100000001
BITS = 128
SEEDS = ("first", "second")


SPACE = r"[\s]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda x: x != "")


def pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))


def hashed(terms: Column, zone: Callable[[Column], Column]) -> Column:
    """array of struct(zone, a, b, w): two hashes and the weight of each term, and the zone of its place (from 0)."""
    return F.transform(terms, lambda t, k: F.struct(zone(k).cast("int").alias("zone"), F.xxhash64(F.lit(SEEDS[0]), t).alias("a"), F.xxhash64(F.lit(SEEDS[1]), t).alias("b"), (1 + F.least(F.length(t), F.lit(24)) / 8).cast("long").alias("w")))


def votes() -> list[Column]:
    """Sums over rows (a, b, w) of one text's terms."""
    out = [F.sum("w").alias("w")]
    for h in ("a", "b"):
        out += [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}{k}") for k in range(HALF)]
    return out


def half(votes: Column, first: int) -> Column:
    """64 bits of a fingerprint from the votes (array of the weight and then the lanes), whose lanes begin at place `first`."""
    total = F.element_at(votes, 1)
    bits = []
    for k in range(HALF):
        x = F.element_at(votes, first + k)
        bits += [F.when(x.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total, F.lit(1 << k)).otherwise(F.lit(0)), F.when(F.shiftrightunsigned(x, 32) * 2 > total, F.lit(1 << (k + 32) if k < 31 else -(1 << 63))).otherwise(F.lit(0))]
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2])]
    return bits[0]


def halves(votes: Column) -> tuple[Column, Column]:
    return half(votes, 2), half(votes, 2 + HALF)


def shown(f1: Column | str, f2: Column | str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return 1 - distance(a, b) / BITS


def in_order(docs: DataFrame, text: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, text, n_chars, next_text (that of the document after it, by ascending doc_id), before_chars (the length of the one before it in the part), own (false for a copy of the first row of the part that follows), part and pos.

    Rows are dealt once, by ranges of doc_id, and by ranges of the text's hash where many rows share a doc_id; a part also gets a copy of the row that follows its last one, so that nothing is sorted as a whole. The driver holds some numbers for each part.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(body).alias("h"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = Counter(keys.select(F.percentile_approx("id", shares, 100 * parts)).head()[0] or [])
    bounds, heavy = sorted(found), [k for k, n in found.items() if n > 1]
    inner = {}
    if heavy:  # at most as many as there are parts
        cut = keys.where(F.col("id").isin(heavy)).groupBy("id").agg(F.percentile_approx("h", shares, 100 * parts)).collect()
        inner = {k: sorted(set(hs[:: max(1, parts // (found[k] + 1))])) for k, hs in cut}
    most = max(map(len, inner.values()), default=-1) + 2
    upto = lambda array, c: F.size(F.filter(array, lambda b: b <= c))
    part = upto(F.lit(bounds).cast("array<bigint>"), F.col("id")) * most
    if inner:
        of_id = F.create_map(*[x for k, hs in inner.items() for x in (F.lit(k).cast("long"), F.lit(hs).cast("array<bigint>"))])
        # a heavy id opens its range: what follows it there comes after all its hashes
        part = part + F.when(F.col("id").isin(heavy), upto(F.try_element_at(of_id, F.col("id")), F.col("h"))).otherwise(F.lit(most - 1))
    starts = dict(keys.groupBy(part.alias("part")).agg(F.min(F.struct("id", "h")).alias("start")).collect())  # a row for each part
    there = sorted(starts)
    before = {p: q for p, q in zip(there, [there[-1], *there] if there else [])}
    every = range((len(bounds) + 1) * most)
    at = lambda values, kind: F.element_at(F.lit([values(p) for p in every]).cast(f"array<{kind}>"), F.col("home") + 1)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), "doc_id", body.alias("text"), F.xxhash64(body).alias("h")).withColumn("home", part)
    first = (at(lambda p: starts[p][0] if p in starts else None, "bigint") == F.col("id")) & (at(lambda p: starts[p][1] if p in starts else None, "bigint") == F.col("h"))
    own = F.struct(F.col("home").alias("part"), F.lit(0).alias("copy"))
    ahead = F.struct(at(before.get, "int").alias("part"), F.when(F.col("home") == (there[0] if there else 0), F.lit(2)).otherwise(F.lit(1)).alias("copy"))
    dealt = rows.select("doc_id", "id", "h", "text", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))).alias("g")).select("doc_id", "id", "h", "text", "g.part", "g.copy")
    w = W.partitionBy("part").orderBy("copy", "id", "h")
    dealt = dealt.withColumn("n_chars", F.length("text").cast("long"))
    return dealt.select("doc_id", "text", "n_chars", "part", (F.col("copy") == 0).alias("own"), F.row_number().over(w).alias("pos"), F.lead("text").over(w).alias("next_text"), F.lag("n_chars").over(w).alias("before_chars"))


def edited(text: str = "text", following: str = "next_text") -> Column:
    """text with its last floor(n / 2) code points replaced by as many of the following text's first."""
    n = F.length(text)
    h = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - h), F.substring(F.coalesce(F.col(following), F.lit("")), F.lit(1), h))


def fingerprint_documents(docs: DataFrame, text: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, (f1, f2) of the text, (e1, e2) of the edited text, (g1, g2) of the next document's text, all in one shuffle.

    An edited text is a prefix of the text and one of the next text, so its terms are those of the two texts but for some at the seam. Every term becomes a row once, in a zone that says in which of the two prefixes of its text it lies (one for the own edited text: 1, one for that of the document before: 2, both: 3, none: 0; zone 4: the terms at the own seam), votes are summed by zone, and the three fingerprints are made of sums of zones.
    """
    ends_open = lambda c: ~c.rlike(r"\s\z") & (c != "")
    prefix = lambda c, n: F.substring(c, F.lit(1), n.cast("int"))
    # words of a prefix that its cut leaves whole: the last one may go on behind it
    cut = lambda c, n: ends_open(prefix(c, n)) & (F.length(c) > n) & ~F.substring(c, (n + 1).cast("int"), F.lit(1)).rlike(r"\s")
    rows = in_order(docs, text, parts).withColumn("h", F.floor(F.col("n_chars") / 2)).withColumn("edited", F.when(F.col("own"), edited()))
    rows = rows.withColumn("head", prefix(F.col("text"), F.col("n_chars") - F.col("h"))).withColumn("tail", F.when(F.col("own"), prefix(F.coalesce("next_text", F.lit("")), F.col("h"))).otherwise(""))
    lent = F.least(F.floor(F.coalesce("before_chars", F.lit(0)) / 2), F.col("n_chars"))
    rows = rows.withColumn("lent", lent).withColumn("ws", words_of(F.col("text"))).withColumn("hs", words_of(F.col("head"))).withColumn("ts", words_of(F.col("tail")))
    kept = F.size("hs") - ends_open(F.col("head")).cast("int")  # words of the head with white space behind them
    given = F.size(words_of(prefix(F.col("text"), F.col("lent")))) - cut(F.col("text"), F.col("lent")).cast("int")
    taken = F.size("ts") - (F.col("own") & cut(F.coalesce("next_text", F.lit("")), F.col("h"))).cast("int")
    rows = rows.select("part", "pos", "doc_id", "own", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), "ws", "ts", (ends_open(F.col("head")) & (F.size("ts") > 0) & ~F.col("tail").rlike(r"\A\s")).alias("joined"), kept.alias("kept"), given.alias("given"), taken.alias("taken"), "hs")
    # the words around the seam: the last whole one of the head, what follows it, and the first two of the tail
    last = F.slice("hs", F.greatest(F.col("kept"), F.lit(1)), F.lit(2))
    near = F.when(F.col("joined"), F.concat(F.slice(last, F.lit(1), F.size(last) - 1), F.array(F.concat(F.try_element_at(last, F.lit(-1)), F.try_element_at("ts", F.lit(1)))), F.slice("ts", 2, 1))).otherwise(F.concat(last, F.slice("ts", 1, 2)))
    far = F.slice("ts", F.greatest(F.col("taken"), F.lit(2)), F.size("ts") + 1)
    alone = F.size("hs") + F.size("ts") - F.col("joined").cast("int") < 2
    seam = F.when(F.col("own"), F.when(alone, F.col("near")).otherwise(F.concat(pairs(F.col("near")), pairs(far)))).otherwise(F.array().cast("array<string>"))
    zone = lambda k: (k < F.col("kept") - 1).cast("int") + 2 * ((k >= 1) & (k < F.col("given") - 1)).cast("int")
    rows = rows.withColumn("near", near).withColumn("seam", seam).withColumn("terms", F.when(F.size("ws") < 2, F.col("ws")).otherwise(pairs(F.col("ws"))))
    keys = ["part", "pos", "doc_id", "own", "n_chars", "sha"]
    each = rows.select(*keys, F.explode_outer(F.concat(hashed(F.col("terms"), zone), hashed(F.col("seam"), lambda k: F.lit(4)))).alias("t"))
    sums = each.select(*keys, F.col("t.zone").alias("zone"), F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.w").alias("w")).groupBy(*keys, "zone").agg(*votes())
    lanes = F.array("w", *[f"{h}{k}" for h in ("a", "b") for k in range(HALF)])
    docs_ = sums.groupBy(*keys).agg(F.collect_list(F.when(F.col("zone").isNotNull(), F.struct("zone", lanes.alias("v")))).alias("zones"))  # five at most
    none = F.array_repeat(F.lit(0).cast("long"), 1 + 2 * HALF)
    added = lambda x, y: F.zip_with(x, y, lambda i, j: i + j)
    of = lambda *chosen: F.aggregate(F.filter("zones", lambda z: z["zone"].isin(*chosen)), none, lambda acc, z: added(acc, z["v"]))
    docs_ = docs_.select(*keys, of(0, 1, 2, 3).alias("whole"), of(1, 3, 4).alias("mine"), of(2, 3).alias("lent"))
    f1, f2 = halves(F.col("whole"))
    docs_ = docs_.select(*keys, f1.alias("f1"), f2.alias("f2"), "mine", "lent")
    w = W.partitionBy("part").orderBy("pos")
    out = docs_.withColumn("g1", F.lead("f1").over(w)).withColumn("g2", F.lead("f2").over(w)).withColumn("both", added(F.col("mine"), F.lead("lent").over(w))).where("own")
    e1, e2 = halves(F.col("both"))
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "f1", "f2", e1.alias("e1"), e2.alias("e2"), "g1", "g2")


def tables(radius: int, blocks: int | None = None) -> list[tuple[int, int]]:
    """The masks (of the two halves, as signed longs) of each block table."""
    blocks = blocks or radius + 2
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        bits = sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in chosen)
        out.append((signed(bits & ((1 << 64) - 1)), signed(bits >> 64)))
    return out


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs of distinct fingerprints (f1, f2 of queries; g1, g2 of prints) at most radius bits apart, with their distance and n, the rows of prints that have the found one."""
    masks = tables(radius, blocks)
    keys = lambda x, y: F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(x).bitwiseAND(F.lit(m1)).alias("k1"), F.col(y).bitwiseAND(F.lit(m2)).alias("k2")) for t, (m1, m2) in enumerate(masks)])).alias("k")
    q = queries.select("f1", "f2").distinct().select("f1", "f2", keys("f1", "f2")).select("f1", "f2", "k.*")
    p = prints.groupBy(F.col("f1").alias("g1"), F.col("f2").alias("g2")).agg(F.count(F.lit(1)).alias("n")).select("g1", "g2", "n", keys("g1", "g2")).select("g1", "g2", "n", "k.*")
    d = distance(("f1", "f2"), ("g1", "g2"))
    agree = F.lit(len(masks))
    for t, (m1, m2) in reversed(list(enumerate(masks))):
        agree = F.when((F.col("f1").bitwiseXOR(F.col("g1")).bitwiseAND(F.lit(m1)) == 0) & (F.col("f2").bitwiseXOR(F.col("g2")).bitwiseAND(F.lit(m2)) == 0), F.lit(t)).otherwise(agree)
    return q.join(p, ["t", "k1", "k2"]).where((d <= radius) & (agree == F.col("t"))).select("f1", "f2", "g1", "g2", d.alias("distance"), "n")


def count_near(prints: DataFrame, asked: Column, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """prints with n_near: for rows that are asked for, the number of other rows whose fingerprints (f1, f2) are at most radius bits away; null for others. Found through the block tables, equal fingerprints as one."""
    near = within_radius(prints.where(asked), prints, radius, blocks).groupBy(F.col("f1").alias("_tf_f1"), F.col("f2").alias("_tf_f2")).agg((F.sum("n") - 1).alias("n_near"))
    columns = [c for c in prints.columns if c != "n_near"]
    joined = prints.select(*columns).join(near, (F.col("f1") == F.col("_tf_f1")) & (F.col("f2") == F.col("_tf_f2")), "left")
    return joined.select(*columns, F.when(asked, F.coalesce("n_near", F.lit(0))).alias("n_near"))
