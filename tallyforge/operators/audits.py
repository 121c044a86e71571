"""Audits of tables: profiles, counts, exact quantiles, duplicates, similar pairs, overlaps, probes of tasks and prompts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text
from ..sources.staging import staging_dir

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts, most frequent first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def crosstab(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def quantile_summary(df: DataFrame, value: str, *keys: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """n, min, quantiles, max and mean of each group. A quantile is the value at index round(p * (n - 1)), halves to the even index, of the sorted values.

    Distinct values are counted first (with map-side combining) and only their running counts are windowed, so a group with many rows and few values is small.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_tf_v")).agg(F.count(F.lit(1)).alias("_tf_c"))
    if not keys:
        return _whole_quantiles(rows, at)
    upto = F.sum("_tf_c").over(W.partitionBy(*keys).orderBy("_tf_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("_tf_c").over(W.partitionBy(*keys))
    ranked = rows.withColumn("_tf_to", upto).withColumn("_tf_n", total)
    index = lambda p: F.bround(F.lit(p) * (F.col("_tf_n") - 1))
    pick = lambda p: F.min(F.when(F.col("_tf_to") > index(p), F.col("_tf_v"))).alias(f"p{round(100 * p)}")
    return ranked.groupBy(*keys).agg(F.sum("_tf_c").alias("n"), F.min("_tf_v").alias("min"), *map(pick, at), F.max("_tf_v").alias("max"), (F.sum(F.col("_tf_v") * F.col("_tf_c")) / F.sum("_tf_c")).alias("mean"))


def _whole_quantiles(counted: DataFrame, at: tuple[float, ...], parts: int = 200) -> DataFrame:
    """The same for a whole table, from its distinct values (_tf_v) and their counts (_tf_c). Values are dealt by ranges, the counts of the ranges (a number each, on the driver) say in which range a quantile lies, and running counts are made within ranges alone."""
    cuts = sorted(set(counted.select(F.percentile_approx("_tf_v", [k / parts for k in range(1, parts)])).head()[0] or []))
    part = F.size(F.filter(F.lit(cuts or [0]).cast("array<double>"), lambda c: c < F.col("_tf_v"))) if cuts else F.lit(0)
    dealt = counted.withColumn("_tf_p", part)
    sizes = dict(dealt.groupBy("_tf_p").agg(F.sum("_tf_c")).collect())
    before, n = {}, 0
    for p in sorted(sizes):
        before[p], n = n, n + sizes[p]
    start = F.element_at(F.lit([before.get(p, 0) for p in range(len(cuts) + 1)]).cast("array<bigint>"), F.col("_tf_p") + 1)
    upto = start + F.sum("_tf_c").over(W.partitionBy("_tf_p").orderBy("_tf_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    pick = lambda p: F.min(F.when(F.col("_tf_to") > F.bround(F.lit(p) * (n - 1)), F.col("_tf_v"))).alias(f"p{round(100 * p)}")
    ranked = dealt.withColumn("_tf_to", upto)
    return ranked.agg(F.sum("_tf_c").alias("n"), F.min("_tf_v").alias("min"), *map(pick, at), F.max("_tf_v").alias("max"), (F.sum(F.col("_tf_v") * F.col("_tf_c")) / F.sum("_tf_c")).alias("mean"))


def field_profile(df: DataFrame) -> DataFrame:
    """field, type, and the percentages of rows that are not null and not empty, in one pass."""
    def filled(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        return (c != "") if kind == "string" else (F.size(c) > 0) if kind in ("array", "map") else c.isNotNull()

    n = len(df.schema.fields)
    share = lambda c: F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)
    one = df.agg(*[share(F.col(f"`{f.name}`").isNotNull()).alias(f"a{k}") for k, f in enumerate(df.schema.fields)], *[share(filled(f)).alias(f"b{k}") for k, f in enumerate(df.schema.fields)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"a{k}").alias("pct_non_null"), F.col(f"b{k}").alias("pct_non_empty")) for k, f in enumerate(df.schema.fields)])
    return one.select(F.explode(rows).alias("r")).select("r.*").limit(n)


def duplicate_groups(df: DataFrame, *keys: str, item: str | None = None) -> DataFrame:
    """Groups of more than one row, with their size. With item: a row for each distinct item of such a group, beside the group's size and least item; no list grows with a group. Null keys are keys like others."""
    if item is None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = df.groupBy(*[F.col(k).alias(f"_tf_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first_item")).where("n > 1")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_tf_{k}"))
    return df.select(*keys, item).distinct().join(groups, same).select(*keys, item, "n", "first_item")


def duplicate_detail(df: DataFrame, key: str, *details: str) -> DataFrame:
    """For each group of more than one row, whether all its rows agree in each detail."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[(F.count_distinct(d) <= 1).alias(f"same_{d}") for d in details]).where("n > 1")


#: Buckets of hashes by whose sizes shingles are ordered, and candidate pairs up to which their items are broadcast.
BUCKETS, MOST_PAIRS = 1 << 16, 500_000


def staged(df: DataFrame, name: str) -> DataFrame:
    path = staging_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_sizes(sets: DataFrame) -> np.ndarray:
    """How many hashes of column s fall into each of BUCKETS buckets; a task gives one count for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for x in batches:
            total += np.bincount(x.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], names=["b", "c"])

    sizes = np.zeros(BUCKETS, np.int64)
    for b, c in sets.select("s").mapInArrow(count, "b int, c long").groupBy("b").agg(F.sum("c")).collect():
        sizes[b] = c
    return sizes


def shingle_heads(sets: DataFrame, threshold: float) -> DataFrame:
    """g, i, h, n and p of sets (g, i, s): the digest and the size of the set, and as many of its hashes as two sets of that similarity must meet in, those of the smallest buckets first. The order is one for all sets, so that no pair is lost however well a bucket tells what is rare."""
    sizes = bucket_sizes(sets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            column = x.column("s")
            values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
            digests, counts, heads = [], [], []
            for s in np.split(values, ends[:-1]) if len(ends) else []:
                s = np.sort(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                counts.append(len(s))
                heads.append(s[np.argsort(sizes[s & (BUCKETS - 1)], kind="stable")][: len(s) - math.ceil(len(s) * threshold - 1e-9) + 1])
            ends = np.cumsum([0, *map(len, heads)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([x.column("g"), x.column("i"), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), lists], names=["g", "i", "h", "n", "p"])

    kinds = dict(sets.dtypes)
    return sets.mapInArrow(cut, f"g {kinds['g']}, i {kinds['i']}, h binary, n int, p array<long>")


def similar_pairs(df: DataFrame, group: str, item: str, body: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """group, a, b, similarity: pairs of items of one group whose shingle sets have a similarity of threshold or more, exactly. Items with equal sets are one, by their least: a row of them is that least one, the other, and 1.0, so that copies give as many rows as there are, not their pairs.

    A similar pair shares one of the rarest few shingles of both (prefix filtering), so candidates meet in those, where what is left of both can still make them similar; no pair is formed that shares none. Only those few shingles are staged and dealt out, and only the sets of candidates are joined; sets are hashed again for each pass, as all of them would be twice the input.
    """
    texts = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.coalesce(F.col(body), F.lit("")).alias("t"))
    hashed = lambda rows: rows.select("g", "i", text.shingle_hashes(F.col("t"), n).alias("s"))
    rows = staged(shingle_heads(hashed(texts), threshold), "shingle_heads")
    nodes = rows.groupBy("g", "h").agg(F.min("i").alias("i"), F.first("n").alias("n"), F.first("p").alias("p"))  # equal sets have equal heads
    heads = nodes.select("g", "i", "n", F.posexplode("p").alias("at", "x")).select(F.xxhash64("g", "x").alias("k"), "g", "i", "n", "at")
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))  # what the two can share from here on
    meet = (F.col("a.k") == F.col("b.k")) & F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.i") < F.col("b.i")) & (left >= threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-6)
    pairs = staged(heads.alias("a").join(heads.alias("b"), meet).select(F.col("a.g").alias("g"), F.col("a.i").alias("a"), F.col("b.i").alias("b")).distinct(), "candidates")
    small = F.broadcast if pairs.count() <= MOST_PAIRS else lambda x: x
    ids = pairs.select(F.col("g").alias("ig"), F.explode(F.array("a", "b")).alias("ii")).distinct()
    met = hashed(texts.join(small(ids), F.col("g").eqNullSafe(F.col("ig")) & (F.col("i") == F.col("ii")), "left_semi"))
    side = lambda c: met.select(F.col("g").alias(f"g{c}"), F.col("i").alias(f"i{c}"), F.col("s").alias(f"s{c}"))
    at = lambda c: F.col("g").eqNullSafe(F.col(f"g{c}")) & (F.col(c) == F.col(f"i{c}"))
    out = pairs.join(side("a"), at("a")).join(side("b"), at("b"))
    out = out.withColumn("similarity", text.jaccard(F.col("sa"), F.col("sb"))).where(F.col("similarity") >= threshold).select("g", "a", "b", "similarity")
    reps = rows.groupBy(F.col("g").alias("rg"), F.col("h").alias("rh")).agg(F.min("i").alias("rep"))
    copies = rows.select("g", "i", "h").join(reps, F.col("g").eqNullSafe(F.col("rg")) & (F.col("h") == F.col("rh"))).where("i <> rep")
    same = copies.select("g", F.col("rep").alias("a"), F.col("i").alias("b"), F.lit(1.0).alias("similarity"))
    return out.unionByName(same).withColumnRenamed("g", group)


def close_texts(pairs: DataFrame, a: str, b: str, threshold: float = 0.9) -> DataFrame:
    """pairs with ratio, the similarity of two text columns by matching blocks, where it is over the threshold. A null text counts as empty.

    A cascade: lengths rule out pairs in the JVM, then letters, whose work grows with the lengths alone, and only those that both bounds leave go to the exact ratio.
    """
    left, right = (F.coalesce(F.col(c), F.lit("")) for c in (a, b))
    possible = pairs.where(text.length_bound(left, right) > threshold).where(text.letter_bound(left, right) > threshold)
    return possible.withColumn("ratio", text.sequence_ratio(left, right)).where(F.col("ratio") > threshold)


def close_pairs(df: DataFrame, group: str, item: str, body: str, candidate: float = 0.5, threshold: float = 0.9, n: int = 5) -> DataFrame:
    """group, a, b, ratio: pairs of items of one group that share at least `candidate` of their shingles and whose texts are close (close_texts()). Items with the same shingles are paired with the least of them only."""
    pairs = similar_pairs(df, group, item, body, candidate, n)
    side = lambda c, k: df.select(F.col(item).alias(c), F.col(body).alias(k))
    return close_texts(pairs.join(side("a", "_tf_x"), "a").join(side("b", "_tf_y"), "b"), "_tf_x", "_tf_y", threshold).select(group, "a", "b", "ratio")


def top_pairs(pairs: DataFrame, k: int = 25) -> DataFrame:
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(k)


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of left, those with a partner in right, and of these how many differ in each column (nulls are equal)."""
    r = right.select(key, *[F.col(c).alias(f"_tf_{c}") for c in columns], F.lit(True).alias("_tf_there"))
    joined = left.select(key, *columns).join(r, key, "left")
    there = F.col("_tf_there").isNotNull()
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(there, 1)).alias("n_matched"), *[F.count(F.when(there & ~F.col(c).eqNullSafe(F.col(f"_tf_{c}")), 1)).alias(f"differs_{c}") for c in columns])


def missing_from(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the index in none of rows."""
    return index.join(rows.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both."""
    return a.select(key).intersect(b.select(key))


def shared_texts(a: DataFrame, b: DataFrame, body: str) -> DataFrame:
    """Rows of a whose text, white space aside, is in b."""
    return a.join(b.select(text.sha16(text.squashed(F.col(body))).alias("_tf_h")).distinct(), text.sha16(text.squashed(a[body])) == F.col("_tf_h"), "left_semi")


# ---- probes of tasks and prompts


def test_count_check(tasks: DataFrame) -> DataFrame:
    """By harness and agreement: whether n_tests is the number of test functions (pytest) or of tests. Columns: harness, n_tests, tests (array of struct with assertion)."""
    functions = F.aggregate("tests", F.lit(0), lambda acc, t: acc + F.regexp_count(F.coalesce(t["assertion"], F.lit("")), F.lit(r"(?m)^\s*def test_")))
    counted = F.when(F.col("harness") == "pytest", functions).otherwise(F.size("tests"))
    return crosstab(tasks.select("harness", (F.col("n_tests") == counted).alias("agrees")), "harness", "agrees")


def gold_test_gate(tasks: DataFrame) -> DataFrame:
    """By repo and kind: reference patches that touch a file that test ids name, one that looks like a test, or neither. Columns: repo, gold_patch, test_ids."""
    from ..functions.patches import TEST_PATH

    paths = F.array_distinct(F.regexp_extract_all("gold_patch", F.lit(r"(?m)^\+\+\+ b/(\S+)"), F.lit(1)))
    files = F.transform("test_ids", lambda t: F.substring_index(t, "::", 1))
    kind = F.when(F.arrays_overlap(paths, files), "named_test_file").when(F.exists(paths, lambda p: p.rlike(TEST_PATH)), "test_like_path").otherwise("clean")
    return crosstab(tasks.select("repo", kind.alias("kind")), "repo", "kind")


def odd_test_files(tasks: DataFrame) -> DataFrame:
    """By repo: test ids whose file doesn't look like a test."""
    from ..functions.patches import TEST_PATH

    files = tasks.select("repo", F.explode("test_ids").alias("t")).withColumn("f", F.substring_index("t", "::", 1))
    return files.where(~F.col("f").rlike(TEST_PATH)).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def rubric_tags(tasks: DataFrame, *tags: str) -> DataFrame:
    """Criteria by the values of their tags."""
    each = tasks.select(F.explode("rubrics").alias("c"))
    return crosstab(each.select(*[F.col("c.tags")[t].alias(t) for t in tags]), *tags)


def rubric_sequences(tasks: DataFrame, tag: str) -> DataFrame:
    """How often each sequence of a tag's values occurs as a rubric."""
    return value_counts(tasks.select(F.array_join(F.transform("rubrics", lambda c: F.coalesce(c["tags"][tag], F.lit("-"))), ",").alias("sequence")), "sequence")


def prompt_versus_statement(rows: DataFrame) -> DataFrame:
    """By agreement of prompt and statement (equal, equal but for outer white space, different) and whether the prompt has the entry point. Columns: prompt_text, statement, entry_point."""
    same = F.when(F.col("prompt_text") == F.col("statement"), "equal").when(F.trim("prompt_text") == F.trim("statement"), "equal_stripped").otherwise("different")
    return crosstab(rows.select(same.alias("agreement"), F.coalesce(F.col("prompt_text").contains(F.col("entry_point")), F.lit(False)).alias("has_entry_point")), "agreement", "has_entry_point")


def identical_prompts(rows: DataFrame, prompt: str, item: str) -> DataFrame:
    """Members of the groups of rows with the same prompt (duplicate_groups())."""
    return duplicate_groups(rows.select(F.md5(prompt).alias("prompt_md5"), item), "prompt_md5", item=item)


def token_buckets(rows: DataFrame, body: str, limit: int = 32_768, chars_per_token: float = 3.5) -> DataFrame:
    over = text.token_estimate(F.col(body), chars_per_token) > limit
    return crosstab(rows.select(F.when(over, "over").otherwise("within").alias("bucket")), "bucket")


def snapshot_files(rows: DataFrame, body: str, *keys: str, pattern: str = r"(?m)^### ") -> DataFrame:
    """Quantiles of the number of files that prompts show."""
    return quantile_summary(rows.withColumn("_tf_files", F.regexp_count(body, F.lit(pattern))), "_tf_files", *keys)


def mentions_path(statement: Column, paths: Column) -> Column:
    return F.exists(paths, lambda p: statement.contains(p))


def names_in_statement(names: Column, statement: Column) -> Column:
    """all, some or none of the names stand in the statement; no_names where there are none."""
    has = lambda n: statement.contains(n)
    return F.when(F.size(names) <= 0, "no_names").when(F.forall(names, has), "all").when(F.exists(names, has), "some").otherwise("none")


def prompt_structure(prompt: Column, gold_paths: Column) -> Column:
    """struct(sections, listed, shown, gold_shown, gold_listed): headings, files listed (`- path`) and shown (`### path`), and whether the files of the reference are among them."""
    listed = F.regexp_extract_all(prompt, F.lit(r"(?m)^- ([\w./-]+\.\w+)\s*$"), F.lit(1))
    shown = F.regexp_extract_all(prompt, F.lit(r"(?m)^### ([\w./-]+\.\w+)\s*$"), F.lit(1))
    within = lambda whole: F.forall(gold_paths, lambda p: F.array_contains(whole, p))
    return F.struct(F.regexp_count(prompt, F.lit(r"(?m)^#{1,2} ")).alias("sections"), F.size(listed).alias("listed"), F.size(shown).alias("shown"), within(shown).alias("gold_shown"), within(listed).alias("gold_listed"))
