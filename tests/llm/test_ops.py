"""Every operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows, and none at all."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, common, decontaminate, line_dedup, near_dedup, probminhash, rans, secrets, sharding, simhash, token_files, toxicity, wordtable
from tallyforge.llm.pieces import SPACE, Pieces, digest_documents, encode_documents, pieces_of

public = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(60)}" for _ in range(n))


def documents():
    rng = random.Random(5)
    line = "This very common licence line is long enough to be counted."
    out = [(k, words(rng, rng.randrange(1, 120)) + "\n" + (line + f"\n{k}" if k % 2 else "short"), "en") for k in range(30)]
    base = words(rng, 200).split()
    for k in range(30, 36):
        copy = list(base)
        copy[k] = "changed"
        out.append((k, " ".join(copy), "fr"))
    out += [(40, " ".join(base), "fr"), (41, " ".join(base).upper() + "!", "fr"), (42, None, None), (43, "", "en"), (44, "", "en"), (45, "!!! ???", "de"), (46, "one", "en"), (47, words(rng, 30_000), "en"), (47, "tie " + line, "en"), (48, "  \t\n\n", "en"), (48, "  \t\n\n", "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents"
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("node", "bucket", "score", "part", "shard", "ids", "line", "n_words")})
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


def test_shards(spark, docs, nothing, tmp_path):
    for buckets in (1 << 30, 20_000):
        out = sharding.write_shards(docs, f"file://{tmp_path}/s{buckets}", shards=4, bucket_bytes=buckets).collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter((k, t) for k, t, _ in documents())
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        sizes = [len(by[s]) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.write_shards(nothing, f"file://{tmp_path}/none").count() == 0
    again = sharding.write_shards(docs, f"file://{tmp_path}/again", shards=4, bucket_bytes=20_000).collect()
    key = lambda rows: sorted((r.shard, r.slot, r.doc_id) for r in rows)
    assert key(again) == key(out)


def test_fisher_yates_is_uniform_and_plain():
    def plain(bucket, n, seed):
        draws = np.random.default_rng([seed, bucket]).integers(0, [n - k for k in range(n)])
        out = list(range(n))
        for step, j in enumerate(draws[: max(0, n - 1)]):
            k = n - 1 - step
            out[k], out[int(j)] = out[int(j)], out[k]
        return out

    assert all(sharding.order_in_bucket(b, n, 5).tolist() == plain(b, n, 5) for b in range(20) for n in (0, 1, 2, 7, 100))
    seen = Counter(tuple(sharding.order_in_bucket(b, 4, 1).tolist()) for b in range(4800))
    assert len(seen) == 24 and sum((n - 200) ** 2 / 200 for n in seen.values()) < 50  # chi square, 23 degrees


def test_each_bucket_is_one_partition(spark, docs, tmp_path):
    wide = docs.withColumn("wide", F.repeat(F.lit("x"), 5000)).withColumn("nested", F.array(F.lit("y")))
    n = wide.agg(F.sum(sharding.row_bytes(wide))).head()[0]
    assert n > 5000 * docs.count()
    sharding.write_shards(wide, f"file://{tmp_path}/w", shards=2, bucket_bytes=20_000)
    files = spark.read.parquet(f"file://{tmp_path}/w").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= n // 20_000 // 2  # a file for each bucket that has rows, at least


def test_toxicity_learns_and_ignores_language(spark, nothing):
    rng = random.Random(1)
    rows = [(k, words(rng, 40) + (" vileness " + rng.choice(["vilely", "vilest"]) if k % 5 == 0 else "") + " " + words(rng, 40), "en" if k % 2 else "fr", int(k % 5 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    scored = toxicity.score_documents(df, model)
    held = [r for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.toxicity >= 0.5) == r.toxic for r in held)
    assert right / len(held) > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "vilest " * 70_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in toxicity.score_documents(odd, model).collect()}
    assert got[1].toxicity == got[2].toxicity and got[3].toxicity > 0.5 and all(0 <= r.toxicity <= 1 for r in got.values())
    assert toxicity.score_documents(nothing, model).count() == 0
    none = toxicity.train(df, df.where("doc_id < 0").select("doc_id", "toxic"))
    assert [r.toxicity for r in toxicity.score_documents(odd, none).collect()] == [0.0] * 3


def test_thresholds_count_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, words(rng, 20) + (" vileness" if k % 9 == 0 else ""), "en" if k % 2 else "fr", int(k % 9 == 0)) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    ours = Counter((lang, toxic) for k, _, lang, toxic in rows if zlib.crc32(str(k).encode()) % 5)
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    for at_once in (10_000, 0):  # doc_ids broadcast, and not
        seen = []
        with monkeypatch.context() as m:
            m.setattr(toxicity, "BROADCAST_IDS", at_once, raising=False)
            m.setattr(toxicity, "best_threshold", lambda clean, toxic: seen.append((int(clean.sum()), int(toxic.sum()))) or 0.35)
            model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
        assert seen == [(ours[x, 0], ours[x, 1]) for x in ("en", "fr")] and model.thresholds == {"en": 0.35, "fr": 0.35}


def test_best_threshold_has_the_best_f1():
    rng = np.random.default_rng(4)
    toxic = rng.random(2000) < 0.1
    score = np.clip(rng.normal(0.35 + 0.2 * toxic, 0.12), 0, 1)
    f1 = {float(t): 2 * (toxic & (score >= t)).sum() / ((score >= t).sum() + toxic.sum()) for t in toxicity.GRID}
    bins = np.searchsorted(toxicity.GRID, score, "right")
    got = toxicity.best_threshold(*[np.bincount(bins[toxic == k], minlength=len(toxicity.GRID) + 1) for k in (0, 1)])
    assert f1[got] == max(f1.values())


def plain_score(model, text):
    """The network's score, a word and a filter at a time."""
    vectors = [model.embed[a] + model.embed[b] for a, b in map(toxicity.features, decontaminate.words_of(text))]
    pooled = []
    for w, f in zip(toxicity.WIDTHS, model.filters):
        best = np.full(toxicity.FILTERS, -np.inf)
        for at in range(max(1, len(vectors))):
            best = np.maximum(best, sum((v @ f[o * toxicity.DIM : (o + 1) * toxicity.DIM] for o, v in enumerate(vectors[at : at + w])), np.zeros(toxicity.FILTERS)))
        pooled.append(best)
    z = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_network(monkeypatch):
    rng = random.Random(3)
    train = [words(rng, 30) for _ in range(40)]
    model = toxicity.fit(train, np.array([0.0, 1.0] * 20), np.ones(40))
    texts = ["", "   ", "one", "Ünï cödé!", "two words", " lead and trail ", "\u3000wide", *[words(rng, n) for n in (3, 50, 400)]]
    want = [plain_score(model, t) for t in texts]
    assert model.score(texts) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 100)
    assert model.score(texts) == pytest.approx(want, abs=1e-5)


def test_long_text_pools_over_parts():
    model = toxicity.fit(["a b c d", "x y z w"] * 20, np.array([0.0, 1.0] * 20), np.ones(40))
    rng = np.random.default_rng(1)
    table = model.projected(pa.array([f"w{k}" for k in range(500)]))
    ids = rng.integers(1, 501, 1300)
    assert model._score([ids], table, 100)[0] == pytest.approx(model._score([ids], table)[0])


def test_training_sample_is_bounded_before_it_is_collected(spark, monkeypatch):
    rows = [(k, "bad " * 10 if k % 2 else "good " * 10, int(k % 2)) for k in range(60)] + [(61, "bad " * 1000, 1), (62, None, 0), (2, "zz", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(3, None), (None, 1), (5, 1)], "doc_id long, toxic int"))
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, weight: seen.append(texts) or toxicity.Model(np.zeros((1, 1)), [], np.zeros(0), np.zeros(0), 0.0, constant=0.0))
    toxicity.train(df.drop("toxic"), labels)
    assert 900 < sum(map(len, seen[0])) <= 1000 and "bad " * 1000 not in seen[0] and seen[0].count("bad " * 10) > 5


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.4, 60_000), 4000)
    table = rans.quantised(np.bincount(ids, minlength=5000))
    assert int(table.freq.sum()) == 1 << rans.PRECISION
    blocks = [ids[:0], ids[:1], ids[:31], ids[:32], ids[:33], ids[:8192], ids[100:50_000]]
    coded = rans.encode(blocks, table)
    assert all((a == b).all() for a, b in zip(blocks, rans.decode(coded, table)))
    assert (rans.decode([coded[5]], table)[0] == blocks[5]).all()
    bad = bytearray(coded[6])
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode([bytes(bad)], table)
    only = rans.quantised(np.array([0, 9]))
    assert rans.decode(rans.encode([np.ones(100, np.int64)], only), only)[0].tolist() == [1] * 100


def test_token_files(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_tokens(docs, f"file://{tmp_path}/t", path, parts=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids) for r in token_files.read_tokens(spark, f"file://{tmp_path}/t").collect())
    at = 0
    for start, doc, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    assert [d for _, d, _, _ in got] == sorted(k for k, _, _ in documents())
    want = Counter((k, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for k, t, _ in documents())
    assert Counter((d, tuple(ids)) for _, d, _, ids in got) == want
    crc = token_files.read_tokens(spark, f"file://{tmp_path}/t", digest=True).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in crc) == Counter((d, zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want.elements())
    token_files.write_tokens(nothing, f"file://{tmp_path}/n", path)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/n").count() == 0


def test_word_wise_tokens_equal_whole_text_tokens(monkeypatch):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(2)
    pool = ["a", "I'm", " ", "  ", "\n", "\t", "\x1c", "\x85", "\x0b", "é", "é", "ΑΣ", " ́", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "!?", "İ", "漢字", "\xa0", "don't", "🙂", " ", "Über&&&", "x.", "'", "'S", "ª", "ǅ", "ᄀ", "ᅡ", "_"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["", words(rng, 50_000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def got(end=None):
        ids, starts = token_files.tokenise(pa.array(texts), path, end)
        return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]

    assert token_files.words_of_tokenizer(path).by_word
    assert got() == want and got(2) == [x + [2] for x in want]
    monkeypatch.setattr(wordtable, "CACHE_WORDS", 50)  # words are forgotten, and texts are laid out in parts
    monkeypatch.setattr(wordtable, "WORDS_AT_ONCE", 37)
    assert got() == want and got(2) == [x + [2] for x in want]


def test_other_tokenizers_encode_whole_texts(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert not token_files.words_of_tokenizer(path).by_word
    token_files.write_tokens(docs.where("doc_id < 47"), f"file://{tmp_path}/b", path, end_id=None)
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_files.read_tokens(spark, f"file://{tmp_path}/b").collect())
    assert got == Counter((k, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in documents() if k < 47)


def test_one_doc_id_is_split_over_parts(spark, tmp_path):
    path = public.path("word_bpe_49k.json")
    df = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    token_files.write_tokens(df, f"file://{tmp_path}/one", path, parts=4)
    rows = token_files.read_tokens(spark, f"file://{tmp_path}/one").collect()
    assert sorted(r.start for r in rows) == [k * rows[0].n_tokens for k in range(400)]
    assert spark.read.parquet(f"file://{tmp_path}/one/blocks").select("part").distinct().count() > 1


def test_simhash_of_edits_in_order(spark, docs, nothing):
    rows = [(k, t) for k, t, _ in documents() if k != 47 and k != 48]
    df = docs.where("doc_id NOT IN (47, 48)").select("doc_id", "text")
    got = {r.doc_id: r for r in simhash.fingerprint_documents(df, parts=5).collect()}
    rows.sort(key=lambda r: r[0])
    assert len(got) == len(rows)
    for (k, t), (j, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        h = len(t) // 2
        edit = t[: len(t) - h] + n[:h]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (got[k].g1, got[k].g2) == (got[j].f1, got[j].f2)
    assert (got[42].f1, got[42].f2) == (0, 0) == (got[43].f1, got[43].f2)
    assert simhash.fingerprint_documents(docs, parts=4).count() == docs.count()
    one = df.where("doc_id = 46")
    r = simhash.fingerprint_documents(one).head()
    assert (r.f1, r.f2) == (r.g1, r.g2)
    assert simhash.fingerprint_documents(nothing).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = []
    for _ in range(40):
        x = rng.getrandbits(128)
        for d in range(6):
            y = x
            for b in rng.sample(range(128), d):
                y ^= 1 << b
            prints.append(y)
    prints += prints[:5]
    rows = [(signed(p & ((1 << 64) - 1)), signed(p >> 64)) for p in prints]
    df = spark.createDataFrame(rows, "f1 long, f2 long")
    got = Counter((r.f1, r.f2, r.g1, r.g2, r.distance, r.n) for r in simhash.within_radius(df, df, 3).collect())
    times = Counter(rows)
    want = Counter()
    for a in set(prints):
        for b in set(prints):
            if (a ^ b).bit_count() <= 3:
                x, y = ((signed(p & ((1 << 64) - 1)), signed(p >> 64)) for p in (a, b))
                want[(*x, *y, (a ^ b).bit_count(), times[y])] += 1
    assert got == want and len(want) > len(set(prints))


def plain_lines(rows, least=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for k, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(k)
    out = Counter()
    for k, t, *_ in rows:
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 40 or len(holders[key(x)]) < least or k == max(holders[key(x)])]
        out[k, None if t is None else "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)] += 1
    return out


def plain_print(text):
    import xxhash

    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    terms = w if len(w) < 2 else [f"{a} {b}" for a, b in zip(w, w[1:])]
    votes, total = [0] * 128, 0
    for t in terms:
        weight = int(1 + min(len(t), 24) / 8)
        total += weight
        for h, seed in enumerate(simhash.SEEDS):
            x = xxhash.xxh64_intdigest(t, xxhash.xxh64_intdigest(seed, 42))
            for k in range(64):
                votes[64 * h + k] += weight * (x >> k & 1)
    halves = [sum((2 * votes[64 * h + k] > total) << k for k in range(64)) for h in (0, 1)]
    return tuple(x - (1 << 64) if x >> 63 else x for x in halves)


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(5)
    texts = [None, "", "one", "a b", "a b a b", " tab\tand\nline ", words(rng, 300), words(rng, 5000), "é ü 漢字 " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.fingerprint_documents(df, parts=3).withColumn("like", simhash.likeness(("f1", "f2"), ("g1", "g2"))).collect()}
    for k, t in enumerate(texts):
        mine, following = plain_print(t or ""), plain_print(texts[(k + 1) % len(texts)] or "")
        assert (got[k].f1, got[k].f2) == mine and (got[k].g1, got[k].g2) == following
        apart = sum((a ^ b) % (1 << 64) >> i & 1 for a, b in zip(mine, following) for i in range(64))
        assert got[k].like == 1 - apart / 128


def test_edited_fingerprints_equal_plain_ones(spark):
    rng = random.Random(12)
    pool = ["a", "bb", " ", " ", "\n", "  ", "\t", "é", "ccc", "\u3000", "漢", "\x1c", "d"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(500)] + [words(rng, n) + rng.choice(["", " "]) for n in (1, 2, 3, 200, 3, 900, 5) for _ in range(4)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7):
        got = {r.doc_id: r for r in simhash.fingerprint_documents(df, parts=parts).collect()}
        for k, t in enumerate(texts):
            n = texts[(k + 1) % len(texts)]
            edit = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert got[k].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
            assert ((got[k].f1, got[k].f2), (got[k].e1, got[k].e2), (got[k].g1, got[k].g2)) == (plain_print(t), plain_print(edit), plain_print(n)), (t, n, edit)


def test_rows_of_one_doc_id_are_split(spark):
    import xxhash

    rng = random.Random(8)
    rows = [(7, f"{words(rng, 3)} {k}") for k in range(300)] + [(k, f"other {k}") for k in range(20)] + [(None, f"none {k}") for k in range(100)] + [(9, "same")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.in_order(df, parts=8).where("own").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    parts = Counter(r.part for r in out if r.doc_id == 7)
    assert len(parts) >= 4 and max(parts.values()) < 150
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], signed(xxhash.xxh64_intdigest(r[1], 42))))
    assert Counter((r.doc_id, r.text, r.next_text) for r in out) == Counter((k, t, n) for (k, t), (_, n) in zip(order, order[1:] + order[:1]))


def test_near_counts_equal_brute_force(spark):
    rng = random.Random(9)
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(20)]
    rows = [(k, *base[k % 20]) if k % 3 else (k, base[k % 20][0] ^ (1 << k % 60), base[k % 20][1] ^ (k & 7)) for k in range(200)] + [(400, None, None), (None, *base[0]), (420, 0, 0), (440, 0, 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, f1 long, f2 long, n_near int")
    got = {r.doc_id: r.n_near for r in simhash.count_near(df, F.col("doc_id") % 20 == 0).collect()}
    for k, a, b in rows:
        asked = k is not None and k % 20 == 0
        want = sum((a ^ x).bit_count() + (b ^ y).bit_count() <= 3 for _, x, y in rows if x is not None) - 1 if asked and a is not None else 0 if asked else None
        assert got[k] == want
    assert simhash.count_near(df.where("doc_id < 0"), F.col("doc_id") % 20 == 0).count() == 0


def test_line_dedup(spark, docs, nothing):
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    assert got == plain_lines(documents()) and any(k[3] for k in got)
    assert line_dedup.dedup_lines(nothing).count() == 0
    upper = [(k, f" É{'a' * 45} \rB\x0b" + ("" if k % 2 else "\n") + "ﬀİ") for k in range(7)] + [(k + 10, f"é{'A' * 45}") for k in range(4)]
    df = spark.createDataFrame(upper, "doc_id long, text string")
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, batches=2).collect()) == plain_lines(upper)


def test_runs_compact_into_levels(spark, docs, nothing):
    runs = line_dedup.build_runs(line_dedup.line_hashes(docs), batches=4)
    assert [len(x) for x in runs.levels] == [0, 0, 1] or sum(map(len, runs.levels)) < runs.made
    runs.drop(runs.names())
    held = spark.range(4000).select((F.col("id") % 100).alias("doc"), F.xxhash64(F.col("id") % 300).alias("h1"), F.xxhash64(F.lit(1), F.col("id") % 300).alias("h2"))
    runs = line_dedup.build_runs(held, batches=3)
    assert [len(x) for x in runs.levels] == [1, 1]
    plan = runs.frequent()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan  # runs are folded bucket by bucket
    rows = [(r["doc"], (r.h1, r.h2)) for r in held.collect()]
    docs_of = defaultdict(set)
    for d, k in rows:
        docs_of[k].add(d)
    got = {(r.h1, r.h2): r.last_doc for r in runs.frequent().collect()}
    assert got == {k: max(v) for k, v in docs_of.items() if len(v) >= 5}
    runs.drop(runs.names())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tf_run_")]
    empty = line_dedup.build_runs(line_dedup.line_hashes(nothing))
    assert empty.frequent().count() == 0
    empty.drop()


def test_a_batch_meets_the_runs_where_they_are(spark, tmp_path):
    """Over two and three runs: nothing above a run is an exchange, raw rows are summed before they are dealt by key, and a line of a third of all documents makes no large task."""
    path = f"file://{tmp_path}/held"
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2500)
    spark.range(30_000).select((F.col("id") % 3000).alias("doc"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")).repartition(8).write.parquet(path)
    held = spark.read.parquet(path)
    runs = line_dedup.Runs(spark, common.staging_dir(spark, "runs"), 5, 10)
    for k in range(3):
        runs.add(held.where(F.col("doc") % 4 == k))
        if k == 0:
            continue
        assert len(runs.names()) == k + 1
        fold = runs.frequent()._jdf.queryExecution().executedPlan().toString()
        assert fold.count("Bucketed: true") >= k + 1 and "Exchange" not in fold
        settled = runs.table(runs.frequent())
        batch = held.where(F.col("doc") % 4 == 3).select("doc", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        out = runs.fresh(batch, settled)
        plan = out._jdf.queryExecution().executedPlan().toString()
        left, right = plan.split("Bucketed: true")[0], plan[plan.index("tf_run_") - 800 :]
        assert plan.count("Exchange hashpartitioning(h1") == 1 and "SortMergeJoin" in plan
        assert "HashAggregate" in left.split("Exchange hashpartitioning(h1")[1].split("\n")[1] and "partial_count" in left.split("Exchange hashpartitioning(h1")[1].split("\n")[1]
        assert "Exchange" not in right.split("SortMergeJoin")[-1].split("Sort [")[-1]
        assert out.where(F.col("h1") == F.xxhash64(F.lit(0))).count() == 0  # the hot line is settled
        runs.drop([settled])
    runs.drop()
    assert not runs.tables and not [t.name for t in spark.catalog.listTables() if t.name.startswith("tf_run_")]


def test_a_failing_batch_leaves_no_tables(spark, docs, monkeypatch):
    inner, made = line_dedup.Runs.add, []

    def add(self, held):
        if made:
            raise RuntimeError("lost")
        made.append(1)
        inner(self, held)

    monkeypatch.setattr(line_dedup.Runs, "add", add)
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dedup_lines(docs)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tf_run_")]


def test_line_dedup_of_odd_rows(spark):
    long = "A line that is surely longer than forty characters, " * 2
    rows = [(k, f"{long}\n{long}\n{k}", 1, 2) for k in range(6)] + [(None, f"{long}\nx", 1, 2), (None, None, 1, 2), (7, "", 1, 2), (8, f" \t{long.upper()}\x0b", 1, 2), (8, long, 1, 2), (9, "z" * 300_000 + "\n" + long, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, h1 int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    want = plain_lines([(-(1 << 63) if k is None else k, t) for k, t, *_ in rows])
    assert Counter((-(1 << 63) if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == want
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(df.where("doc_id < 4")).collect()) == [(k, 0) for k in range(4)]  # four documents are too few


def plain_classes(rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    sets = []
    for k, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = word.findall(low)
        sets.append((k, tuple(w) or ("", t or ""), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, wi, si) in enumerate(sets):
        for j in range(i):
            _, wj, sj = sets[j]
            if wi == wj or (si and sj and len(si & sj) >= 0.8 * len(si | sj)):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, *_) in enumerate(sets):
        least[root(i)] = min(k, least.get(root(i), k))
    return Counter((k, least[root(i)]) for i, (k, *_) in enumerate(sets))


def test_near_dedup_classes(spark, docs, nothing):
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect())
    assert got == plain_classes(documents())
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in got}) + len([1 for k, c in got if k == 47]) - 1
    assert near_dedup.classes(nothing).count() == 0 and near_dedup.keep_one(nothing).count() == 0


def test_dense_groups_split_into_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = words(rng, 120).split()
    rows = []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(120), 2 + k % 3):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_classes(rows)


def test_copies_that_repeat_passages(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        passage, rest = words(rng, 20), words(rng, 80)
        rows += [(2 * k, f"{passage} {passage} {rest}"), (2 * k + 1, f"{passage} " * 200 + rest)]  # the same shingles
    df = spark.createDataFrame(rows, "doc_id long, text string")
    regs = {r.doc_id: r.regs for r in near_dedup.sketch(df).collect()}
    assert all(regs[2 * k] == regs[2 * k + 1] for k in range(60))
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.classes(df).collect()) == plain_classes(rows)


def plain_probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_probability_jaccard_is_what_registers_estimate():
    rng = random.Random(6)
    for _ in range(40):
        a, b = ({rng.randrange(30): rng.choice([1.0, 1.0, 2.5, 9.0]) for _ in range(rng.randrange(20))} for _ in range(2))
        arrays = [np.array(f(sorted(x)), t) for x in (a, b) for f, t in ((lambda k: k, np.uint64), (lambda k, x=x: [x[i] for i in k], np.float64))]
        assert probminhash.probability_jaccard(*arrays) == pytest.approx(plain_probability_jaccard(a, b))
    passage, rest = words(rng, 20), words(rng, 100)
    texts = [f"{passage} {passage} {rest}".encode(), (f"{passage} " * 60 + rest).encode()]
    of, s, w, _ = probminhash.weighted_shingles(texts)
    kept = probminhash.signatures(of, s, w, 2, 4000)
    sides = [(s[of == k], w[of == k]) for k in (0, 1)]
    assert (kept[0] == kept[1]).mean() == pytest.approx(probminhash.probability_jaccard(*sides[0], *sides[1]), abs=0.04)


def test_weighted_classes_equal_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for k in range(12):
        passage, rest = words(rng, 20), words(rng, 90)
        rows += [(4 * k + j, f"{passage} " * n + rest) for j, n in enumerate((1, 2, 3, 60))]
    parent = list(range(len(rows)))
    sets = [Counter(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows]
    sets = [{x: 1 + np.log(n) for x, n in c.items()} for c in sets]
    linked = {(i, j) for i in range(len(rows)) for j in range(i) if i // 4 == j // 4 and plain_probability_jaccard(sets[i], sets[j]) >= 0.8}
    for i, j in sorted(linked):
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), weighted=True).collect()}
    assert linked and len(set(parent)) > 12 and got == dict(enumerate(parent))


def test_strays_beside_a_large_component_cost_little(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    rows = [(1, f"g{k}", "giant") for k in range(200)] + [(1, "s1", "s1"), (1, "s2", "s2")] + [(2, f"g{k}", "giant") for k in range(50)] + [(3, f"a{k}", "a") for k in range(30)] + [(3, f"b{k}", "b") for k in range(30)]
    met = spark.createDataFrame([(k, n.encode(), c.encode()) for k, n, c in rows], "key long, node binary, comp binary")
    got = near_dedup.block_pairs(met).collect()
    of = lambda key: [r for r in got if r.key == key]
    assert not of(2) and len(of(1)) == 200 + 2 * 20 + 2  # one block of strays meets twenty others and itself
    groups = defaultdict(list)
    for r in got:
        groups[r.key, r.bi, r.bj].append((bytes(r.node), bytes(r.comp), r.blk))
    for key in (1, 3):  # every pair of different components meets, and once
        pairs = Counter(frozenset((m, n)) for (k, bi, bj), ms in groups.items() if k == key for i, (m, c, x) in enumerate(ms) for n, d, y in ms[:i] if c != d and (x != y or bi == bj))
        nodes = [(n.encode(), c) for k, n, c in rows if k == key]
        assert pairs == Counter(frozenset((m, n)) for i, (m, c) in enumerate(nodes) for n, d in nodes[:i] if c != d)


def test_registers_estimate_similarity():
    rng = random.Random(3)
    a = words(rng, 1000).split()
    b = a[:900] + words(rng, 100).split()
    texts = [" ".join(x).encode() for x in (a, b)]
    of, s, w, _ = probminhash.weighted_shingles(texts)
    kept = probminhash.signatures(of, s, w, 2, 2000)
    sa, sb = set(s[of == 0].tolist()), set(s[of == 1].tolist())
    assert abs((kept[0] == kept[1]).mean() - len(sa & sb) / len(sa | sb)) < 0.05


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\nb<|im_end|>\n<|im_start|>x"), (1, 2, None, None), (2, 0, "assistant", "<\\|</s>[INST][\\/INST]\\"), (2, 0, "assistant", "<\\|</s>[INST][\\/INST]\\"), (3, 5, "sys\ntem", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold(chat.as_events(chat.with_probe(df)))).cache()
    back = sorted((r.conv_id, r.k, r.role, r.text, r.loss) for r in chat.read_back(formatted).collect())
    want = sorted((c, t, r or "", x or "") for c, t, r, x in rows) + []
    want += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert Counter((c, r, t, x) for c, _, r, t, x in back) == Counter((c, r, x, r == "assistant") for c, _, r, x in want)
    for r in formatted.collect():
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert len(spans) == sum(1 for c, _, role, _ in want if c == r.conv_id and role == "assistant") and all("<|" not in s for s in spans)
    assert chat.render(chat.fold(chat.as_events(df.where("conv_id > 9")))).count() == 0


def plain_digests(rows):
    """The contract's digests of conversations (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn, role or "", text or ""))
    out = Counter()
    bodies = lambda t: len(re.sub(r"\[(\\*)(/?INST\])", r"[\\\1\2", re.sub(r"<(\\*)(\||/?s>)", r"<\\\1\2", t)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss), sum(12 + len(r) + 1 + bodies(t) + 11 for _, _, r, t in turns)] += 1
    return out


def test_chat_query_keeps_null_conversations(spark, tmp_path):
    from tallyforge.llm import queries

    rng = random.Random(4)
    rows = [(c, k, "assistant" if k % 2 else "user", words(rng, 5) + rng.choice(["", "\n", "<|im_end|>\n", "[INST]", "</s>"])) for c in (1, 2, None) for k in range(4)]
    rows += [(None, None, "user", "x"), (3, None, None, None), (3, 0, "assistant", ""), (4, 0, "user", "y" * 200_000), (5, 1, "assistant", "a"), (5, 1, "assistant", "a")]
    spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, seq int, kind int").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = Counter((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in queries.op7_chat(spark, f"file://{tmp_path}").collect())
    assert got == plain_digests([*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])


def test_events_fold(spark):
    log = [("c", 0, 1, "message", "user", "he"), ("c", 0, 2, "delta", None, "llo"), ("c", 1, 3, "message", "assistant", ""), ("c", 1, 4, "delta", None, "bad"), ("c", 1, 5, "regenerate", None, ""), ("c", 1, 6, "delta", None, "go"), ("c", 1, 7, "delta", None, "od"), ("c", 0, 8, "edit", None, "bye"), ("c", 2, 9, "message", "user", "x"), ("c", 2, 10, "delete", None, None)]
    df = spark.createDataFrame(log, "conv_id string, turn long, seq long, kind string, role string, text string")
    assert sorted((r.turn, r.role, r.text) for r in chat.fold(df).collect()) == [(0, "user", "bye"), (1, "assistant", "good")]


def test_pieces_equal_the_library(spark, docs, nothing):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces_of(path)
    rng = random.Random(1)
    pool = ["a", "b", " ", "  ", SPACE, "\n", "é", "漢字", "aaaa", "==", "🙂", "the", " th", "er", "0", "<s>", "ﬀ", "한국", "ing", "       "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["x" * 5000, " " * 40, ""] + [t or "" for _, t, _ in documents()]
    ids = own.encode(texts)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert own.decode(ids) == library.decode(want) and own.decode([]) == [] and own.encode([]) == [] and own.decode([b""]) == [""]
    again = own.encode(texts[::-1])
    assert again[::-1] == ids
    assert own.decode([np.array([own.byte_ids[0xE2], own.byte_ids[0x82], own.byte_ids[65]], "<u4").tobytes()]) == ["��A"]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest_documents(docs, path).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    each = [(k, library.encode(t or "", add_bos=True, add_eos=True)) for k, t, _ in documents()]
    assert got == Counter((k, len(i), sha(np.array(i, "<u4").tobytes()), sha(library.decode(i).encode())) for k, i in each)
    assert sorted(r.piece_ids for r in encode_documents(docs, path).collect()) == sorted(i for _, i in each)
    assert encode_documents(nothing, path).count() == 0
    with pytest.raises(Exception):
        Pieces(b"nonsense")


def plain_hits(doc, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words_ = cut(doc)
    hit, found = set(), set()
    for item, text in items:
        w = cut(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for at in range(len(words_) - n + 1):
                if words_[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(words_), len(hit), sorted(found)


@pytest.mark.parametrize("at_once", [decontaminate.BYTES_AT_ONCE, 15_000])
def test_contamination(spark, docs, nothing, at_once):
    rng = random.Random(6)
    items = [(k, words(rng, 20)) for k in range(6)] + [(10, "alpha beta!"), (11, None), (12, ""), (13, "ÉCOLE Zürich"), (14, words(random.Random(5), 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(100, "x " + items[0][1].upper() + " y " + items[1][1][:60], 1), (101, "Alpha, BETA. Alpha beta", 1), (102, "École zürich ÉCOLE zürich", 1), (103, None, 1), (104, " ".join(items[2][1].split()[3:16]), 1)]
    df = docs.select("doc_id", "text", F.lit(1).alias("n_words")).where("doc_id < 40").unionByName(spark.createDataFrame(extra, "doc_id long, text string, n_words int"))
    out = decontaminate.judged(decontaminate.find_windows(df, bench, at_once=at_once))
    want = Counter((k, *plain_hits(t, items)[:2], ",".join(plain_hits(t, items)[2])) for k, t in [*[(k, t) for k, t, _ in documents() if k < 40], *[e[:2] for e in extra]])
    rows = out.collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r.hit_items)) for r in rows) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(out).collect()}
    assert cut[101] == "" and cut[103] is None and cut[100].startswith("x  y ")
    assert decontaminate.find_windows(nothing, bench).count() == 0
    assert decontaminate.find_windows(df, bench.where("item_id > 99")).where("size(hit_items) > 0").count() == 0


def test_blocks_of_items_are_bounded_and_scanned_one_by_one(spark, monkeypatch):
    rng = random.Random(7)
    items = [(k, words(rng, 30)) for k in range(20)] + [(50, words(rng, 400)), (51, "short item"), (None, words(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PIECE", 40)
    blocks = decontaminate.item_blocks(bench, 13, 25_000)
    assert len(blocks) > 5 and all(b.agg(F.sum("bytes")).head()[0] <= 25_000 for b in blocks)
    with pytest.raises(ValueError, match="may be sent at once"):
        decontaminate.item_blocks(bench, 13, 10_000)
    long = items[20][1].split()
    df = spark.createDataFrame([(1, items[3][1] + " x " + items[4][1]), (2, " ".join(long[30:70])), (3, "a short item"), (4, " ".join(long)), (5, None)], "doc_id long, text string")
    out = decontaminate.find_windows(df, bench, at_once=25_000)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # every scan is written before the next
    want = Counter((k, *plain_hits(t, [x for x in items if x[0] is not None])[:2], ",".join(plain_hits(t, [x for x in items if x[0] is not None])[2])) for k, t in [(r.doc_id, r.text) for r in df.collect()])
    assert Counter((r.doc_id, r.n_words, sum(x["end"] - x["start"] for x in r.hit_runs), ",".join(r.hit_items)) for r in out.collect()) == want


def measured(block):
    """Bytes that the windows of a block's items take, and at most took while they were made."""
    items = [tuple(r) for r in block.select("item_id", "text").collect()]
    tracemalloc.start()
    try:
        windows = decontaminate.Windows(items)
        return (*tracemalloc.get_traced_memory(), windows)
    finally:
        tracemalloc.stop()


def test_repeated_and_short_items_stay_below_the_bound(spark):
    rng = random.Random(8)
    long = words(rng, 5012)
    copies = spark.createDataFrame([(7, long)] * 60 + [(8, long)], "item_id long, text string")
    blocks = decontaminate.item_blocks(copies, 13, 3 << 19)
    assert len(blocks) == 2 and [b.count() for b in blocks] == [1, 1]  # a repeated item is one, another of the same text isn't
    n = 50_000
    short = spark.range(n).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(13)]).alias("text"))
    bound = 8 << 20
    blocks = decontaminate.item_blocks(short, 13, bound)
    sizes = [b.agg(F.sum("bytes")).head()[0] for b in blocks[:5]]
    assert max(sizes) <= bound and len(blocks) * bound > n * 13 * 100
    now, most, windows = measured(blocks[0])
    assert most <= sizes[0] <= bound and now > sizes[0] / 5, (now, most, sizes[0])
    now, most, _ = measured(decontaminate.item_blocks(copies, 13, 3 << 19)[0])
    assert most <= 3 << 19


def test_texts_are_written_once_for_all_blocks(spark, tmp_path, monkeypatch):
    """Scans of several blocks write row numbers and hits, and of rows without hits only the first one's count."""
    seen = []
    inner = decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, name, **k: seen.append((name, df.columns)) or inner(df, name, **k))
    rng = random.Random(9)
    items = spark.createDataFrame([(k, words(rng, 40)) for k in range(12)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("so "), "text").alias("text"), F.lit("z").alias("hit_runs")).union(spark.createDataFrame([(99, "nothing here", "z"), (99, None, "z"), (None, "", "z")], "doc_id long, text string, hit_runs string"))
    out = decontaminate.judged(decontaminate.find_windows(docs, items, at_once=25_000)).collect()
    assert [c for n, c in seen if n == "numbered"] == [["doc_id", "text", "_tf_row"]]
    assert all("text" not in c for n, c in seen if n == "scanned") and sum(n == "scanned" for n, _ in seen) > 3
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit) for r in out) == sorted([(k, 41, 40) for k in range(12)] + [(99, 2, 0), (99, 0, 0), (-1, 0, 0)])


def plain_base(text):
    found = []
    for kind, pattern, least in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(found)]


def test_secrets(spark, docs, nothing):
    rng = random.Random(9)
    pool = ["password", "SECRET", "toKen", "ſecret", "api_key", "=", ": ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef01234567", "abcdefghijkl", " ", "\n", "é", "="]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for t in texts:
        base, spans = secrets.scan(t)
        assert [(secrets.KINDS[k], s, e) for s, k, e in base] == plain_base(t)
        assert set(base) <= set(spans) and spans == sorted(spans)
    found = lambda t: [t[s:e] for s, k, e in secrets.scan(t)[1] if k == 3]
    assert found("db_password := 'Xk29-lmQp!7'") == ["Xk29-lmQp!7"]
    assert found('DEFAULT = "q8Wz-77kLmP"\nuser = DEFAULT\nclient_secret = DEFAULT\n') == ["q8Wz-77kLmP"]
    assert found('color = "q8Wz-77kLmP"') == [] and found("password: changeme") == []
    assert secrets.redact("a=12345 b", [(2, 5), (4, 7)]) == "a=[secret] b"
    rows = secrets.scan_secrets(docs).collect()
    assert Counter((r.doc_id, len(r.base_spans)) for r in rows) == Counter((k, len(plain_base(t or ""))) for k, t, _ in documents())
    assert secrets.scan_secrets(nothing).count() == 0


def test_secrets_of_any_length():
    found = lambda t: [t[s:e] for s, k, e in secrets.scan(t)[1] if k == 3]
    long = "q8Wz-77kLmP/" * 400
    assert found(f'private_credential = "{long}"') == found(f"private_credential: '{long}'") == found(f"private_credential={long}\n") == [long]
    assert found(f"{'deploy_' * 12}passphrase = 'Xk29-lmQp!7'") == ["Xk29-lmQp!7"]
    text = f"credential={long}"
    assert secrets.redact(text, [(s, e) for s, _, e in secrets.scan(text)[1]]) == "credential=[secret]"


SECRET, OTHER = "q8Wz-77kLmP/x9", "Zk4%vT2!mmRq81"
LEXED = [
    (f'db_pwd = "{SECRET}"', [SECRET]),
    (f'db_pwd = "q8Wz\\"77kLmP-Zx9" + x', ['q8Wz\\"77kLmP-Zx9']),
    (f"db_pwd = 'q8Wz77\\\nkLmP-Zx9'", ["q8Wz77\\\nkLmP-Zx9"]),
    (f'private_credential = """\n{SECRET}\n  "quoted" {OTHER}\n"""\nx = 1', [f'\n{SECRET}\n  "quoted" {OTHER}\n']),
    (f"private_credential: r\'\'\'{SECRET}\'\'\'", [SECRET]),
    ('passphrase = "q8Wz77" + \n  "kLmPx9"', ["q8Wz77", "kLmPx9"]),
    ('passphrase = ("q8Wz77"\n   "kLmPx9")', ["q8Wz77", "kLmPx9"]),
    ('passphrase = "q8Wz77" "kLmPx9"', ["q8Wz77", "kLmPx9"]),
    (f"signing_key_secret: |\n  {SECRET}\n\n  {OTHER}\nnext: 1", [f"{SECRET}\n\n  {OTHER}"]),
    (f"  - auth_pwd: >-\n      {SECRET}\n    other: {OTHER}", [SECRET]),
    (f'config["client_credential"] = "{SECRET}"', [SECRET]),
    (f'db_pwd: Final[str] = "{SECRET}"', [SECRET]),
    (f"run --client-pwd={SECRET} --user=q8Wz-77kLmP", [SECRET]),
    (f"<dbPwd>{SECRET}</dbPwd><dbUser>{OTHER}</dbUser>", [SECRET]),
    (f"<set credential='{SECRET}'/>", [SECRET]),
    (f'db_pwd = os.environ.get("DB_PWD", "{SECRET}")', [SECRET]),
    ("db_pwd = os.getenv_Value9(", []),
    (f"# don't use\n// db_pwd = '{SECRET}'", [SECRET]),
    (f"/* it's */ pwd: '{SECRET}', isn't", [SECRET]),
    (f'db_pwd = "{SECRET}\nx = 1', [SECRET]),
    (f"a = '{SECRET}'\na = '{OTHER}'\ndb_pwd = a", [OTHER]),
    (f"a = '{SECRET}'\ndb_pwd = a\na = '{OTHER}'", [SECRET]),
    (f"db_pwd = a\na = b\nb = '{SECRET}'", [SECRET]),
    (f"SALT='{SECRET}'\nDB_PWD=${{SALT}}\n", [SECRET]),
    (f"SALT='{SECRET}'\nDB_PWD=$SALT\n", [SECRET]),
    ("a = b\nb = a\npassword = a", []),
    ('x == "q8Wz-77kLmP"; pwd == "q8Wz-77kLmP"', []),
    ('pwd := ""\npwd2 = \'\'', []),
    (f"db_pwd = f(g('{SECRET}'), k='x')", [SECRET]),
    (f"db_pwd = f(user=g('{SECRET}'))", []),
    (f"db_pwd = f(g('x'), '{SECRET}')", [SECRET]),
    (f"<password>{SECRET}</password>", [SECRET]),
    (f'passwords = ["{SECRET}", "{OTHER}"]\nnames = ["{SECRET}x"]', [SECRET, OTHER]),
    (f'{{"passwords": [\n "{SECRET}",\n "{OTHER}"], "user": "{OTHER}1"}}', [SECRET, OTHER]),
    (f"db_passwords:\n  - {SECRET}\n  - '{OTHER}'\nusers:\n  - {OTHER}2", [SECRET, OTHER]),
    (f'user, password = "{OTHER}", "{SECRET}"', [SECRET]),
    (f'password, user := "{SECRET}", "{OTHER}"', [SECRET]),
    (f"f(user, password='{SECRET}', other='{OTHER}')", [SECRET]),
    (f'const dbPassword string = "{SECRET}"', [SECRET]),
    (f'var (\n\tuser string = "{OTHER}"\n\tdbPassword []byte = []byte("{SECRET}")\n)', [SECRET]),
    (f"let db_password: &'static str = \"{SECRET}\";", [SECRET]),
    (f'char db_password[] = "{SECRET}";', [SECRET]),
    (f'{{"clientSecret": {{"value": "{SECRET}"}}, "color": {{"value": "{OTHER}"}}}}', [SECRET]),
    (f'{{"clientSecret": {{"kind": "{OTHER}", "default": "{SECRET}"}}}}', [SECRET]),
    (f"client_secret:\n  value: {SECRET}\ncolor:\n  value: {OTHER}\n", [SECRET]),
    (f'<add key="DbPassword" value="{SECRET}"/><add key="Color" value="{OTHER}"/>', [SECRET]),
    (f'<add value="{SECRET}" key="DbPassword"/>', [SECRET]),
    (f'env:\n- name: DB_PASSWORD\n  value: "{SECRET}"\n- name: COLOR\n  value: "{OTHER}"', [SECRET]),
    (f'[{{"name": "DB_PASSWORD", "value": "{SECRET}"}}, {{"name": "COLOR", "value": "{OTHER}"}}]', [SECRET]),
    ("db_pwd = f(" + "a_long_name" * 30 + f" = g('{SECRET}'))", []),
]


@pytest.mark.parametrize("text, want", LEXED)
def test_lexer(text, want):
    got = secrets.lexed_spans(text)
    assert [text[s:e] for s, e in got] == want


def generated_file(rng, syntax):
    """A file of one syntax, and the literals in it that stand for secrets, by their places; written by rules that know nothing of the lexer."""
    bad, good = ["db_password", "apiKeySecret", "AUTH_TOKEN", "clientCredential", "signing-passphrase"], ["colour", "userName", "HOST_PORT", "title_text", "retry-count"]
    letters = "abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789"
    out, spans = "", []

    def literal(sensitive):
        if rng.random() < 0.15:
            return rng.choice(["changeme", "example", "your_value", "none"]), False
        return "".join(rng.sample(letters, 16)) + rng.choice(["q7", "Z9", "x3"]), sensitive

    def put(*parts):
        nonlocal out
        for x in parts:
            text, secret = x if isinstance(x, tuple) else (x, False)
            if secret:
                spans.append((len(out), len(out) + len(text)))
            out += text

    for k in range(rng.randrange(3, 14)):
        sensitive = rng.random() < 0.5
        name = rng.choice(bad if sensitive else good)
        value, other = literal(sensitive), literal(False)
        plain = name.replace("-", "_")
        if syntax == "python":
            form = rng.randrange(7)
            if form == 0:
                put(f"{plain} = '", value, "'\n")
            elif form == 1:
                put(f'self.{plain}: str = "', value, '"  # set\n')
            elif form == 2:
                put(f"colour{k}, {plain} = '", other, "', \"", value, '"\n')
            elif form == 3:
                put(f"{plain} = [\n    '", value, "',\n    '", literal(sensitive), "',\n]\n")
            elif form == 4:
                put(f"connect(host{k}, {plain}='", value, "', mode='", other, "')\n")
            elif form == 5:
                put(f"held{k} = '", value, f"'\n{plain} = held{k}\n")
            else:
                put(f"{plain} = get('", other if not sensitive else value, "')\n")
        elif syntax == "json":
            form = rng.randrange(4)
            put("{" if not k else "", f'"{name}": ')
            if form == 0:
                put('"', value, '",\n')
            elif form == 1:
                put('["', value, '", "', literal(sensitive), '"],\n')
            elif form == 2:
                put('{"note": "', other, '", "value": "', value, '"},\n')
            else:
                put('"",\n"list": [{"name": "' + name + '", "value": "', value, '"}],\n')
        elif syntax == "yaml":
            form = rng.randrange(5)
            if form == 0:
                put(f"{name}: ", value, "\n")
            elif form == 1:
                put(f"{name}:\n  - ", value, "\n  - '", literal(sensitive), "'\n")
            elif form == 2:
                put(f"{name}:\n  note: ", other, "\n  value: '", value, "'\n")
            elif form == 3:
                put(f"{name}: |\n  ", value, "\nend: 1\n")
            else:
                put(f"env:\n  - name: {name}\n    value: ", value, "\n")
        elif syntax == "shell":
            form = rng.randrange(3)
            if form == 0:
                put(f"export {plain}=", value, "\n")
            elif form == 1:
                put(f"VALUE{k}='", value, f"'\n{plain}=${{VALUE{k}}}\n")
            else:
                put(f"run --{name}=", value, " --mode=", other, "\n")
        else:
            form = rng.randrange(3)
            if form == 0:
                put(f"<{name}>", value, f"</{name}>\n")
            elif form == 1:
                put(f'<add key="{name}" value="', value, '"/>\n')
            else:
                put(f'<set {name}="', value, '" mode="', other, '"/>\n')
    return out, sorted(spans)


@pytest.mark.parametrize("syntax", ["python", "json", "yaml", "shell", "xml"])
def test_lexer_finds_what_generated_files_hold(syntax):
    rng = random.Random(len(syntax))
    for _ in range(300):
        text, want = generated_file(rng, syntax)
        got = secrets.lexed_spans(text)
        assert got == want, (text, [text[a:b] for a, b in want], [text[a:b] for a, b in got])


def test_lexer_on_any_text():
    rng = random.Random(3)
    pool = ["pwd", "secret_key", "=", ":", '"', "'", "`", "\\", "\n", " ", "(", ")", "|", ">", "<pwd>", "</pwd>", "+", "${", "}", "q8Wz-77kLmP", '"' * 3, "'" * 3, "[", "]", "--", "x"]
    for _ in range(4000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        spans = secrets.lexed_spans(t)
        assert all(0 <= s < e <= len(t) for s, e in spans) and spans == sorted(set(spans))
    for t in ('pwd="' + "\\" * 200_001, "pwd=" + "'" * 150_000, "pwd: |\n" + "  x\n" * 50_000, "a" * 300_000 + "=", "x=(" * 50_000, "<pwd>" * 40_000, '"' * 100_000, "pwd=f(" * 20_000, "pwd=[" * 20_000, "pwd={" * 20_000, "value=" * 20_000, "a, " * 50_000 + "pwd = 1", "pwd:\n" + "- x\n" * 50_000, "name='x' value='y' " * 20_000, ("pwd:\n" + " " * 50) * 5_000):
        secrets.lexed_spans(t)  # in time that grows with the length alone


def test_secret_columns_replace_those_of_the_input(spark):
    df = spark.createDataFrame([(1, f"db_pwd = '{SECRET}'", 1, 2), (2, None, 1, 2)], "doc_id long, text string, base_spans int, secret_spans int")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert got[1].base_spans == [] and [tuple(x) for x in got[1].secret_spans] == [("literal", 10, 10 + len(SECRET))] and got[2].secret_spans == []


def test_unquoted_secrets():
    found = lambda t: [t[s:e] for s, k, e in secrets.scan(t)[1] if k == 3]
    assert found("DB_PWD=Xk29lmQp7abcZ\npassphrase: aB3dE5fG7hJ9kL\n") == ["Xk29lmQp7abcZ", "aB3dE5fG7hJ9kL"]
    assert found("FALLBACK1=Xk29lmQp7abcZ\nclient_pwd=FALLBACK1\n") == ["Xk29lmQp7abcZ"]  # through a name that the text assigns, which is no literal
    assert found("color=Xk29lmQp7abcZ") == []
