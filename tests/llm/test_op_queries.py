"""Each opN_ query and each pipeline stage, over a small folder of tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import test_ops as plain
from pyspark.sql import functions as F

from tallyforge.llm import common, queries, secrets, simhash, toxicity

public = plain.public
corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows():
    rng = random.Random(21)
    line = "This very common licence line is long enough to be counted."
    out = [(k, plain.words(rng, rng.randrange(2, 90)) + "\n" + (line + f"\n{k}" if k % 3 else f"db_pwd = \"q8Wz-77kLmP{k}\"") + (" vileness" if k % 7 == 0 else ""), "en" if k % 2 else "fr") for k in range(60)]
    base = plain.words(rng, 150).split()
    out += [(60 + k, " ".join(base[: 20 + k] + ["changed"] + base[21 + k :]), "fr") for k in range(6)] + [(70 + k, " ".join(base), "en") for k in range(5)]
    out += [(80, None, None), (81, "", "en"), (82, "!!! ???", "de"), (83, "one", None), (84, plain.words(rng, 4000), "en"), (85, line, "en"), (86, "Alpha beta! and so on", "en"), (87, "AKIA" + "A1" * 10 + " 0123456789abcdef0 token: abcdefghijklmnop", "en"), (100, " \t\n\n", "en")]
    return out


ITEMS = [(k, plain.words(random.Random(30 + k), 20)) for k in range(4)] + [(9, "alpha beta"), (10, None), (11, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = rows() + [(101, "x y " + ITEMS[0][1] + " z", "en"), (102, plain.words(random.Random(1), 900) + " " + ITEMS[1][1], "en")]
    full = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    full.repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(60)] + [(61, None, None), (200, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", docs


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, folder):
    out = queries.op1_sharding(spark, folder[0]).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for k, t, _ in folder[1])
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_op2(spark, folder):
    out = {r.doc_id: r for r in queries.op2_toxicity(spark, folder[0]).collect()}
    assert set(out) == {k for k, *_ in folder[1]}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in out.items())
    assert out[80].score == out[81].score == out[100].score


def test_op3(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    at, want = 0, []
    for k, t, _ in sorted(folder[1], key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_files(spark, folder[0]).collect()) == want


def test_op4(spark, folder):
    out = {r.doc_id: r for r in queries.op4_simhash(spark, folder[0]).collect()}
    docs = sorted((k, t or "") for k, t, _ in folder[1])
    prints = {k: plain.plain_print(t) for k, t in docs}
    shown = lambda p: "".join(f"{x % (1 << 64):016x}" for x in p)
    apart = lambda p, q: sum(((a ^ b) % (1 << 64)).bit_count() for a, b in zip(p, q))
    for (k, t), (j, following) in zip(docs, docs[1:] + docs[:1]):
        edit = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        mine, other = prints[k], plain.plain_print(edit)
        near = sum(apart(mine, p) <= 3 for p in prints.values()) - 1 if k % 20 == 0 else None
        r = out[k]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) == (len(t), sha(edit), shown(mine), shown(other), 1 - apart(mine, other) / simhash.BITS, 1 - apart(mine, prints[j]) / simhash.BITS, near)


def test_op5(spark, folder):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op5_line_dedup(spark, folder[0]).collect())
    assert got == Counter((k, n, d, sha(t or "")) for (k, t, n, d), m in plain.plain_lines(folder[1]).items() for _ in range(m)) and any(x[2] for x in got)


def test_op6(spark, folder):
    assert Counter((r.doc_id, r.class_id) for r in queries.op6_near_dedup(spark, folder[0]).collect()) == plain.plain_classes(folder[1])


def test_op8(spark, folder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = Counter()
    for k, t, _ in folder[1]:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_sentencepiece(spark, folder[0]).collect()) == want


def test_op9(spark, folder):
    want = Counter()
    for k, t, _ in folder[1]:
        n, hit, items = plain.plain_hits(t, ITEMS)
        want[k, n, hit, len(items), sha(",".join(items)), hit > 0 and 20 * hit >= n] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op9_decontaminate(spark, folder[0]).collect())
    assert got == want and len({x[5] for x in got}) == 2 and any(x[2] and not x[5] for x in got)


def test_op10(spark, folder):
    for r in queries.op10_secrets(spark, folder[0]).collect():
        text = next(t for k, t, _ in folder[1] if k == r.doc_id) or ""
        base = plain.plain_base(text)
        kinds = Counter(k for k, *_ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base)) and r.spans == secrets.joined(secrets.scan(text)[1])
        assert ("literal" in r.spans) == ("db_pwd" in text)


def test_stages_equal_plain_versions(spark, folder, tmp_path):
    import sentencepiece

    path, all_rows = folder
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    extra = spark.createDataFrame([(110, "twice", None, None, 1), (110, "twice", None, None, 1), (None, "no id", None, None, 1)], docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")).repartition(1)
    docs = docs.unionByName(extra)
    docs.write.parquet(f"file://{tmp_path}/in")
    docs = spark.read.parquet(f"file://{tmp_path}/in")
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, common.table(spark, path, "labels"))
    gone = {(r.doc_id, r.text) for r in toxicity.score_documents(docs, model).where("toxic_rejected").collect()}

    def ran(name):
        nonlocal docs
        steps[name](spark, docs, path).write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "sentencepiece":
            assert docs.columns == before.columns
        return docs.collect()

    kept = [x for x in kept if x not in gone]
    assert Counter((r.doc_id, r.text) for r in ran("toxicity")) == Counter(kept) and gone
    want = Counter((None if k == -(1 << 63) else k, t) for (k, t, *_), m in plain.plain_lines([(-(1 << 63) if k is None else k, t) for k, t in kept]).items() for _ in range(m))
    got = ran("line_dedup")
    assert Counter((r.doc_id, r.text) for r in got) == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    classes = {}
    numbered = [((1 << 62) if r.doc_id is None else r.doc_id, r.text) for r in got]
    for (k, c), _ in plain.plain_classes(numbered).items():
        classes.setdefault(c, set()).add(k)
    one = ran("near_dedup")
    assert len(one) == len(classes) and {r.doc_id for r in one if r.doc_id is not None} <= set(classes)
    clean = ran("decontaminate")
    hits = {(r.doc_id, r.text): plain.plain_hits(r.text, ITEMS)[:2] for r in one}
    assert {(r.doc_id, r.text) for r in clean} == {x for x, (n, hit) in hits.items() if not (hit and 20 * hit >= n)} and len(clean) < len(one)
    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    ids = {r.doc_id: library.encode(r.text or "", add_bos=True, add_eos=True) for r in clean}
    last = ran("sentencepiece")
    assert {r.doc_id: (r.n_tokens, r.piece_ids, r.decoded_sha256) for r in last} == {k: (len(x), x, sha(library.decode(x))) for k, x in ids.items()}


def test_stages_on_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 0")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, folder[0]).count() == 0, name


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.staging_root(Session())


def test_op2_tells_toxic_documents_apart():
    """Held-out quality on the given tables: ranking and decisions of documents whose labels were not learnt from."""
    import os

    from pyspark.sql import SparkSession

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables here")
    spark = SparkSession.getActiveSession()
    labels = common.table(spark, sf, "labels").select("doc_id", "toxic").where("toxic IS NOT NULL")
    rows = [tuple(r) for r in queries.op2_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()]
    bad, good = [s for t, s, _ in rows if t == 1], [s for t, s, _ in rows if t == 0]
    assert len(bad) >= 5 and len(good) >= 50
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.9 and sum(t == p for t, _, p in rows) / len(rows) > 0.9, (auc, len(bad), len(good))
