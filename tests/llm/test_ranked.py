"""Block-Max WAND, against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries, ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    """(item, rank, doc_id, score) of every item row."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        weight = {t: times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, times in asked.items() if t in df}
        scored = []
        for d, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // total
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item, rank, d if there else None, -score) for rank, (score, there, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    common = [f"w{k}" for k in range(40)]
    rare = [f"rare{k}é" for k in range(400)]
    text = lambda size: " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(size))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(40)]  # copies that tie
    docs += [(3, docs[3][1]), (None, docs[3][1]), (9001, None), (9002, ""), (9003, "!!! ?"), (9004, text(20_000)), (9005, "W1 w1 W1-w2;RARE1É")]
    items = [(k, text(12)) for k in range(12)] + [(20, docs[3][1]), (20, docs[3][1] + " more"), (21, None), (22, ""), (23, "nowhere"), (24, "w1 " * 30), (25, rare[0]), (26, text(300))]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, items = corpus(random.Random(4), 1500)
    path = f"file://{tmp_path_factory.mktemp('ranked')}"
    spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, segment int, term string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_all_scores(spark, tables):
    path, docs, items = tables
    got = queries.op11_ranked(spark, path)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert as_rows(got) == plain_search(docs, items)


@pytest.mark.parametrize(("block", "bytes_", "at_once", "k"), [(2, 4_000, 100_000, 3), (5, 30_000, 60, 20), (64, 1, 300, 1)])
def test_small_blocks_segments_and_sets(spark, tables, tmp_path, block, bytes_, at_once, k):
    path, docs, items = tables
    some = [x for x in docs if (x[0] or 0) % 3 == 0]
    part = spark.read.parquet(f"{path}/documents.parquet").where(F.coalesce("doc_id", F.lit(0)) % 3 == 0)
    ranked.write_index(part, f"file://{tmp_path}/index", block=block, segment_bytes=bytes_)
    index = ranked.read_index(spark, f"file://{tmp_path}/index")
    asked = spark.read.parquet(f"{path}/benchmark.parquet")
    assert as_rows(ranked.search(index, asked, "item_id", k=k, block=block, at_once=at_once)) == plain_search(some, items, k)


def test_sets_hold_whole_queries_below_the_bound(spark):
    rows = spark.createDataFrame([(q, f"t{k}", 1) for q in range(50) for k in range(10)], "query long, term string, n long")
    sets = ranked.query_sets(rows, 60)
    sizes = [s.count() for s in sets]
    assert max(sizes) <= 60 and sum(sizes) == 500 and sum(s.select("query").distinct().count() for s in sets) == 50


def one_segment(docs, items, block=8):
    rows = list(ranked.indexed(pa.array([t or "" for _, t in docs], pa.string()), pa.array([d for d, _ in docs], pa.int64()), 0, block))
    head, lists = rows[0], pa.Table.from_batches(rows[1:]).combine_chunks()
    n, total = head["df"][0].as_py(), head["n_terms"][0].as_py()
    df = dict(zip(lists["term"].to_pylist(), lists["df"].to_pylist()))
    asked = [(q, t, c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for q, text in items for t, c in Counter(terms(text)).items() if t in df]
    set_ = ranked.Queries(asked)
    held = lists.filter(pa.array([t in set_.term for t in lists["term"].to_pylist()]))
    columns = [held[c].combine_chunks() if isinstance(held[c], pa.ChunkedArray) else held[c] for c in ("skips", "pairs", "packed")]
    return ranked.Segment(set_, held["term"].to_pylist(), *columns, head["lengths"].flatten().to_numpy(), n, total, block), lists


def test_blocks_keep_postings_and_their_exact_maxima():
    docs, items = corpus(random.Random(6), 700)
    segment, lists = one_segment(docs, [(0, " ".join(t for _, x in docs for t in terms(x)))])
    segment.decompress(np.arange(len(segment.key)))
    assert (segment.value.max(1) == segment.most).all()
    counts = [Counter(terms(t)) for _, t in docs]
    names = lists["term"].to_pylist()
    for k, name in enumerate(names):
        found = segment.docs[segment.begin[k] : segment.end[k]]
        assert found[found < len(docs)].tolist() == [d for d, c in enumerate(counts) if name in c]


def test_blocks_below_the_threshold_stay_compressed():
    """One word is frequent only in documents that lie together; elsewhere its blocks can't reach the threshold."""
    docs = [(k, "needle " * (40 if 320 <= k < 330 else 1) + f"other{k} filler text") for k in range(640)] + [(1000 + k, "no such word") for k in range(640)]
    segment, _ = one_segment(docs, [(0, "needle")])
    row, doc, score = segment.search(5, np.zeros(1, np.int64))
    best = sorted(zip(-score, doc))[:5]
    assert all(320 <= d < 330 for _, d in best)
    segment, _ = one_segment(docs, [(0, "needle")])
    segment.search(5, np.array([-best[-1][0]]))
    assert segment.ready.sum() <= 3 < len(segment.ready)


def test_empty(spark, tables, tmp_path):
    path, docs, items = tables
    part = spark.read.parquet(f"{path}/documents.parquet")
    asked = spark.read.parquet(f"{path}/benchmark.parquet")
    for name, some, questions in (("a", part.where("doc_id < 0"), asked), ("b", part.where("doc_id IN (9001, 9002, 9003)"), asked), ("c", part, asked.where("item_id < 0"))):
        ranked.write_index(some, f"file://{tmp_path}/{name}")
        assert ranked.search(ranked.read_index(spark, f"file://{tmp_path}/{name}"), questions, "item_id").collect() == []
