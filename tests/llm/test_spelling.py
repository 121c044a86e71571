"""Spelling variants, against plain comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import queries, spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, ratio=10):
    words = sorted(counts)
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(close[w]), counts[form[w]] if form[w] else None))
    return out


def plain_counts(docs):
    seen = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                seen[w] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def some_words(rng, n, letters="abcé"):
    out = set()
    while len(out) < n:
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 11)))
        out.add(base)
        for _ in range(3):
            k = rng.randrange(len(base) + 1)
            w = rng.choice([base[:k] + base[k + 1 :], base[:k] + rng.choice(letters) + base[k:], base[:k] + rng.choice(letters) + base[k + 1 :]])
            if len(w) >= 7:
                out.add(w)
    return sorted(out)


def variants_of(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return {tuple(r) for r in spelling.variants(words, **options).collect()}


@pytest.mark.parametrize("group", (4_000, 30, 1))
def test_variants_equal_all_comparisons(spark, group):
    """With groups halved down to single positions too."""
    rng = random.Random(group)
    words = some_words(rng, 350) + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 150]
    counts = {w: int(10 ** (rng.random() * 5)) + 2 for w in words}
    assert variants_of(spark, counts, group=group) == plain_variants(counts)


def test_ties_and_chains(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdefi": 20, "abcdxfh": 200, "abcdxfhh": 2000, "lonelyword": 7, "abcdefgg": 19}
    got = {r[0]: r for r in variants_of(spark, counts)}
    assert got["abcdefg"] == ("abcdefg", "abcdefh", "abcdxfhh", 2, 3, 20)
    assert got["lonelyword"] == ("lonelyword", None, "lonelyword", 7, 0, None) and got["abcdefi"][2] == "abcdefi"
    assert set(got.values()) == plain_variants(counts)


def test_groups_stay_below_the_bound(spark):
    """A third of the vocabulary shares its first half, another third its second half."""
    rng = random.Random(3)
    tail = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    words = sorted({"prefixed" + tail() for _ in range(700)} | {tail() + "suffixed" for _ in range(700)} | {tail() + tail() for _ in range(700)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    sizes = spelling.grouped(table, group=50).groupBy("key").count()
    assert sizes.where("count > 50").count() == 0
    assert variants_of(spark, dict.fromkeys(words, 3), group=50) == plain_variants(dict.fromkeys(words, 3))


def test_each_pair_is_found_once():
    rng = random.Random(5)
    words = some_words(rng, 300, "ab")
    found = Counter()
    for c in range(7, 13):
        mine = [w for w in words if len(w) in (c, c + 1)]
        for a, b in ((0, (c + 1) // 2), ((c + 1) // 2, c + 1)):
            by = {}
            for w in mine:
                by.setdefault((w[:a], w[len(w) - max(0, c - b) :] if c > b else ""), []).append(w)
            for some in by.values():
                if len(some) > 1:
                    full = lambda x: np.full(len(some), x)  # noqa: B023, E731
                    i, j = spelling.Trie(pa.array(some), full(0), full(c), full(a), full(b)).pairs()
                    found.update(frozenset((some[p], some[q])) for p, q in zip(i.tolist(), j.tolist()))
    assert set(found.values()) == {1} and set(found) == {frozenset((v, w)) for v in words for w in words if near(v, w)}


def test_query_equals_plain_counts(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["Signature", "reference", "Übermäßig", "übermäßig", "documents", "ordinary", "señorita", "SEÑORITA", "abc", "exactly"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))) + rng.choice(["", "\nx-y_9 É", "日本signature"])) for k in range(120)]
    docs += [(7, docs[7][1]), (None, "reference reference"), (500, None), (501, ""), (502, "signature" * 3_000)]
    spark.createDataFrame([(k, t, "n") for k, t in docs], "doc_id long, text string, n string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op12_spelling(spark, f"file://{tmp_path}")
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = plain_variants(plain_counts(docs))
    assert {tuple(r) for r in got.collect()} == want and any(r[1] for r in want)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert queries.op12_spelling(spark, f"file://{tmp_path}").collect() == []
