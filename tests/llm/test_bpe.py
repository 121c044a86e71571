"""BPE by a queue of merge ranks, against the library."""

import hashlib
import json
import random
import unicodedata

import numpy as np
import pytest

from tallyforge.llm import bpe

public = pytest.importorskip("public_tokenizers")
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = [
    "", " ", "Hello, World's 'LL don't x<|endoftext|>Y <|STARTOFTEXT|><|startoftext|>", "<|endoftext|>", "a" * 5000, "ab" * 999, "ΑΣ ΑΣΑ İstanbul ẞ é é ́x Å", "x y z\x1cq\x85r s",
    "\U0001f600 日本語テキスト 123 ４５ ½ ²", "퟿ \x00\x01 a\x0bb", "한국어", "a  b   c\n\n d \t", "  lead", "trail  ", "a՘b ࢏ \U00010f84ֺ Ᲊᲊ",
]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x300, 0x600), rng.randrange(0x1000, 0xD7FF), rng.randrange(0x10000, 0x11000), 32, 39]))
    return ODD + ["".join(pick() for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_texts_equal_the_library(name):
    own, other, texts = bpe.encoder_of(public.path(name)), library(name), odd_texts()
    ids, starts = own.encode(texts)
    back = own.decode(ids, starts)
    for k, e in enumerate(other.encode_batch(texts, add_special_tokens=False)):
        assert ids[starts[k] : starts[k + 1]].tolist() == e.ids, ascii(texts[k])
        assert back[k] == other.decode(e.ids, skip_special_tokens=False), ascii(texts[k])


def test_every_code_point_equals_the_library():
    own, other = bpe.encoder_of(public.path(FILES[0])), library(FILES[0])
    points = [f"a{chr(c)}b1{chr(c)}" for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 97)]]
    ids, starts = own.encode(points)
    for k, e in enumerate(other.encode_batch(points, add_special_tokens=False)):
        assert ids[starts[k] : starts[k + 1]].tolist() == e.ids, ascii(points[k])


def plain_merge(encoder, symbols):
    """Merges the leftmost pair of least rank, again and again."""
    symbols = list(symbols)
    while True:
        ranks = [(encoder.rank_of.get(a * encoder.size + b, 1 << 60), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return symbols
        rank, k = min(ranks)
        symbols[k : k + 2] = [encoder.made[rank]]


def test_queue_equals_plain_merges():
    rng, own = random.Random(2), bpe.encoder_of(public.path(FILES[0]))
    for n in [1, 2, 3, 400] + [rng.randrange(2, 40) for _ in range(300)]:
        word = bytes(rng.choice(b"aabent\xc3\xa9") for _ in range(n))
        symbols = [*map(own.inner.__getitem__, word[:-1]), own.last[word[-1]]]
        assert own.merge(list(symbols)) == plain_merge(own, symbols)


def test_other_files_are_refused():
    with open(public.path(FILES[0]), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"model": spec["model"] | {"dropout": 0.1}}, {"model": spec["model"] | {"unk_token": "!"}}):
        with pytest.raises(ValueError):
            bpe.Bpe(json.dumps(spec | change))


def test_words_are_forgotten_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    own = bpe.encoder_of(public.path(FILES[0]))
    own.forget()
    own.memory.clear()
    texts = [f"word{k} again" for k in range(20)]
    ids, starts = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.ids for e in library(FILES[0]).encode_batch(texts, add_special_tokens=False)] and len(own.memory) <= 3


def test_documents(spark):
    rows = [(1, "Some text, isn't it?", "clash"), (1, "Some text, isn't it?", "clash"), (2, None, None), (None, "", None), (3, "long " * 60_000, ""), (4, unicodedata.normalize("NFD", "déjà vu"), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bpe_ids string").repartition(2)
    path, other = public.path(FILES[0]), library(FILES[0])
    got = bpe.encode_documents(docs, path)
    assert got.columns == ["doc_id", "text", "bpe_ids", "bpe_text"] and got.count() == len(rows)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(docs, path).collect()}
    want = set()
    for r in got.collect():
        ids = other.encode(r.text or "", add_special_tokens=False).ids
        assert r.bpe_ids == ids and r.bpe_text == other.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.bpe_text.encode()).hexdigest()))
    assert digests == want
    assert bpe.encode_documents(docs.where("doc_id < 0"), path, decoded=False).collect() == [] and np.diff(bpe.encoder_of(path).encode([])[1]).size == 0
