"""Token-id files: tokenised documents, coded by a static range asymmetric numeral system (rans.py), in ascending doc_id order.

A token file is a folder of two tables. `table` has one row, the frequency table that all blocks share. `blocks` has a row for each block: part and block (their order is the order of doc_ids), first (ids before the block in its part), n_ids, doc_ids and lengths (the documents in it; a block holds whole documents, some BLOCK_IDS ids, or one longer document) and coded (the block's bytes, with checkpoints and checksums). Any block can be read alone, and the number of ids before it follows from first and the sums of the earlier parts, for which the coded bytes needn't be read.

Documents are tokenised once. A tokenizer that drops white space and never joins what stands on both sides of it (form checked by Words) is asked for words: a worker takes some CHUNK_BYTES of texts at once, finds their distinct words by Arrow's hash table, has the library encode those it hasn't met, many in a call, and lays out all ids by array gathers. Any other tokenizer is asked for whole texts. The ids are staged as plain integers; their counts over all documents make the frequency table; then they are dealt by ranges of doc_id, sorted and coded.

Defined cases: a null text counts as empty, and an empty text has the end id alone; whole texts are encoded; rows that tie in doc_id are ordered by their ids' checksum, and may lie in several parts; null doc_ids come first; an empty table makes an empty file; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import give_back, small_batches, stage
from .wordtable import WordTable, chunks

BLOCK_IDS, BLOCKS_AT_ONCE = 32_768, 24
#: Text that is tokenised at once (or a longer text); words in one call of the library.
CHUNK_BYTES, CALL_WORDS = 16 << 20, 300
#: Letters and then marks, of which the library always makes two words. Letters after an apostrophe may belong to it, so it isn't among the marks.
MARKED = re.compile(r"[^\W\d_]+[!-&(-/:-@\[-`{-~]+\Z")
# The normalizers and the splitting pattern of tokenizers whose words don't depend on their surroundings.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_wise(spec: dict) -> bool:
    """Whether a tokenizer (its file's content) lower-cases, cuts texts at white space, drops that, and marks the last id of each of its words."""
    normalizer, splits = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = splits[0] if splits else {}
    return (
        normalizer.get("normalizers") == NORMALIZERS
        and (first.get("type"), first.get("pattern"), first.get("invert"), first.get("behavior")) == ("Split", {"Regex": SPLITTER}, True, "Removed")
        and [(x["type"], x.get("use_regex"), x.get("add_prefix_space")) for x in splits[1:]] == [("ByteLevel", False, False)]
        and (spec["model"].get("type"), spec["model"].get("end_of_word_suffix"), spec["model"].get("dropout")) == ("BPE", "</w>", None)
        and spec.get("post_processor") is None
        and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or not re.fullmatch(r"<\|\w+\|>", x["content"]) for x in spec["added_tokens"])
    )


class Words(WordTable):
    """The tokenizer of a file that every machine has at path, and the ids of words that this worker has met."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.by_word = word_wise(json.loads(self.tokenizer.to_str()))
        self.ends = np.zeros(self.size, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((x for y in ids for x in y), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def joined(self, words: list[str], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of which the library makes `parts` words each (if it doesn't, they are encoded one by one)."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != parts * len(words) or cuts[-1] != len(ids):
            return self.each(words)
        return ids, np.diff(cuts[parts - 1 :: parts], prepend=0)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, w in enumerate(words):
            kinds[0 if w.isalpha() else 1 if MARKED.match(w) else 2].append(k)
        sizes, flat = [], []
        for parts, kind in ((1, kinds[0]), (2, kinds[1]), (0, kinds[2])):
            for at in range(0, len(kind), CALL_WORDS):
                some = [words[k] for k in kind[at : at + CALL_WORDS]]
                ids, n = self.joined(some, parts) if parts else self.each(some)
                flat.append(ids)
                sizes.append(n)
        return np.concatenate(kinds).astype(np.int64), np.concatenate(flat), np.concatenate(sizes)

    def texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole texts, and how many each has."""
        if not self.by_word:
            return self.each(texts.to_pylist())
        # what looks like a special token keeps its case, by which the library tells it
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        return self.ids(lists.flatten(), lists.offsets.to_numpy())


_words: dict[str, Words] = {}


def words_of_tokenizer(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def tokenise(texts: pa.StringArray, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts one after the other, each with the end id behind it, and where each text's begin (and the last one's end)."""
    ids, sizes = words_of_tokenizer(path).texts(texts)
    starts = np.r_[0, np.cumsum(sizes)]
    if end_id is None:
        return ids, starts
    starts += np.arange(len(starts))
    out = np.full(int(starts[-1]), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[starts[1:] - 1] = False
    out[own] = ids
    return out, starts


def widened(ids: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, text: str = "text", parts: int | None = None) -> None:
    """Writes the token file of docs to path."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(words_of_tokenizer(tokenizer_path).size, (end_id or 0) + 1)
    wide = size > 1 << 16
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches, CHUNK_BYTES, 1):
            ids, starts = tokenise(x.column("text"), tokenizer_path, end_id)
            raw, bounds = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * starts).tolist()
            kept = ids.astype("<u4" if wide else "<u2", copy=False)
            coded = pa.Array.from_buffers(pa.binary(), x.num_rows, [None, pa.py_buffer((starts * kept.itemsize).astype(np.int32)), pa.py_buffer(kept)])
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), coded, crc], names=["doc_id", "ids", "crc"])
            del ids, raw, kept, coded
        give_back()

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    staged = stage(source.mapInArrow(encode, "doc_id bigint, ids binary, crc bigint"), "ids", compression="zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for x in batches:
            total += np.bincount(widened(b"".join(x.column(0).to_pylist()), wide), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for k, n in staged.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():  # a row for each id of the vocabulary
        counts[k] = n
    table = rans.quantised(counts)
    spark.range(1).select(F.lit(table.freq.astype(np.int64).tolist()).cast("array<int>").alias("freq"), F.lit(rans.PRECISION).alias("precision")).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ready: list[tuple[list, list[np.ndarray]]] = []
        docs_in, ids_in, n_in = [], [], 0

        def rows() -> pa.RecordBatch:
            nonlocal block, first, ready
            coded = rans.encode([np.concatenate(ids) for _, ids in ready], shared.value)
            sizes = [sum(map(len, ids)) for _, ids in ready]
            starts = first + np.r_[0, np.cumsum(sizes)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ready), pa.int32()), pa.array(range(block, block + len(ready)), pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array([d for d, _ in ready], pa.list_(pa.int64())), pa.array([[len(x) for x in ids] for _, ids in ready], pa.list_(pa.int64())), pa.array(coded, pa.binary())],
                names=["part", "block", "first", "n_ids", "doc_ids", "lengths", "coded"],
            )
            block, first, ready = block + len(ready), int(starts[-1]), []
            return out

        for x in batches:
            for doc, b in zip(x.column("doc_id").to_pylist(), x.column("ids").to_pylist()):
                docs_in.append(doc)
                ids_in.append(widened(b, wide))
                n_in += len(ids_in[-1])
                if n_in >= BLOCK_IDS:
                    ready.append((docs_in, ids_in))
                    docs_in, ids_in, n_in = [], [], 0
                    if len(ready) >= BLOCKS_AT_ONCE or len(ready[-1][1]) == 1:
                        yield rows()
        if docs_in:
            ready.append((docs_in, ids_in))
        if ready:
            yield rows()

    # rows of a doc_id that repeats are told apart by their place, so that many of them are split too
    placed = staged.withColumn("row", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(parts, "doc_id", "crc", "row").sortWithinPartitions("doc_id", "crc", "row")
    ordered.select("doc_id", "ids").mapInArrow(code, "part int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, coded binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array of int; or, with digest, ids_crc32) of each document of a token file."""
    small_batches(spark)
    blocks = spark.read.schema("part int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, coded binary").parquet(f"{path}/blocks")
    freq = spark.read.parquet(f"{path}/table").head()[0]
    sums = dict(blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # a row for each part
    order = sorted(sums)
    base = dict(zip(order, np.r_[0, np.cumsum([sums[p] for p in order])].tolist()))
    shared = spark.sparkContext.broadcast((rans.Table(np.array(freq, np.int64)), base))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCKS_AT_ONCE):
                x = whole.slice(k, BLOCKS_AT_ONCE)
                docs, starts, sizes, last = [], [], [], []
                for part, first, ds, ns, ids in zip(x.column("part").to_pylist(), x.column("first").to_pylist(), x.column("doc_ids").to_pylist(), x.column("lengths").to_pylist(), rans.decode(x.column("coded").to_pylist(), table)):
                    cuts = np.r_[0, np.cumsum(ns)].astype(np.int64)
                    docs += ds
                    sizes += ns
                    starts += (before[part] + first + cuts[:-1]).tolist()
                    ids = ids.astype("<u4")
                    if digest:
                        last += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                    else:
                        last += [ids[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(last, pa.int64() if digest else pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.select("part", "first", "doc_ids", "lengths", "coded").mapInArrow(back, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<int>"))
