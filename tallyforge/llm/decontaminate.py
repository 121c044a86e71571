"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of all benchmark items (13 consecutive words; an item of fewer words, but not none, is one window of its own length) are hashed and sent to the workers. Each text is cut into words, words outside the benchmark's vocabulary are ruled out first, windows of the rest are looked up by hash, and hits are verified word by word.

What is sent is measured before: items are cut into pieces (overlapping, so that no window is lost), equal pieces of an item count once, and a piece's windows and words are reckoned in bytes. Where all of them pass BYTES_AT_ONCE, pieces are dealt into blocks below that bound by their hash, and the texts are scanned once for each block: texts are written once, with a number for each row, and a scan writes the numbers and hits of the rows that it hits, before the next block's windows are sent. The driver never holds more than one block and a number for each block; a bound below a single piece is refused.

Defined cases: a null text has no words, and neither has a null item; texts are scanned whole; an item without an id counts for nothing; repeated items count each by its own id, repeated documents each alike; empty tables give an empty result or no hits; other columns pass through, except those named as a result column, which the result replaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, stage

N = 13
#: Bytes of windows and words that are sent to the workers at once (and held by the driver).
BYTES_AT_ONCE = 128 << 20
#: Windows of a piece of an item.
PIECE = 10_000
#: What a piece, a window (its hash, owner and sorting, without its word numbers), and a word (its bytes object, number and place in the dictionary, without its letters) take, at least as much as measured.
PIECE_BYTES, WINDOW_BYTES, WORD_BYTES = 600, 48, 220

# A word is a run of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased; in UTF-8 these are digits, a-z and all bytes from 0x80.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWERED).split()


class Windows:
    """The windows of some items: word ids and, for each length, the windows sorted by hash beside their words and items."""

    def __init__(self, items: Iterable[tuple[object, str]], n: int = N) -> None:
        self.ids: dict[bytes, int] = {}
        self.items: list[str] = []
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text or "")], np.int32)
            if size := min(n, len(words)):
                rows.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(words, size), len(self.items)))
                self.items.append(str(item))
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in sorted(rows.items()):
            words = np.concatenate([w for w, _ in found])
            owner = np.repeat(np.array([k for _, k in found], np.int32), [len(w) for w, _ in found])
            hashes = self.hash(words.T.astype(np.uint64))
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = hashes[order], words[order], owner[order]

    @staticmethod
    def hash(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, the merged runs of words inside windows, and the items with windows there."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1  # a stop between texts
        total = int((sizes + 1).sum())
        flat = np.zeros(total, np.int64)
        get = self.ids.get
        for at, ws in zip(first.tolist(), split):
            flat[at : at + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
        seen = np.r_[0, np.cumsum(flat > 0)]
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for size, (hashes, windows, owner) in self.by_size.items():
            if total < size:
                continue
            at = np.flatnonzero(seen[size:] - seen[:-size] == size)
            if not at.size:
                continue
            h = self.hash(np.stack([flat[at + k] for k in range(size)]).astype(np.uint64))
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            pair = np.repeat(np.arange(len(at)), n)
            window = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(pair))
            same = (flat[at[pair][:, None] + np.arange(size)] == windows[window]).all(1)
            pair, window = pair[same], window[same]
            doc = np.searchsorted(first, at, "right") - 1
            for d, k in set(zip(doc[pair].tolist(), owner[window].tolist())):
                items[d].add(self.items[k])
            for d, k in zip(doc[np.unique(pair)].tolist(), at[np.unique(pair)].tolist()):
                start = k - int(first[d])
                runs[d].append((start, start + size))
        return [(int(n), merged(r), sorted(i)) for n, r, i in zip(sizes, runs, items)]


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each run."""
    if not runs:
        return text
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = [], 0
    for s, e in runs:
        out.append(text[at : words[s][0]])
        at = words[e - 1][1]
    return "".join([*out, text[at:]])


RUNS, ITEMS = "array<struct<start:bigint,end:bigint>>", "array<string>"


def reckoned(words: list[bytes], n: int) -> int:
    """Bytes that a piece takes in Windows, at most: its words might all be new."""
    size = min(n, len(words))
    return PIECE_BYTES + max(1, len(words) - n + 1) * (WINDOW_BYTES + 8 * size) + sum(WORD_BYTES + len(w) for w in set(words))


def pieces(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, text and bytes (reckoned()) of the items, each cut into pieces of at most PIECE windows; neighbours share n - 1 words. Equal ones of an item are one."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for x in batches:
            rows = []
            for item, text in zip(x.column("item_id").to_pylist(), x.column("text").to_pylist()):
                words = words_of(text)
                for k in range(0, max(1, len(words) - n + 1), PIECE):
                    part = words[k : k + PIECE + n - 1]
                    if part:
                        rows.append((item, b" ".join(part).decode(), reckoned(part, n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["item_id", "text", "bytes"])

    small_batches(benchmark.sparkSession)
    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    return source.mapInArrow(cut, "item_id string, text string, bytes bigint").dropDuplicates(["item_id", "text"])


def item_blocks(benchmark: DataFrame, n: int, at_once: int) -> list[DataFrame]:
    """The pieces of all items, in tables of at most at_once bytes each."""
    cut = stage(pieces(benchmark, n), "items")
    total, largest = cut.agg(F.sum("bytes"), F.max("bytes")).head()
    if (total or 0) <= at_once:
        return [cut]
    if largest > at_once:
        raise ValueError(f"a piece of {PIECE} windows takes {largest} bytes, more than the {at_once} that may be sent at once")
    blocks = -(-2 * total // at_once)
    while True:  # pieces differ, so that their hashes part them at last
        dealt = cut.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        sizes = dict(dealt.groupBy("block").agg(F.sum("bytes")).collect())  # a number for each block
        if max(sizes.values()) <= at_once:
            return [dealt.where(F.col("block") == b).drop("block") for b in sorted(sizes)]
        blocks *= 2


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N, keep: list[str] | None = None, at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """docs with n_words, hit_runs (array of struct start, end: merged runs of hit words, end exclusive) and hit_items (array of item ids as strings, sorted)."""
    spark = docs.sparkSession
    columns = docs.columns if keep is None else keep
    keep = [c for c in columns if c not in ("n_words", "hit_runs", "hit_items")]
    blocks = item_blocks(benchmark, n, at_once)

    def scanned(source: DataFrame, block: DataFrame, carry: list[str]) -> tuple[DataFrame, object]:
        items = block.select("item_id", "text").collect()  # at most at_once bytes with all that is made of them
        shared = spark.sparkContext.broadcast(Windows(items, n))

        def batch(texts: list[str]) -> dict[str, pa.Array]:
            found = shared.value.scan(texts)
            return {
                "n_words": pa.array([x[0] for x in found], pa.int64()),
                "hit_runs": pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "hit_items": pa.array([x[2] for x in found], pa.list_(pa.string())),
            }

        return map_texts(source, batch, f"n_words bigint, hit_runs {RUNS}, hit_items {ITEMS}", text, carry), shared

    if len(blocks) == 1:
        return scanned(docs, blocks[0], keep)[0].select(*keep, "n_words", "hit_runs", "hit_items")
    row = "_tf_row"
    numbered = stage(docs.select(*dict.fromkeys([*keep, text])).withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits, counts = [], None
    for block in blocks:
        one, shared = scanned(numbered, block, [row])
        one = stage(one.where(F.lit(counts is None) | (F.size("hit_runs") > 0)), "scanned")  # the first scan counts the words of all rows
        shared.destroy()  # written: no later task needs the windows
        counts = one.select(row, "n_words") if counts is None else counts
        hits.append(one.where(F.size("hit_runs") > 0).select(row, "hit_runs", "hit_items"))
    together = hits[0]
    for more in hits[1:]:
        together = together.unionByName(more)
    together = together.groupBy(row).agg(F.flatten(F.collect_list("hit_runs")).alias("_tf_runs"), F.flatten(F.collect_list("hit_items")).alias("_tf_items"))  # a list for each block
    empty = lambda kind: F.expr("array()").cast(kind)
    out = numbered.join(counts, row).join(together, row, "left").withColumns({"_tf_runs": F.coalesce("_tf_runs", empty(RUNS)), "_tf_items": F.coalesce("_tf_items", empty(ITEMS))})
    # runs of several blocks are merged: fold the sorted runs, joining those that touch
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        F.array_sort("_tf_runs"),
        empty(RUNS),
        lambda acc, r: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= r["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r))),
    )
    return out.select(*keep, "n_words", F.when(F.size("_tf_runs") > 1, joined).otherwise(F.col("_tf_runs")).alias("hit_runs"), F.array_sort(F.array_distinct("_tf_items")).alias("hit_items"))


def judged(found: DataFrame) -> DataFrame:
    """find_windows() with n_hit (hit words) and contaminated (some, and at least a twentieth of the words)."""
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """find_windows(keep with text): text loses its hit runs."""

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts, runs):
        import pandas as pd

        return pd.Series([t if t is None else without(t, [(int(x["start"]), int(x["end"])) for x in r]) for t, r in zip(texts, runs)])

    return found.withColumn(text, F.when(F.size("hit_runs") > 0, cut(text, "hit_runs")).otherwise(F.col(text)))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
