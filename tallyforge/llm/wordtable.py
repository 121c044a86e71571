"""Ids of distinct words, remembered in arrays, and laid out for whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers; words that are laid out at once.
CACHE_WORDS, WORDS_AT_ONCE = 500_000, 1 << 18


class WordTable:
    """The ids of the words that this worker has met. A chunk's distinct words are found by Arrow's hash table, those not met are encoded together, and all ids are laid out by array gathers. Beyond CACHE_WORDS, the words that only one chunk had are forgotten."""

    def __init__(self) -> None:
        self.forget()

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of words in some order, all their ids in that order, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        self.keys, self.again = pa.array([], pa.string()), np.zeros(0, bool)
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[str]) -> np.ndarray:
        """Adds words; returns their places among the keys."""
        order, flat, sizes = self.encoded(words)
        places = np.empty(len(words), np.int64)
        places[order] = len(self.keys) + np.arange(len(words))
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.keys = pa.concat_arrays([self.keys, pa.array(words, pa.string()).take(pa.array(order))])
        self.again = np.r_[self.again, np.zeros(len(words), bool)]
        return places

    def shrink(self) -> None:
        keep = self.again
        if keep.sum() > CACHE_WORDS // 2:
            self.forget()
            return
        self.flat = self.flat[np.repeat(keep, self.sizes)]
        self.keys, self.sizes, self.again = self.keys.filter(pa.array(keep)), self.sizes[keep], np.zeros(int(keep.sum()), bool)

    def places(self, words: pa.StringArray) -> np.ndarray:
        """The places of distinct words among the keys; new ones are learnt."""
        if len(self.keys) > CACHE_WORDS:
            self.shrink()
        found = pc.index_in(words, value_set=self.keys)
        unknown = found.is_null()
        out = found.fill_null(0).to_numpy().astype(np.int64)
        known = ~unknown.to_numpy(zero_copy_only=False)
        self.again[out[known]] = True
        if not known.all():
            out[~known] = self.learn(words.filter(unknown).to_pylist())
        return out

    def ids(self, words: pa.StringArray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each text has. cuts: where each text's words begin, and where the last ones end."""
        coded = words.dictionary_encode()
        at = self.places(coded.dictionary)
        sizes = self.sizes[at]
        first = (np.cumsum(self.sizes) - self.sizes)[at]
        word = coded.indices.to_numpy()
        ends = np.r_[0, np.cumsum(sizes[word])]
        ids = np.empty(int(ends[-1]), np.uint32)
        for k in range(0, len(word), WORDS_AT_ONCE):
            some = word[k : k + WORDS_AT_ONCE]
            a, b = ends[k], ends[k + len(some)]
            ids[a:b] = self.flat[np.repeat(first[some] - ends[k : k + len(some)], sizes[some]) + np.arange(a, b)]
        return ids, np.diff(ends[cuts - cuts[0]])


def chunks(batches: Iterator[pa.RecordBatch], size: int, column: int) -> Iterator[pa.RecordBatch]:
    """The batches, brought together to some size in bytes of a column."""
    ready, n = [], 0
    for x in batches:
        ready.append(x)
        n += x.column(column).nbytes
        if n >= size:
            yield joined(ready)
            ready, n = [], 0
    if ready:
        yield joined(ready)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], schema=batches[0].schema)
