"""A static range asymmetric numeral system over token ids, in numpy.

A frequency table maps each id that occurs to a share of 2^PRECISION. A block of ids is coded in LANES interleaved states of 64 bits that renormalise by 32-bit words: step t codes ids t*LANES to t*LANES + LANES - 1, one in each lane, and the words of a step are written in lane order. The coder walks a block from its last step to its first, so the decoder reads forward. Every CHECKPOINT steps the decoder's states and place in the words are noted: decoding can start at each such checkpoint, and all segments between checkpoints, of any number of blocks, are decoded at once as rows of one array.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

PRECISION, LANES, CHECKPOINT = 20, 32, 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64((1 << PRECISION) - 1)
MAGIC = b"TFR1"


@dataclass
class Table:
    """Shares of 2^PRECISION for ids 0 to len(freq) - 1; 0 for those that don't occur."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.start = np.r_[0, np.cumsum(self.freq)[:-1]].astype(np.uint64)
        self.freq = self.freq.astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def __getstate__(self):
        return {"freq": self.freq, "start": self.start, "_symbol": None}


def quantised(counts: np.ndarray) -> Table:
    """The table for these counts: at least 1 for each id that occurs, 2^PRECISION in all; rounding is settled among the most frequent ids, by the lowest id in ties."""
    counts = np.asarray(counts, np.float64)
    total = counts.sum()
    if not total:
        return Table(np.zeros(len(counts), np.int64))
    if (counts > 0).sum() > 1 << PRECISION:
        raise ValueError("more ids than the table has places")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts / total * (1 << PRECISION))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    k = 0
    while (left := (1 << PRECISION) - int(freq.sum())) != 0:
        at = order[k % len(order)]
        step = max(1, abs(left) // 2) if k < 64 else 1
        if left > 0:
            freq[at] += min(step, left)
        elif freq[at] > 1:
            freq[at] -= min(step, -left, int(freq[at]) - 1)
        k += 1
    return Table(freq)


def encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """The coded form of each block of ids."""
    if not blocks:
        return []
    steps = np.array([-(-len(b) // LANES) for b in blocks])
    order = np.argsort(-steps, kind="stable")
    most = int(steps.max())
    pad = int(np.argmax(table.freq))
    ids = np.full((len(blocks), most, LANES), pad, np.int64)
    for row, k in enumerate(order):
        ids[row].reshape(-1)[: len(blocks[k])] = blocks[k]
    active = np.searchsorted(-steps[order], -np.arange(1, most + 1), "right")  # rows with a step t, for each t
    state = np.full((len(blocks), LANES), LOW, np.uint64)
    words = np.zeros((most, len(blocks), LANES), np.uint32)
    wrote = np.zeros((most, len(blocks), LANES), bool)
    saved: list[list[tuple[int, np.ndarray]]] = [[] for _ in blocks]
    for t in range(most - 1, -1, -1):
        n = active[t]
        x, s = state[:n], ids[:n, t]
        f = table.freq[s]
        full = x >= f << np.uint64(63 - PRECISION)
        wrote[t, :n] = full
        words[t, :n] = x.astype(np.uint32)
        x = np.where(full, x >> WORD, x)
        q = x // f
        state[:n] = (q << np.uint64(PRECISION)) + (x - q * f) + table.start[s]
        if t % CHECKPOINT == 0:
            for row in range(n):
                saved[row].append((t, state[row].copy()))
    out: list[bytes] = [b""] * len(blocks)
    for row, k in enumerate(order):
        m = wrote[: steps[k], row]
        body = words[: steps[k], row][m].astype("<u4").tobytes()
        upto = np.r_[0, np.cumsum(m.sum(1))]
        marks = b"".join(struct.pack("<II", t, int(upto[t])) + s.astype("<u8").tobytes() for t, s in reversed(saved[row]))
        payload = marks + body
        raw = blocks[k].astype("<u4").tobytes()
        out[k] = MAGIC + struct.pack("<IIIII", len(blocks[k]), len(saved[row]), len(body) // 4, zlib.crc32(payload), zlib.crc32(raw)) + payload
    return out


def parsed(block: bytes) -> tuple[int, int, list[tuple[int, int, np.ndarray]], np.ndarray]:
    """Number of ids, crc32 of the ids, checkpoints (step, word, states) and words of a coded block; fails if it is damaged."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n, marks, words, crc, ids_crc = struct.unpack_from("<IIIII", block, 4)
    payload = block[24:]
    if zlib.crc32(payload) != crc:
        raise ValueError("a block is damaged: its checksum doesn't match")
    size = 8 + 8 * LANES
    points = [(*struct.unpack_from("<II", payload, k * size), np.frombuffer(payload, "<u8", LANES, k * size + 8)) for k in range(marks)]
    return n, ids_crc, points, np.frombuffer(payload, "<u4", words, marks * size)


def decode(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each coded block; fails if one is damaged or the table is another."""
    heads = [parsed(b) for b in blocks]
    segments = []  # (block, first step, steps, word, states)
    for k, (n, _, points, _) in enumerate(heads):
        ends = [p[0] for p in points[1:]] + [-(-n // LANES)]
        segments += [(k, t, e - t, w, s) for (t, w, s), e in zip(points, ends)]
    out = [np.empty((-(-h[0] // LANES), LANES), np.uint32) for h in heads]
    if segments:
        segments.sort(key=lambda s: -s[2])
        bases = np.r_[0, np.cumsum([len(h[3]) for h in heads])]
        words = np.concatenate([*[h[3] for h in heads], np.zeros(LANES, "<u4")]).astype(np.uint64)
        count = np.array([s[2] for s in segments])
        most = int(count[0])
        active = np.searchsorted(-count, -np.arange(1, most + 1), "right")
        state = np.stack([s[4] for s in segments]).astype(np.uint64)
        at = np.array([bases[s[0]] + s[3] for s in segments])
        got = np.empty((most, len(segments), LANES), np.uint32)
        for t in range(most):
            n = active[t]
            x = state[:n]
            slot = x & MASK
            s = table.symbol[slot.astype(np.int64)]
            got[t, :n] = s
            x = table.freq[s] * (x >> np.uint64(PRECISION)) + slot - table.start[s]
            need = x < LOW
            upto = np.cumsum(need, axis=1)
            word = words[np.where(need, at[:n, None] + upto - 1, 0)]
            state[:n] = np.where(need, (x << WORD) | word, x)
            at[:n] += upto[:, -1]
        for row, (k, first, steps, _, _) in enumerate(segments):
            out[k][first : first + steps] = got[:steps, row]
    ids = [o.reshape(-1)[: h[0]] for o, h in zip(out, heads)]
    for x, h in zip(ids, heads):
        if zlib.crc32(x.astype("<u4").tobytes()) != h[1]:
            raise ValueError("decoded ids don't match their checksum")
    return ids
