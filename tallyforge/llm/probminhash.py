"""ProbMinHash of weighted word shingles, vectorised over a batch of texts.

Shingles (five words; a text of fewer words, but not none, has one shingle of all its words) are weighted by how often a text has them: 1 + ln(count), so that a repeated passage does not drown the rest. Each shingle is a Poisson process whose rate is its weight and whose arrivals, drawn from its own hash, fall on random registers; a register keeps the first arrival on it and the shingle that it came from. A shingle is done as soon as an arrival is later than all registers of its text, so most take a single draw. Two texts agree in a register with the probability Jaccard similarity of their weighted shingles; with all weights 1 that is the Jaccard similarity of their sets.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .decontaminate import LOWERED

WORDS, REGISTERS = 5, 100
BYTES_AT_ONCE = 1 << 19
MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
#: Odd constants for the words of a shingle.
COEFFICIENTS = np.array([int.from_bytes(hashlib.blake2b(b"word %d" % k, digest_size=8).digest(), "little") | 1 for k in range(64)], np.uint64)
LOW = np.uint64((1 << 52) - 1)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser in which every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, MULT, np.uint64)], dtype=np.uint64)
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, INVERSE, np.uint64)], dtype=np.uint64)
    return _powers, _inverses


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the text of each."""
    joined = np.frombuffer(b" ".join([*texts, b""]).translate(LOWERED), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = np.r_[False, joined != 32, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    power, inverse = powers(len(joined) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(joined.astype(np.uint64) * power[: len(joined)], dtype=np.uint64)]
    return mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * COEFFICIENTS[-1]), np.searchsorted(ends, start, "right")


def weighted_shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text, ascending, and the numbers of words. At most 4,096 texts at once: a shingle keeps 52 bits of its hash below its text's place."""
    h, of = word_hashes(texts)
    counts = np.bincount(of, minlength=len(texts))
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float64), counts
    first = np.cumsum(counts) - counts
    padded = np.r_[h, np.zeros(words, np.uint64)]
    s = np.zeros(len(h), np.uint64)
    place = np.arange(len(h)) - first[of]
    for k in range(words):
        s += np.where(place + k < counts[of], padded[k : k + len(h)] * COEFFICIENTS[k], np.uint64(0))
    starts = (place + words <= counts[of]) | (place == 0)  # a short text has only its first
    s, of = mixed(s[starts]), of[starts]
    key = np.sort((of.astype(np.uint64) << np.uint64(52)) | (s & LOW))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight = 1 + np.log(np.diff(np.r_[at, len(key)]))
    key = key[at]
    return (key >> np.uint64(52)).astype(np.int64), key & LOW, weight, counts


def signatures(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers): the shingle that each register of each text kept; 0 for texts without shingles."""
    times = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    x = np.zeros(len(of))
    draw = 0
    while len(of):
        bits = mixed(shingle * np.uint64(0xD1342543DE82EF95) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        x = x - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        at = of * registers + (mixed(bits) >> np.uint64(32)).astype(np.int64) % registers
        np.minimum.at(times, at, x)
        won = times[at] == x
        kept[at[won]] = shingle[won]
        live = x <= times.reshape(n, registers).max(1)[of]
        of, shingle, weight, x = of[live], shingle[live], weight[live], x[live]
        draw += 1
    return kept.reshape(n, registers)


def probability_jaccard(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets: the sum over common shingles i of 1 / sum over all j of max(a_j / a_i, b_j / b_i). By the order of the ratios a_j / b_j, the inner sums are those of a's weights from some place on and of b's before it."""
    shared, at, to = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    a = np.r_[wa, np.zeros(len(sb) - len(to))]
    b = np.zeros(len(a))
    b[at] = wb[to]
    b[len(wa) :] = np.delete(wb, to)
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio, kind="stable")
    from_a = np.r_[0, np.cumsum(a[order][::-1])][::-1]
    upto_b = np.r_[0, np.cumsum(b[order])]
    place = np.searchsorted(ratio[order], ratio[at], "left")
    return float((1 / (from_a[place] / wa[at] + upto_b[place] / wb[to])).sum())


def bands(kept: np.ndarray, rows: int) -> np.ndarray:
    """(n, registers / rows) hashes of consecutive registers, each with its band's number in it."""
    n, registers = kept.shape
    parts = kept.reshape(n, registers // rows, rows)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(registers // rows, dtype=np.uint64) * COEFFICIENTS[60]
    for k in range(rows):
        out += mixed(parts[:, :, k]) * COEFFICIENTS[k]
    return mixed(out).view(np.int64)


def batches(texts: list[bytes], most: int = 512, size: int = BYTES_AT_ONCE):
    """Slices of texts of so many bytes and texts at most (a longer text is alone)."""
    at = 0
    while at < len(texts):
        to, n = at + 1, len(texts[at])
        while to < len(texts) and to - at < most and n + len(texts[to]) <= size:
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def word_digest(text: bytes) -> bytes:
    """16 bytes that tell texts apart by their words; texts without words by themselves."""
    words = b" ".join(text.translate(LOWERED).split())
    return hashlib.blake2b(words or b"\0" + text, digest_size=16).digest()
