"""Text expressions: hashes, ids, required names, paths, similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

# Names that assertions call without needing them defined.
KNOWN_NAMES = (
    "assert", "print", "len", "str", "int", "float", "list", "dict", "set", "tuple", "sorted", "abs", "round", "range", "isinstance", "type", "max", "min", "sum", "any", "all", "bool", "repr", "hash", "iter", "next", "map", "filter",
    "zip", "enumerate", "reversed", "open", "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "pytest", "raises", "approx", "frozenset", "bytes", "chr", "ord", "divmod", "pow", "format",
    "callable", "getattr", "hasattr", "math", "np", "array", "Decimal", "Fraction", "datetime", "date", "timedelta", "deque", "Counter", "defaultdict", "OrderedDict",
)
MOST_NAMES = 6
# Sections that an instance id is made of.
INSTANCE_ID = r"^([^_]+)__([^.]+)\.([0-9a-f]+)\.([^_]+(?:_[^_]+)*)__(\w+)$"


def sha16(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def squashed(x: Column) -> Column:
    """Runs of white space as one space, outer ones removed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def has_hangul(x: Column) -> Column:
    return x.rlike("[가-힣]")


def plain_number(x: Column, digits: int) -> Column:
    """A number as text, rounded, with at least one decimal place and never in powers of ten (a double below 0.001 is cast to 9.0E-4)."""
    return F.regexp_replace(F.round(x, digits).cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")


def token_estimate(x: Column, chars_per_token: float = 3.5) -> Column:
    return F.length(x) / chars_per_token


def instance_id_parts(x: Column) -> Column:
    """struct(owner, repo, commit, kind, hash) of owner__repo.commit.kind__hash; empty strings where an id has another form."""
    return F.struct(*[F.regexp_extract(x, INSTANCE_ID, k + 1).alias(name) for k, name in enumerate(("owner", "repo", "commit", "kind", "hash"))])


def required_names(harness: Column, entry_point: Column, assertions: Column) -> Column:
    """Up to six names that hidden tests need: imported from the solution, or the entry points and then the names that assertions call."""
    joined = F.array_join(F.coalesce(assertions, F.array().cast("array<string>")), "\n")
    imported = F.flatten(F.transform(F.regexp_extract_all(joined, F.lit(r"(?m)^\s*from solution import ([^\n]+)"), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda n: F.substring_index(F.trim(n), " as ", 1))))
    called = F.filter(F.regexp_extract_all(joined, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda n: ~n.isin(*KNOWN_NAMES))
    named = F.transform(F.split(F.coalesce(entry_point, F.lit("")), ","), F.trim)
    names = F.when(harness == "pytest", imported).when(harness == "function", F.concat(named, called)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(names, lambda n: n != "")), 1, MOST_NAMES)


def names_line(names: Column, lang: Column) -> Column:
    head = F.when(lang == "ko", "\n\n테스트가 사용하는 이름을 정확히 이 이름으로 정의하세요: ").otherwise("\n\nThe hidden tests use exactly these names; define them: ")
    return F.when(F.size(names) > 0, F.concat(head, F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", "))).otherwise(F.lit(""))


def shingles(x: Column, n: int = 5) -> Column:
    """The distinct runs of n words of a text; a shorter text is one run."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.array_distinct(let(F.filter(F.split(x, r"\s+"), lambda w: w != ""), runs))


def shingle_hashes(x: Column, n: int = 5) -> Column:
    """The distinct hashes of a text's shingles()."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " ")))
    return F.array_distinct(let(F.filter(F.split(x, r"\s+"), lambda w: w != ""), runs))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets given as arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def common_letters(x: str, y: str) -> int:
    """How many letters (code points) two texts have in common, each as often as both have it."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    if not len(a) or not len(b):
        return 0
    if (size := int(max(a.max(), b.max())) + 1) > 1 << 14:
        a, b = np.split(np.unique(np.r_[a, b], return_inverse=True)[1], [len(a)])
        size = int(max(a.max(), b.max())) + 1
    return int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum())


def length_bound(a: Column, b: Column) -> Column:
    """What sequence_ratio() of two texts can be at most, by their lengths; 1 for two empty ones."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)


def letter_bound(a: Column, b: Column) -> Column:
    """What it can be at most by the letters that both have, however they are ordered; 1 for two empty texts."""

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series([2.0 * common_letters(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(left, right)], dtype="float64")

    return run(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


#: Product of lengths up to which difflib itself is the faster way to matching blocks.
SMALL = 20_000


def longest_block(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Start in a, start in b and size of the longest run that both have; of several the first in a, then in b."""
    ends = np.zeros(len(b) + 1, np.int32)
    best = (0, 0, 0)
    for i, letter in enumerate(a.tolist()):
        ends[1:] = (ends[:-1] + 1) * (b == letter)
        if (size := int(ends.max())) > best[2]:
            best = (i + 1 - size, int(ends.argmax()) - size, size)
    return best


def matching_ratio(x: str, y: str) -> float:
    """What difflib's SequenceMatcher without junk gives; rows of the table of runs are arrays."""
    if x == y:
        return 1.0
    if len(x) * len(y) <= SMALL:
        return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    matched, parts = 0, [(a, b)]
    while parts:
        a, b = parts.pop()
        i, j, size = longest_block(a, b) if len(a) and len(b) else (0, 0, 0)
        if size:
            matched += size
            parts += [(a[:i], b[:j]), (a[i + size :], b[j + size :])]
    return 2.0 * matched / (len(x) + len(y))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts by matching blocks: twice the letters in them over all letters. Its work grows with the product of the lengths; the two bounds above rule out most pairs first."""

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series([matching_ratio(x or "", y or "") for x, y in zip(left, right)], dtype="float64")

    return run.asNondeterministic()(a, b)  # else a filter by it would have it computed twice
