"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their frequent forms, by a trie self-join with active-node sets.

A pair of words at distance one has a place, the length of its longest common prefix, and a class, the length of its shorter word. Positions of a class are cut into windows. All words of a class (those of its length, and those one longer) whose letters in front of a window and behind it are the same are a group, and a pair can only meet, and meets exactly once, in the group of its place's window. At first there are two windows: groups of the second are the subtrees below a prefix of half the length, groups of the first are those of the reversed words' trie. A word is in four groups at most, whatever the vocabulary.

In each group the trie of the letters inside the window is walked down level by level. The active nodes of a node are those within distance one: besides itself they are born where two children of a node differ (a replaced letter) or where a child stands beside its parent (an inserted one), and are handed down along equal letters. Two active terminals are a pair. All groups of a chunk are walked at once, as arrays.

Groups of more than GROUP words (many words may share a prefix) have their window halved, and so on down to one position, where a group can't hold more words than there are ways to fill two letters. So no task or group grows with the vocabulary, and no word or partner is left out.

Forms are the near words of largest count; they form trees, whose depth is at most the logarithm of the largest count, and roots are found by doubling steps.

Defined cases: a null text has no words, a null doc_id is written as nothing, whole texts are read, repeated rows count each; words of any length take part, but for those shorter than `least`; of near words of equal counts the smallest in code-point order is the form; empty tables give an empty result; other columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, stage
from .line_dedup import lowered
from .wordtable import chunks

# Fixed values of the contract: what a word is not made of, the least length and count, how much more frequent a form must be, and which occurrences lose a letter.
NOT_WORD = r"[^A-Za-zÀ-ÿ]+"
LEAST, LEAST_N, RATIO, LOSES = 7, 2, 10, 31
#: Words of a group above which its window is halved; bytes of words that are walked at once.
GROUP, CHUNK_BYTES = 4_000, 256 << 10


def occurrences(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id and word: a row for each run of letters that has `least` code points or more, A-Z lower-cased."""
    runs = docs.where(F.col(text).isNotNull()).select("doc_id", F.explode(F.split(lowered(F.col(text)), NOT_WORD, -1)).alias("word"))
    return runs.where(F.length("word") >= least)


def with_losses(word: Column, doc_id: Column, one_in: int = LOSES) -> Column:
    """The word without one letter, where the crc32 of document and word is a multiple of one_in."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(one_in)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def counted(words: DataFrame, least: int = LEAST, least_n: int = LEAST_N) -> DataFrame:
    """word and n of the words that are long and frequent enough. Counts are summed before they are dealt out, so a word that a third of the texts repeat is a row a task."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, c: class, a, b: window) with the key of their group: class and window, and what stands in front of it and behind it."""
    tail = F.greatest(F.lit(0), F.col("c") - F.col("b"))
    behind = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
    return rows.withColumn("key", F.concat_ws(":", "c", "a", "b", F.substring("word", F.lit(1), F.col("a")), behind))


def grouped(words: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """word, n, c, a, b, key: the words once for each group that they are in."""
    length = F.length("word")
    classes = words.select("word", "n", F.explode(F.array_compact(F.array(length, F.when(length > least, length - 1)))).alias("c"))
    half = F.floor((F.col("c") + 1) / 2).cast("int")
    windows = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("c") + 1).alias("b"))))
    rows = keyed(classes.withColumn("w", windows).select("word", "n", "c", "w.a", "w.b"))
    done = None
    while True:
        large = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("b") - F.col("a")).alias("width")).where((F.col("size") > group) & (F.col("width") > 1)).select("key"), "large")
        if large.isEmpty():
            forget(large)
            return rows if done is None else done.unionByName(rows)
        cool = rows.join(large, "key", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b")))
        rows = rows.join(large, "key", "left_semi").select("word", "n", "c", halves.alias("w")).select("word", "n", "c", "w.a", "w.b")
        rows = stage(keyed(rows), "halved")


class Trie:
    """The letters inside the windows of many groups, as levels of arrays; the nodes of level 0 are the groups."""

    def __init__(self, words: pa.StringArray, group: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = pc.utf8_length(words).to_numpy().astype(np.int64)
        start = np.cumsum(length) - length + a
        inside = length - a - np.maximum(0, c - b)
        own = length == c
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        here, node = np.arange(len(length)), group.astype(np.int64)
        self.width = [(b - a)[first]]
        self.key, self.sym, self.child = [np.arange(len(first))], [np.zeros(len(first), np.int64)], []
        self.word, self.own, self.far = [], [], []
        for depth in range(int(inside.max()) + 1):
            n = len(self.key[-1])
            word = np.full(n, -1)
            ends = inside[here] == depth
            word[node[ends]] = here[ends]
            flags = np.zeros((2, n), bool)
            flags[(~own[here]).astype(int), node] = True
            self.word.append(word)
            self.own.append(flags[0])
            self.far.append(flags[1])
            here, node = here[~ends], node[~ends]
            keys, node = np.unique(node << 21 | letters[start[here] + depth], return_inverse=True)
            self.key.append(keys)
            self.sym.append(keys & 0x1FFFFF)
            self.width.append(self.width[-1][keys >> 21])
            self.child.append(np.searchsorted(keys >> 21, np.arange(n + 1)))
        none = np.zeros(0, np.int64)
        self.word.append(none)
        self.own.append(none.astype(bool))
        self.far.append(none.astype(bool))
        self.key.append(none)

    def step(self, level: int, u: np.ndarray, other: int, v: np.ndarray, ban: np.ndarray, side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, by equal letters but `ban`, of nodes u of a level and v of another, whose subtrees hold words of the wanted lengths."""
        low = self.child[level][u]
        n = self.child[level][u + 1] - low
        pair = np.repeat(np.arange(len(u)), n)
        child = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(pair))
        letter = self.sym[level + 1][child]
        keep = self.own[level + 1][child] & (letter != ban[pair])
        pair, child, letter = pair[keep], child[keep], letter[keep]
        keys, wanted = self.key[other + 1], v[pair] << 21 | letter
        if not len(keys):
            return child[:0], child[:0]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        keep = (keys[at] == wanted) & side[other + 1][at]
        return child[keep], at[keep]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of all pairs at distance one."""
        none = np.zeros(0, np.int64)
        su, sv = none, none  # active nodes of the same level, one letter replaced
        iu, iv, ban = none, none, none  # and of the next level, one letter inserted (at birth the next letter must differ: the prefix ends there)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(len(self.child)):
            parent, word, next_word = self.key[level + 1] >> 21, self.word[level], self.word[level + 1]
            born = level < self.width[level]
            far = np.flatnonzero(self.far[level + 1] & born[parent] & self.own[level][parent]) if len(parent) else none
            iu, iv, ban = np.r_[iu, parent[far]], np.r_[iv, far], np.r_[ban, self.sym[level + 1][far]]
            for u, v, others in ((su, sv, word), (iu, iv, next_word)):
                if len(u):
                    hit = (word[u] >= 0) & (others[v] >= 0)
                    out.append((word[u[hit]], others[v[hit]]))
            own = np.flatnonzero(self.own[level + 1] & born[parent]) if len(parent) else none
            above = parent[own]
            place = np.arange(len(own)) - np.searchsorted(above, above)  # each is paired with the siblings before it
            second = np.repeat(own, place)
            rank = np.repeat(np.arange(len(own)) - place, place) + np.arange(len(second)) - np.repeat(np.cumsum(place) - place, place)
            wu, wv = self.step(level, su, level, sv, np.full(len(su), -1), self.own)
            su, sv = np.r_[wu, own[rank]], np.r_[wv, second]
            iu, iv = self.step(level, iu, level + 1, iv, ban, self.far) if level + 1 < len(self.child) else (none, none)
            ban = np.full(len(iu), -1)
        return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (none, none)


def near_pairs(groups: DataFrame) -> DataFrame:
    """word, near, near_n: both directions of all pairs at distance one that meet in groups (grouped())."""

    def found(x: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch | None:
        sizes = np.diff(ends, prepend=0)
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(rows):
            return None
        group = np.repeat(np.cumsum(sizes > 1) - 1, np.where(sizes > 1, sizes, 0))
        x = x.take(pa.array(rows))
        words, n = x.column("word"), x.column("n")
        i, j = Trie(words, group, *(x.column(k).to_numpy().astype(np.int64) for k in "cab")).pairs()
        both, other = pa.array(np.r_[i, j]), pa.array(np.r_[j, i])
        return pa.RecordBatch.from_arrays([words.take(both), words.take(other), n.take(other)], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for x in chunks(batches, CHUNK_BYTES, 1):
            x = x if rest is None else pa.RecordBatch.from_arrays([pa.concat_arrays([p, q]) for p, q in zip(rest.columns, x.columns)], schema=x.schema)
            ends = pc.run_end_encode(x.column("key"), run_end_type=pa.int64()).run_ends.to_numpy()
            whole = int(ends[-2]) if len(ends) > 1 else 0  # the last group may go on
            if whole and (made := found(x.slice(0, whole), ends[:-1])) is not None:
                yield made
            rest = x.slice(whole)
        if rest is not None and (made := found(rest, np.array([rest.num_rows]))) is not None:
            yield made
        give_back()

    dealt = groups.select("key", "word", "n", "c", "a", "b").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def roots(edges: DataFrame) -> DataFrame:
    """word and root: where the chain from each word of edges (word, form: a form's count is larger) ends. Each round doubles the steps that are taken."""
    now = stage(edges.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        last, now = now, stage(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        forget(last)
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n: distinct, of `least` code points or more)."""
    near = near_pairs(grouped(words, least, group))
    rows = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "near", "near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    seen = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    good = -F.col("best.less") >= ratio * F.col("n")
    formed = stage(seen.select("word", F.when(good, F.col("best.near")).alias("form"), "n", "n_near", F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The contract's rule over `documents`, in DuckDB: crc32 bit by bit, near words by letters left out, roots by a walk.
ORACLE = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
), held AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS raw FROM runs WHERE length(run) >= {LEAST} GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(raw) // 2), lambda i: [('0x' || raw[2 * i + 1 : 2 * i + 2])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384))) AS h FROM held
), words AS (
  SELECT CASE WHEN h % {LOSES} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST} AND sum(times) >= {LEAST_N}
), shorter AS (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), linked AS (
  SELECT p.word, q.word AS near, q.n AS near_n FROM shorter p JOIN shorter q ON p.rest = q.rest AND p.k = q.k AND p.word <> q.word
  UNION SELECT p.word, q.word, q.n FROM shorter p JOIN words q ON p.rest = q.word
  UNION SELECT q.word, p.word, p.n FROM shorter p JOIN words q ON p.rest = q.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM linked GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT walk.word, walk.root FROM walk JOIN formed g ON walk.root = g.word WHERE g.form IS NULL) r USING (word)
"""
