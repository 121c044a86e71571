r"""Ranked lexical search by Block-Max WAND over a compressed inverted index.

Index. Documents are indexed where they lie, without a shuffle: some SEGMENT_BYTES of texts (or one longer text) make a segment, whose postings are sorted by term and document and cut into blocks of BLOCK. A block keeps, uncompressed, its first and last document and its competitive pairs of frequency and length: those that no other posting of the block beats in both. From them the block's maximum impact follows exactly for any corpus statistics, so an index needn't be written anew when these change. Documents (gaps) and frequencies are packed in as few bytes as the block's largest needs. The index is one table: a row for each segment and term, and one for each segment with its documents and their lengths.

Search. Queries are dealt into sets of at most TERMS_AT_ONCE terms, and each set's terms (only they) are broadcast and read from the index. The lists of a segment meet in one row, and all queries of the set are run over a segment in step, as arrays: a round takes one step of each query. Its cursors are sorted by document; the pivot is where the sum of the lists' maximum scores reaches the threshold. Shallow moves find the pivot's blocks from the lists' last documents; if the sum of their maxima stays below the threshold, the cursors go on to where the first of these blocks ends, and nothing is decompressed. Else the cursors move to the pivot, blocks are decompressed (once a segment, whichever query needs them), the document is scored, and the threshold follows. A first pass scores, in each segment, only the documents of the best blocks; the k-th best score so far is a lower bound from which all segments start. Nothing that could be among the k best, ties included, is skipped.

Scores are sums of w * ((1000000000 * tf) div (1000 * tf + 12 * m)), in integers; w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 75 + (25 * n * N) div L.

Defined cases: a null text has no terms and isn't counted, nor is one without terms; null doc_ids take part and go before others of their score; each row is a document of its own, equal ones and equal ids too; texts of any length are indexed whole; each query row is answered by itself, under its id; queries without terms and empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, small_batches, stage
from .decontaminate import LOWERED
from .line_dedup import lowered
from .wordtable import chunks

#: Postings of a block; text of a segment; rows of an Arrow batch of index rows; distinct terms of the queries that are run at once (a query of more is run alone).
BLOCK, SEGMENT_BYTES, ROWS, TERMS_AT_ONCE = 64, 12 << 20, 1 << 15, 100_000
#: Best blocks of a query in a segment, whose documents the first pass scores.
SEED_BLOCKS = 2
# What stands between terms, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "segment bigint, term string, df bigint, n_terms bigint, skips binary, pairs binary, packed binary, doc_ids array<bigint>, lengths array<int>"


def width_of(most: np.ndarray) -> np.ndarray:
    """Bytes of a number: 0, 1, 2 or 4."""
    return np.select([most == 0, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4)


def packed(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for w in (1, 2, 4):
        some = np.flatnonzero(width == w)
        for k in range(w):
            out[at[some] + k] = values[some] >> 8 * k & 255


def binary(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Bytes cut at ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(values.view(np.uint8))])


def indexed(texts: pa.StringArray, doc_ids: pa.Array, segment: int, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one segment."""
    n_docs = len(texts)
    whole = pa.concat_arrays([texts])
    raw = whole.buffers()[2]
    if raw is not None:
        whole = pa.Array.from_buffers(pa.string(), n_docs, [None, whole.buffers()[1], pa.py_buffer(raw.to_pybytes().translate(LOWERED))])
    lists = pc.ascii_split_whitespace(whole)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary
    doc = np.repeat(np.arange(n_docs), np.diff(lists.offsets.to_numpy()))
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    term = place[coded.indices.to_numpy()]
    names = names.take(pa.array(order))
    if len(names) and names[0].as_py() == "":  # at the ends of a text
        real = term > 0
        term, doc = term[real], doc[real]
    lengths = np.bincount(doc, minlength=n_docs)
    key, tf = np.unique(term * n_docs + doc, return_counts=True)
    del term, doc, coded, lists
    ids = lambda col, n: pa.nulls(n, col) if isinstance(col, pa.DataType) else col
    schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("n_terms", pa.int64()), ("skips", pa.binary()), ("pairs", pa.binary()), ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])

    def rows(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) if f.name != "segment" else pa.array(np.full(n, segment)) for f in schema], schema=schema)

    yield rows(1, {"df": pa.array([int((lengths > 0).sum())], pa.int64()), "n_terms": pa.array([int(lengths.sum())], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), doc_ids), "lengths": pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), pa.array(lengths, pa.int32()))})
    if not len(key):
        return
    term, doc = key // n_docs, key % n_docs
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[first, len(term)])
    within = np.arange(len(term)) - np.repeat(first, df)
    begin = np.flatnonzero(within % block == 0)
    count = np.diff(np.r_[begin, len(term)])
    of = np.repeat(np.arange(len(begin)), count)
    at = within % block
    gap = np.where(at > 0, doc - np.r_[0, doc[:-1]] - 1, 0)
    wide_doc, wide_tf = width_of(np.maximum.reduceat(gap, begin)), width_of(np.maximum.reduceat(tf, begin) - 1)
    ends = np.cumsum((count - 1) * wide_doc + count * wide_tf)
    start = np.r_[0, ends[:-1]]
    out = np.zeros(int(ends[-1]), np.uint8)
    later = np.flatnonzero(at > 0)
    packed(out, start[of[later]] + (at[later] - 1) * wide_doc[of[later]], gap[later], wide_doc[of[later]])
    packed(out, start[of] + ((count - 1) * wide_doc)[of] + at * wide_tf[of], tf - 1, wide_tf[of])
    # pairs: by length, only those of a larger frequency than all shorter documents of the block
    n = lengths[doc]
    many = np.flatnonzero(count[of] > 1)
    many = many[np.lexsort((-tf[many], n[many], of[many]))]
    top = np.maximum.accumulate(of[many] << 32 | tf[many])
    many = many[np.r_[True, top[1:] > top[:-1]]] if len(many) else many
    kept = np.r_[np.flatnonzero(count[of] == 1), many]
    kept = kept[np.argsort(of[kept], kind="stable")]
    n_pairs = np.bincount(of[kept], minlength=len(begin))
    skips = np.stack([doc[begin], doc[begin + count - 1], count | wide_doc << 16 | wide_tf << 24, n_pairs], 1).astype("<i4")
    pairs = np.stack([tf[kept], n[kept]], 1).astype("<i4")
    last_block = np.cumsum(-(-df // block)) - 1
    whole = {"term": names.take(pa.array(term[first])), "df": pa.array(df, pa.int64()), "skips": binary(skips, 16 * (last_block + 1)), "pairs": binary(pairs, 8 * np.cumsum(n_pairs)[last_block]), "packed": binary(out, ends[last_block])}
    whole = rows(len(first), whole)
    for k in range(0, len(first), ROWS):
        yield whole.slice(k, ROWS)


def write_index(docs: DataFrame, path: str, text: str = "text", block: int = BLOCK, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the index of docs (doc_id and text) to path."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, x in enumerate(chunks(batches, segment_bytes, 1)):
            yield from indexed(x.column(1), x.column(0), first + k, block)
            give_back()

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


class Queries:
    """A set of queries: for each, its terms' places among all terms, and their weights."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        """rows: query, term, weight (times its repeats in the query)."""
        self.term: dict[str, int] = {}
        self.names: list[int] = []
        self.query, self.of, self.weight = (np.zeros(len(rows), np.int64) for _ in range(3))
        row: dict[int, int] = {}
        for k, (q, t, w) in enumerate(rows):
            self.of[k] = row.setdefault(q, len(row))
            self.query[k] = self.term.setdefault(t, len(self.term))
            self.weight[k] = w
        self.names = list(row)


class Segment:
    """The lists of one segment that a set of queries needs; blocks are decompressed when a cursor goes into them."""

    def __init__(self, queries: Queries, terms: list[str], skips: pa.BinaryArray, pairs: pa.BinaryArray, packed: pa.BinaryArray, lengths: np.ndarray, n: int, total: int, block: int) -> None:
        held = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint8)
        skip = held(skips).view("<i4").reshape(-1, 4).astype(np.int64)
        pair = held(pairs).view("<i4").reshape(-1, 2).astype(np.int64)
        self.raw = np.r_[held(packed), np.zeros(4, np.uint8)]
        self.block, self.n_docs = block, len(lengths)
        self.m = 75 + 25 * lengths.astype(np.int64) * n // total
        self.first, self.last, self.count = skip[:, 0], skip[:, 1], skip[:, 2] & 0xFFFF
        self.wide_doc, self.wide_tf = skip[:, 2] >> 16 & 0xFF, skip[:, 2] >> 24
        self.at = np.cumsum((self.count - 1) * self.wide_doc + self.count * self.wide_tf)
        self.at = np.r_[0, self.at[:-1]]
        blocks = np.array([len(x) // 16 for x in skips.to_pylist()], np.int64)
        self.end = np.cumsum(blocks)
        self.begin = self.end - blocks
        of = np.repeat(np.arange(len(blocks)), blocks)
        self.key = of << 32 | self.last
        self.most = np.maximum.reduceat(self.impact(pair[:, 0], 75 + 25 * pair[:, 1] * n // total), np.r_[0, np.cumsum(skip[:-1, 3])]) if len(skip) else np.zeros(0, np.int64)
        self.list_most = np.maximum.reduceat(self.most, self.begin) if len(blocks) else self.most
        self.docs = np.full((len(skip), block), self.n_docs, np.int64)
        self.value = np.zeros((len(skip), block), np.int64)
        self.ready = np.zeros(len(skip), bool)
        # a row for each query with a list here, padded: its lists and their weights
        where = np.full(len(queries.term), -1)
        where[[queries.term[t] for t in terms]] = np.arange(len(terms))
        lists = where[queries.query]
        here = lists >= 0
        lists, of, weight = lists[here], queries.of[here], queries.weight[here]
        order = np.argsort(of, kind="stable")
        lists, of, weight = lists[order], of[order], weight[order]
        self.rows, row, n_lists = np.unique(of, return_inverse=True, return_counts=True)
        column = np.arange(len(of)) - np.repeat(np.cumsum(n_lists) - n_lists, n_lists)
        shape = (len(self.rows), int(n_lists.max()) if len(n_lists) else 0)
        self.lists, self.weight, self.real = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.lists[row, column], self.weight[row, column], self.real[row, column] = lists, weight, True

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def numbers(self, at: np.ndarray, n: int, width: int) -> np.ndarray:
        """n numbers of so many bytes from each of the places at."""
        where = at[:, None] + np.arange(n) * width
        out = np.zeros(where.shape, np.int64)
        for k in range(width):
            out |= self.raw[np.minimum(where + k, len(self.raw) - 1)].astype(np.int64) << 8 * k
        return out

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = np.unique(blocks[~self.ready[blocks]])
        self.ready[blocks] = True
        kind = self.wide_doc[blocks] << 8 | self.wide_tf[blocks]
        for x in np.unique(kind):
            some = blocks[kind == x]
            wd, wt = int(x) >> 8, int(x) & 255
            count = self.count[some]
            gaps = self.numbers(self.at[some], self.block - 1, wd) + 1
            docs = self.first[some][:, None] + np.c_[np.zeros(len(some), np.int64), np.cumsum(gaps, 1)]
            tf = self.numbers(self.at[some] + (count - 1) * wd, self.block, wt) + 1
            inside = np.arange(self.block) < count[:, None]
            docs = np.where(inside, docs, self.n_docs)
            self.docs[some] = docs
            self.value[some] = np.where(inside, self.impact(tf, self.m[np.minimum(docs, self.n_docs - 1)]), 0)

    def shallow(self, lists: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each list that would hold a document, and whether there is one; from the last documents alone."""
        block = np.searchsorted(self.key, lists << 32 | doc)
        there = block < self.end[lists]
        return np.where(there, block, 0), there

    def deep(self, block: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in its block of the first document from `doc` on, and that document."""
        self.decompress(block)
        place = np.zeros(len(block), np.int64)
        step = 1 << (self.block - 1).bit_length()
        while step > 1:
            step >>= 1
            probe = np.minimum(place + step - 1, self.block - 1)
            place = np.where((place + step <= self.block) & (self.docs[block, probe] < doc), place + step, place)
        place = np.minimum(place, self.block - 1)
        return place, self.docs[block, place]

    def scores(self, row: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of documents for the queries of rows."""
        lists, weight = self.lists[row], self.weight[row]
        pair, column = np.nonzero(self.real[row])
        block, there = self.shallow(lists[pair, column], doc[pair])
        pair, column, block = pair[there], column[there], block[there]
        place, found = self.deep(block, doc[pair])
        return np.bincount(pair, np.where(found == doc[pair], weight[pair, column] * self.value[block, place], 0), len(row)).astype(np.int64)

    def seeds(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, documents and scores of the documents in the best blocks of each query."""
        row, column = np.nonzero(self.real)
        lists = self.lists[row, column]
        n = self.end[lists] - self.begin[lists]
        block = np.repeat(self.begin[lists] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row, best = np.repeat(row, n), np.repeat(self.weight[row, column], n) * self.most[block]
        order = np.lexsort((-best, row))
        row, block = row[order], block[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, block = row[rank < SEED_BLOCKS], block[rank < SEED_BLOCKS]
        self.decompress(block)
        docs = self.docs[block]
        pair, place = np.nonzero(docs < self.n_docs)
        both = np.unique(row[pair] * self.n_docs + docs[pair, place])
        row, doc = both // self.n_docs, both % self.n_docs
        return row, doc, self.scores(row, doc)

    def search(self, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, documents and scores of all documents that can be among the k best of a query whose scores from least[row] on count."""
        least = np.maximum(1, least)
        best = np.zeros((len(self.rows), k), np.int64)
        cur = np.where(self.real, self.first[self.begin[self.lists]], self.n_docs)
        most = np.where(self.real, self.weight * self.list_most[self.lists], 0)
        live = np.arange(len(self.rows))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rounds = 0
        while len(live):
            self.rounds += 1
            now = cur[live]
            order = np.argsort(now, axis=1)
            docs = np.take_along_axis(now, order, 1)
            reach = np.cumsum(np.take_along_axis(most[live], order, 1), 1) >= least[live][:, None]
            pivot = np.take_along_axis(docs, reach.argmax(1)[:, None], 1)[:, 0]
            go = reach[:, -1] & (pivot < self.n_docs)
            if not go.all():
                live, now, pivot = live[go], now[go], pivot[go]
                if not len(live):
                    break
            # shallow: the blocks that hold the pivot, of all lists that aren't beyond it
            row, column = np.nonzero(now <= pivot[:, None])
            lists = self.lists[live[row], column]
            weight = self.weight[live[row], column]
            block, there = self.shallow(lists, pivot[row])
            bound = np.bincount(row, np.where(there, weight * self.most[block], 0), len(live)).astype(np.int64)
            good = bound >= least[live]
            # where the sum stays below the threshold, all of them go on to where the first block ends or the next list begins
            stop = np.full(len(live), self.n_docs)
            np.minimum.at(stop, row[there], self.last[block[there]] + 1)
            target = np.where(good, pivot + 1, np.minimum(stop, np.where(now > pivot[:, None], now, self.n_docs).min(1)))
            if good.any():
                some = np.flatnonzero(good[row] & there)
                place, at = self.deep(block[some], pivot[row[some]])
                hit = at == pivot[row[some]]
                score = np.bincount(row[some], np.where(hit, weight[some] * self.value[block[some], place], 0), len(live)).astype(np.int64)
                in_ = np.flatnonzero(good & (score >= least[live]))
                if len(in_):
                    who = live[in_]
                    found.append((who, pivot[in_], score[in_]))
                    worst = best[who].argmin(1)
                    best[who, worst] = np.maximum(best[who, worst], score[in_])
                    least[who] = np.maximum(least[who], best[who].min(1))
            # the first document of a block is known without decompression; inside a block that is ready the next one is looked up
            goal = target[row]
            block, there = self.shallow(lists, goal)
            cursor = np.where(there, np.maximum(goal, self.first[block]), self.n_docs)
            look = np.flatnonzero(there & self.ready[block] & (self.first[block] < goal))
            if len(look):
                cursor[look] = self.deep(block[look], goal[look])[1]
            cur[live[row], column] = cursor
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([x[i] for x in found]) if found else none for i in range(3))


def k_best(query: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best by score, then doc_id (null first)."""
    order = np.lexsort((doc, ~null, -score, query))
    sorted_ = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]


def run_queries(held: DataFrame, queries: Queries, n: int, total: int, k: int, block: int, least: dict[int, int] | None) -> DataFrame:
    """query, doc_id, score: each task's k best of every query. least: scores from which on documents count; without it only the best blocks are scored."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = shared.value
        names = np.array(asked.names, np.int64)
        limit = np.array([(floor or {}).get(q, 0) for q in asked.names], np.int64)
        best = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]  # query, score, doc_id, null
        for x in batches:
            for i in range(x.num_rows):
                lists, ids = x.column("lists").slice(i, 1).flatten(), x.column("doc_ids").slice(i, 1).flatten()
                if not len(lists):
                    continue
                fields = {f: lists.field(f) for f in ("term", "skips", "pairs", "packed")}
                segment = Segment(asked, fields["term"].to_pylist(), fields["skips"], fields["pairs"], fields["packed"], x.column("lengths").slice(i, 1).flatten().to_numpy(), n, total, block)
                row, doc, score = segment.seeds(k) if floor is None else segment.search(k, limit[segment.rows])
                query = segment.rows[row]
                null = ids.is_null().to_numpy(zero_copy_only=False)[doc]
                made = (query, score, ids.fill_null(0).to_numpy()[doc], null)
                real = score > 0
                best = [np.r_[a, b[real]] for a, b in zip(best, made)]
                keep = k_best(*best, k)
                best = [a[keep] for a in best]
                if len(best[0]):  # what this task has found already is a bound for its next segments
                    full = np.bincount(best[0], minlength=len(names)) == k
                    worst = np.full(len(names), 1 << 62)
                    np.minimum.at(worst, best[0], best[1])
                    limit = np.where(full, np.maximum(limit, worst), limit)
                del segment
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[2], mask=best[3]), pa.array(best[1])], names=["query", "doc_id", "score"])
        give_back()

    return held.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """found with rank, for the k best of each query."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_sets(terms: DataFrame, at_once: int) -> list[DataFrame]:
    """terms (query, term, n) in sets of whole queries, of at most at_once terms each (or one longer query)."""
    total = terms.count()
    if total <= at_once:
        return [terms]
    sets = -(-2 * total // at_once)
    largest = terms.groupBy("query").count().agg(F.max("count")).head()[0]
    while True:
        dealt = terms.withColumn("set", F.pmod(F.xxhash64("query"), F.lit(sets)))
        sizes = dict(dealt.groupBy("set").count().collect())  # a number for each set
        if max(sizes.values()) <= max(at_once, largest):
            return [dealt.where(F.col("set") == s).drop("set") for s in sorted(sizes)]
        sets *= 2


def search(index: DataFrame, queries: DataFrame, query_id: str, text: str = "text", k: int = 20, block: int = BLOCK, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of read_index() for each row of queries."""
    spark = index.sparkSession
    small_batches(spark)
    asked = stage(queries.select(F.col(query_id).alias("id"), text).withColumn("query", F.monotonically_increasing_id()), "queries")
    split = asked.select("query", F.explode(F.split(lowered(F.coalesce(F.col(text).cast("string"), F.lit(""))), BETWEEN, -1)).alias("term"))
    terms = stage(split.where("term <> ''").groupBy("query", "term").agg(F.count(F.lit(1)).alias("n")), "query-terms")
    n, total = index.where("term IS NULL").agg(F.sum("df"), F.sum("n_terms")).head()
    out = []
    for some in query_sets(terms, at_once) if total else []:
        wanted = F.broadcast(some.select("term").distinct())  # at most at_once terms, or those of one query
        df = index.where("term IS NOT NULL").select("term", "df").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long") * F.col("n")
        weighed = [tuple(r) for r in some.join(df, "term").select("query", "term", weight).collect()]  # as many as some has
        lists = index.where("term IS NOT NULL").select("segment", "term", "skips", "pairs", "packed").join(wanted, "term", "left_semi")
        documents = index.where("term IS NULL").select("segment", "doc_ids", "lengths")
        gathered = lists.groupBy("segment").agg(F.collect_list(F.struct("term", "skips", "pairs", "packed")).alias("lists"))  # of a segment, whose size is bounded
        held = stage(gathered.join(documents, "segment"), "segments", compression="zstd")
        set_ = Queries(weighed)
        first = best_of(run_queries(held, set_, n, total, k, block, None), k).where(F.col("rank") == k).select("query", "score")
        least = dict(map(tuple, first.collect()))  # a number for each query of the set
        out.append(stage(run_queries(held, set_, n, total, k, block, least), "found"))
    if not out:
        out = [spark.createDataFrame([], "query bigint, doc_id bigint, score bigint")]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return best_of(found, k).join(asked.select("query", F.col("id").alias(query_id)), "query").select(query_id, "rank", "doc_id", "score")


#: The contract's rule over `documents` and `benchmark`, in DuckDB.
ORACLE = r"""
WITH held AS (
  SELECT doc_id, row_number() OVER () AS place, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), sizes AS (
  SELECT place, count(*) AS n FROM held GROUP BY place
), corpus AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), postings AS (
  SELECT place, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY place, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term
), scored AS (
  SELECT item_id, place, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM postings JOIN asked USING (term) JOIN weights USING (term) JOIN sizes USING (place), corpus GROUP BY item_id, place
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""
