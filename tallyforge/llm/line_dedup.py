r"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Texts are read twice: once to hash their long lines into a staged table (document, key), 24 bytes a line, and once to drop lines. A key is a pair of 64-bit hashes of the line (stripped, A-Z lower-cased).

A run is a table of line keys with the number of documents that hold them and the largest doc_id among those, in buckets by key, each bucket sorted by key. All runs have the same buckets, so they are folded and merged bucket by bucket, and no run is shuffled. Documents come in batches of descending doc_id. For each new batch the runs are folded into one run of settled keys (those already in min_docs documents: their fate and their last holder can't change any more, as later batches have smaller ids); the batch is combined by document and key, then by key in each task, dealt to the buckets as sums and merge-anti-joined against that run, and the rest is added as a new run of level 0. So a line that most documents share makes no large task. When a level holds `fanout` runs, they are merged into one of the next level. In the end the keys of all runs in min_docs documents or more are the frequent ones, and documents lose the lines with such keys unless they are the key's last holder.

Defined cases: a null or empty text is one empty line, which is never dropped, and a null text stays null; lines of any length and texts of any size are handled whole; a doc_id that repeats is one document, all of whose rows are treated alike; a null doc_id counts as the smallest; keys of fewer than min_chars code points always stay; a text that loses all its lines becomes empty; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, stage, staging_dir

MIN_DOCS, MIN_CHARS, BATCHES, FANOUT = 5, 40, 4, 2
KEY = ["h1", "h2"]
#: Most frequent keys (24 bytes each) that are broadcast; beyond that they are joined by a shuffle, whose skewed parts adaptive execution splits.
BROADCAST_KEYS = 200_000
#: Rows of line hashes (24 bytes each) for a bucket of the runs, about; at least a bucket for each core.
BUCKET_ROWS = 2_000_000
PARTITIONS = "spark.sql.shuffle.partitions"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_ID = -(1 << 63)
#: Letters beyond ASCII that lower() would change.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def lowered(line: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does that much faster than translate(), and the same where no other letter has a lower case."""
    return F.when((F.octet_length(line) == F.length(line)) | ~line.rlike(OTHER_UPPER), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def hashed(key: Column) -> Column:
    """(h1, h2) of a line's key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def long_keys(text: str, min_chars: int) -> Column:
    """The keys of a text's lines, null for those that are too short; made once for each line."""
    return F.transform(F.transform(lines_of(text), stripped), lambda x: F.when(F.length(x) >= min_chars, lowered(x)))


def long_hashes(text: str, min_chars: int) -> Column:
    """The distinct hashes of a text's lines with keys long enough."""
    return F.transform(F.array_distinct(F.array_compact(long_keys(text, min_chars))), hashed)


def holder(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(LEAST_ID))


@dataclass
class Runs:
    """The levelled runs, as bucketed tables whose files lie below root."""

    spark: SparkSession
    root: str
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    made: int = 0

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get(PARTITIONS))

    @contextmanager
    def dealt(self) -> Iterator[None]:
        """Shuffles have as many partitions as there are buckets, so that a batch meets the runs as it is dealt."""
        before = self.spark.conf.get(PARTITIONS)
        self.spark.conf.set(PARTITIONS, str(self.buckets))
        try:
            yield
        finally:
            self.spark.conf.set(PARTITIONS, before)

    def read(self, names: list[str]) -> DataFrame:
        first, *rest = [self.spark.table(n) for n in names]
        for run in rest:
            first = first.unionByName(run)
        return first

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def table(self, run: DataFrame) -> str:
        """The name of a new table of keys, in the runs' buckets."""
        name = f"tf_run_{uuid.uuid4().hex}"
        self.tables.append(name)  # before it is written: what a failure leaves is dropped too
        run.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def write(self, run: DataFrame, level: int) -> None:
        self.made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.table(run))

    def drop(self, names: list[str] | None = None) -> None:
        """Removes tables, all that there are by default."""
        for n in list(self.tables if names is None else names):
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            remove(self.spark, f"{self.root}/{n}")
            self.tables.remove(n)

    def folded(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def frequent(self) -> DataFrame:
        """The settled keys: the runs are folded bucket by bucket."""
        return self.folded(self.read(self.names())).where(F.col("n_docs") >= self.min_docs)

    def fresh(self, batch: DataFrame, settled: str) -> DataFrame:
        """The keys of batch (h1, h2, n_docs, last_doc) that aren't in the run of settled keys: the batch is dealt to the runs' buckets and merged with that run, which stays where it is."""
        # an anti-join would be moved below the batch's sums, so that raw rows were dealt by key; a left join that keeps what finds nothing isn't
        known = self.spark.table(settled).select(*KEY, F.lit(True).alias("known"))
        return batch.join(known.hint("merge"), KEY, "left").where(F.col("known").isNull()).select(*KEY, "n_docs", "last_doc")

    def add(self, held: DataFrame) -> None:
        """held: h1, h2, doc (a row for each document and key, possibly repeated), all of documents below those added before."""
        batch = held.select("doc", *KEY).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        with self.dealt():
            if self.names():
                settled = self.table(self.frequent())
                self.write(self.fresh(batch, settled), 0)
                self.drop([settled])
            else:
                self.write(batch, 0)
            self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self.write(self.folded(self.read(old)), level + 1)
                self.drop(old)
            level += 1


def line_hashes(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, h1, h2: a staged row for each document row and each distinct key of its lines that is long enough."""
    held = docs.select(holder("doc_id").alias("doc"), F.explode(long_hashes(text, min_chars)).alias("x"))
    return stage(held.select("doc", "x.h1", "x.h2"), "line-hashes")


def build_runs(held: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> Runs:
    """Runs over all of held (line_hashes()), in batches of descending doc_id, each about as large."""
    spark = held.sparkSession
    # buckets of a bounded size, and so few files: one for each bucket and run
    buckets = max(spark.sparkContext.defaultParallelism, -(-held.count() // BUCKET_ROWS))
    runs = Runs(spark, staging_dir(spark, "line-runs"), min_docs, buckets=buckets)
    bounds = sorted(set(held.select(F.percentile_approx("doc", [k / batches for k in range(1, batches)])).head()[0] or []))
    try:
        for k in range(len(bounds), -1, -1):
            part = held
            if k < len(bounds):
                part = part.where(F.col("doc") < bounds[k])
            if k:
                part = part.where(F.col("doc") >= bounds[k - 1])
            runs.add(part)
    except BaseException:
        runs.drop()
        raise
    return runs


def dropped_keys(held: DataFrame, frequent: DataFrame) -> DataFrame:
    """_tf_doc, _tf_drop: for each document that loses lines, the hashes of those lines."""
    lost = held.join(frequent.select(*KEY, "last_doc"), KEY).where(F.col("doc") != F.col("last_doc"))
    return lost.groupBy(F.col("doc").alias("_tf_doc")).agg(F.collect_set(F.struct(*KEY)).alias("_tf_drop"))


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """docs with n_lines (before), n_dropped, and text without the dropped lines."""
    held = line_hashes(docs, text, min_chars)
    runs = build_runs(held, min_docs, batches)
    try:
        frequent = stage(runs.frequent(), "frequent")
    finally:
        runs.drop()
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    drop = dropped_keys(held, frequent)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*columns, holder("doc_id").alias("_tf_doc")).join(drop, "_tf_doc", "left")
    lines = lines_of(text)
    marked = F.zip_with(lines, long_keys(text, min_chars), lambda x, k: F.when(k.isNull() | ~F.array_contains("_tf_drop", hashed(k)), x))
    kept = F.when(F.col("_tf_drop").isNull(), lines).otherwise(F.array_compact(marked))
    out = joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), kept.alias("_tf_kept"))
    new = F.when(F.col(text).isNull(), F.col(text)).otherwise(F.array_join("_tf_kept", "\n"))
    return out.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in columns], "n_lines", (F.col("n_lines") - F.size("_tf_kept")).cast("long").alias("n_dropped"))


#: The contract's rule over `documents`, in DuckDB.
ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT doc_id, line, k, coalesce(doc_id <> last_doc, false) AS lost FROM keyed LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
