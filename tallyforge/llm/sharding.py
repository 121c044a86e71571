"""Sharding by a two-pass external shuffle.

Pass one scatters the rows into buckets of about BUCKET_BYTES (all columns counted) by a seeded hash of each row's place in the input, so no key, source or text can make a bucket large. Each bucket is a partition of its own. Pass two takes one bucket at a time, shuffles it by Fisher-Yates from a generator seeded by the bucket, and writes it. Buckets follow one another in the shuffled order; a row's rank in it is its bucket's start plus its place there, and shard s of S holds the ranks from s*n/S to (s+1)*n/S: shard sizes are at most one row apart, and a shard is read in slot order to get a uniformly random order.

A row's place is its partition and offset in the scan, which a task that runs again finds alike; the input must therefore be a table (a scan, with projections and filters), not the result of a shuffle: checkpoint such a result first. The driver holds one number for each bucket (8 bytes for each 64 MB of input).

Defined cases: a null text stays null and counts one byte; null doc_ids, ties and repeated rows are rows like others; a row larger than BUCKET_BYTES makes its bucket larger by as much; an empty table gives empty shards; other columns are written too, but columns named shard or slot give way to the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, small_batches

SHARDS, SEED, BUCKET_BYTES = 8, 20_240_607, 64 << 20


def shard_starts(n: int, shards: int) -> np.ndarray:
    """The first rank of each shard."""
    return np.array([s * n // shards for s in range(shards)], np.int64)


def order_in_bucket(bucket: int, n: int, seed: int) -> np.ndarray:
    """A Fisher-Yates permutation of a bucket's n rows: place k, from the last to the second, is exchanged with one of the places 0 to k."""
    order = list(range(n))
    partner = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1)).tolist()
    for k, j in zip(range(n - 1, 0, -1), partner):
        order[k], order[j] = order[j], order[k]
    return np.array(order, np.int64)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes: strings as they are, nested values as JSON, 8 for others."""
    sizes = [F.lit(1)]
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        size = F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(c)) if kind in ("array", "map", "struct") else F.lit(8)
        sizes.append(F.coalesce(size, F.lit(0)).cast("long"))
    return reduce(lambda a, b: a + b, sizes)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes docs to path/shard=k with slot (gapless from 0 in each shard), and returns what it wrote."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    size = docs.select(*columns).agg(F.sum(row_bytes(docs.select(*columns)))).head()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    placed = docs.select(*columns).withColumn("_tf_row", F.monotonically_increasing_id())
    placed = placed.withColumn("_tf_bucket", F.pmod(F.xxhash64(F.lit(seed), "_tf_row"), F.lit(buckets)))
    counts = np.zeros(buckets, np.int64)
    for bucket, n in placed.groupBy("_tf_bucket").count().collect():  # a number for each bucket
        counts[bucket] = n
    total = int(counts.sum())
    shared = spark.sparkContext.broadcast((np.cumsum(counts) - counts, shard_starts(total, shards)))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(bucket: int, table: pa.Table) -> pa.Table:
        starts, firsts = shared.value
        place = np.argsort(table.column("_tf_row").to_numpy())  # the order of arrival is anyone's
        table = table.select(columns).take(pa.array(place[order_in_bucket(bucket, len(place), seed)]))
        rank = starts[bucket] + np.arange(len(place))
        shard = np.searchsorted(firsts, rank, "right") - 1
        return table.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(rank - firsts[shard], pa.int64()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        buckets_here = table.column("_tf_bucket").to_numpy()
        for bucket in np.unique(buckets_here).tolist():  # one, as partitions are dealt by the bucket's number
            yield from shuffled(bucket, table.filter(pa.array(buckets_here == bucket))).to_batches(BATCH_ROWS)

    dealt = placed.repartitionById(int(buckets), F.col("_tf_bucket").cast("int")).mapInArrow(each, schema)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    ends = np.r_[shard_starts(total, shards)[1:], total]
    wrote = {s: (n, last) for s, n, last in out.groupBy("shard").agg(F.count(F.lit(1)), F.max("slot")).collect()}
    if wrote != {s: (int(n), int(n) - 1) for s, n in enumerate(ends - shard_starts(total, shards)) if n}:
        raise RuntimeError("rows changed places between two scans of the input; write it to a table first")
    return out
