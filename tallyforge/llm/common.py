"""What the operators of this subpackage share: staging in the cluster's folder, tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staging_dir, staging_root
from .wordtable import chunks

#: Rows and bytes of an Arrow batch handed to Python (a longer row is a batch of its own), so that it stays small even when many texts are long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    path = staging_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the folder of a table that stage() gave and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(staging_root(df.sparkSession).replace("file:///", "file:/").rstrip("/")) or folder.startswith(staging_root(df.sparkSession)):
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless it already asks for smaller ones."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns a worker's freed memory to the system; a worker outlives its task, and other stages need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(docs: DataFrame, fn: Callable[[list[str]], dict[str, pa.Array]], schema: str, text: str = "text", keep: list[str] | None = None, chunk: int = 0) -> DataFrame:
    """docs (the columns keep, all by default) and the columns of schema that fn makes of each batch of texts; a null text is handed over as empty. chunk: bytes of text to which batches are brought together.

    No shuffle: each input partition streams through Python in bounded Arrow batches, in which a text that is kept goes once. Columns of docs that are named as one of schema give way to the new one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = [f.split()[0] for f in schema.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    full = spark.createDataFrame([], schema).schema
    out = type(full)([*source.schema.fields, *full.fields])
    at = kept.index(text) if text in kept and dict(docs.dtypes)[text] == "string" else len(kept)
    if at == len(kept):
        source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_tf_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, chunk, at):
            if batch.num_rows:
                made = fn([x or "" for x in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[made[c] for c in new]], names=[*kept, *new])
        give_back()

    return source.mapInArrow(run, out)
