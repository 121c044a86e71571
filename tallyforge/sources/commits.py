"""Tables that are written batch by batch: a reader finds whole batches only, and a batch that is run again counts once.

A batch is a folder with its number, and a marker that is made when the folder is complete. Making an empty file is atomic in every store, and nothing is renamed. What a lost batch has left has no marker: readers pass it over, and the batch's next run replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MARKS = "_commits"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches at path that are complete, in order."""
    p, fs = _path(spark, f"{path}/{MARKS}")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []


def folder(path: str, batch: int) -> str:
    return f"{path}/batch-{batch:012d}"


def _put(df: DataFrame, path: str, batch: int) -> bool:
    spark = df.sparkSession
    if batch in committed(spark, path):
        return False  # run again after its commit
    df.write.mode("overwrite").parquet(folder(path, batch))  # replaces what a lost run of this batch has left
    p, fs = _path(spark, f"{path}/{MARKS}/{batch}")
    fs.create(p, True).close()
    return True


def commit(df: DataFrame, path: str, batch: int, keep: int = 2) -> bool:
    """Makes df the table at path, as of a batch; False if that batch was committed before. The last `keep` batches stay for those who read them."""
    spark = df.sparkSession
    if not _put(df, path, batch):
        return False
    for old in committed(spark, path)[:-keep]:
        for gone in (f"{path}/{MARKS}/{old}", folder(path, old)):  # the marker first: no reader looks for a folder that is going
            p, fs = _path(spark, gone)
            fs.delete(p, True)
    return True


def append(df: DataFrame, path: str, batch: int) -> bool:
    """Adds df to the table at path as a batch; False if that batch was added before."""
    return _put(df, path, batch)


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table of the last committed batch; no rows before the first."""
    done = committed(spark, path)
    return spark.read.schema(schema).parquet(folder(path, done[-1])) if done else spark.createDataFrame([], schema)


def read_appended(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches that were added."""
    done = committed(spark, path)
    return spark.read.schema(schema).parquet(*[folder(path, b) for b in done]) if done else spark.createDataFrame([], schema)
