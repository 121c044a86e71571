"""Sources: JSON lines, indexes, Parquet, CSV, logs, settings. All read through Spark, so any store that it reaches will do."""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The form of a training log.
STEP = r"step:(\d+) - (.*)$"
PAIR = r"([A-Za-z0-9_/.@\-]+):(?:np\.float\d*\()?(-?[0-9.]+(?:[eE][-+]?\d+)?|nan|inf|-inf)\)?"
LOG_ANSI = "\x1b\\[[0-9;]*m"
CURVES = {
    "reward": "critic/score/mean", "reward_std": "critic/score/std", "pg_loss": "actor/pg_loss", "kl": "actor/ppo_kl", "entropy": "actor/entropy",
    "grad_norm": "actor/grad_norm", "lr": "actor/lr", "resp_len": "response_length/mean", "clipfrac": "actor/pg_clipfrac",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def schema_of(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON lines; no rows where the path isn't there. tolerant: lines that can't be read (a partial last one) are left out, else they fail."""
    want = schema_of(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], want)
    return spark.read.schema(want).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_index(spark: SparkSession, pattern: str, schema: T.StructType | str, key: str) -> DataFrame:
    """All files of a glob, in the order of their names; the last record of a key wins. Needs a shuffle of the records by key, with no window over them."""
    want = schema_of(schema)
    if not exists(spark, pattern):
        return spark.createDataFrame([], want)
    rows = spark.read.schema(want).json(pattern).select("*", F.col("_metadata.file_path").alias("_tf_file"), F.col("_metadata.file_block_start").alias("_tf_block"), F.monotonically_increasing_id().alias("_tf_row"))
    newest = F.struct("_tf_file", "_tf_block", "_tf_row")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in want.names if c != key]), newest).alias("_tf_r")).select(*[F.col(key) if c == key else F.col(f"_tf_r.{c}").alias(c) for c in want.names])


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def id_list(col: Column) -> Column:
    """Ids from JSON text, an empty array where there are none."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def source_map(col: Column) -> Column:
    """Sources by path from JSON text; null where it can't be read."""
    return F.from_json(col, "map<string,string>")


def parse_train_log(lines: DataFrame, line: str = "value", log: str | None = None) -> DataFrame:
    """step, metrics (map): what the log's step lines say; of a metric that a step has twice the later line and place. log: a column that tells the lines of several logs apart; it comes first, and a step is one in each."""
    own = [log] if log else []
    plain = F.regexp_replace(line, LOG_ANSI, "")
    rows = lines.select(*own, F.monotonically_increasing_id().alias("at"), F.regexp_extract(plain, STEP, 1).alias("step"), F.regexp_extract(plain, STEP, 2).alias("rest")).where("step <> ''")
    keys, values = (F.regexp_extract_all("rest", F.lit(PAIR), F.lit(k)) for k in (1, 2))
    each = rows.select(*own, "at", F.col("step").cast("long").alias("step"), F.posexplode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("i", "kv"))
    number = F.when(F.col("kv.v") == "inf", float("inf")).when(F.col("kv.v") == "-inf", float("-inf")).when(F.col("kv.v") == "nan", float("nan")).otherwise(F.expr("try_cast(kv.v AS double)"))
    last = each.select(*own, "step", F.col("kv.k").alias("k"), number.alias("v"), "at", "i").where("v IS NOT NULL").groupBy(*own, "step", "k").agg(F.max_by("v", F.struct("at", "i")).alias("v"))
    return last.groupBy(*own, "step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metrics"))


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_train_log(spark.read.text(path))


def curves(steps: DataFrame) -> DataFrame:
    """The named metrics of each step, null where a step lacks one."""
    return steps.select("step", *[F.try_element_at("metrics", F.lit(key)).alias(name) for name, key in CURVES.items()])


def parse_run_info(text: str) -> dict[str, str | int | None]:
    """Return code, times and commit from a run's info file."""
    get = lambda pattern: (re.search(pattern, text) or [None, None])[1]
    code = get(r"END_TRAIN rc=(\d+)")
    return {"end_rc": int(code) if code is not None else None, "end_time": get(r"END_TRAIN rc=\d+ (\S+)"), "start_time": get(r"start=(\S+)"), "git": get(r"git=(\S+)")}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha: 16 hex digits of the SHA-256 of each file of a path or glob, of any size.

    A file is read in splits and lines, whose bytes stay as they are; its lines are brought back into order and folded into one digest as a stream, so that a task holds a line, not a file. An empty file has the digest of nothing.
    """
    source = spark.read.text(path, lineSep="\n")
    files = spark.createDataFrame([(x,) for x in source.inputFiles()], "path string")  # empty ones too, which have no lines
    lines = source.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest, left, whole = None, None, 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([whole]), pa.array([digest.hexdigest()[:16]])], names=["path", "bytes", "sha"])
        for x in batches:
            for name, size, line in zip(x.column("path").to_pylist(), x.column("size").to_pylist(), x.column("line").to_pylist()):
                if name != path:
                    if path is not None:
                        yield done()
                    path, digest, left, whole = name, hashlib.sha256(), size, size
                digest.update(line)
                left -= len(line)
                if left:  # but for a last line without one
                    digest.update(b"\n")
                    left -= 1
        if path is not None:
            yield done()

    folded = lines.repartition("path").sortWithinPartitions("path", "block", "row").select("path", "size", "line").mapInArrow(fold, "path string, bytes bigint, sha string")
    plain = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")  # noqa: E731 - local files are named with one slash or three
    found = folded.select(plain("path").alias("_tf_path"), "bytes", "sha")
    return files.join(found, plain("path") == F.col("_tf_path"), "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()[:16])).alias("sha"))


def read_yaml(path: str) -> dict:
    """Settings from a YAML file on the driver (needs the yaml package)."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs the yaml package") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def write_yaml(settings: object, path: str) -> None:
    """Settings (a mapping, or an instance of a dataclass) as a YAML file that read_yaml() reads back, in their own order; tuples become lists."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("writing YAML settings needs the yaml package") from e
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else x
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(plain(dataclasses.asdict(settings) if dataclasses.is_dataclass(settings) else settings), f, sort_keys=False, allow_unicode=True)


def settings_of(kind: type, settings: dict) -> object:
    """An instance of a dataclass from settings; names that it doesn't have are an error, lists become tuples where its own values are."""
    known = {f.name: f for f in dataclasses.fields(kind)}
    if odd := sorted(set(settings) - set(known)):
        raise ValueError(f"{kind.__name__} has no {odd}")
    tuples = lambda x: tuple(tuples(v) for v in x) if isinstance(x, (list, tuple)) else x
    own = kind()
    return dataclasses.replace(own, **{k: tuples(v) if isinstance(getattr(own, k), tuple) else v for k, v in settings.items()})
