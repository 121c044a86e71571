"""From a response and the recorded outcome of its tests to one scored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patches, scaffold, scoring, testruns
from .curation import registry_lookup

#: What a recorded run holds. The tests of each kind by outcome, as evaluate() gives them.
OUTCOME = "struct<ran:boolean,err_kind:string,apply_status:string,timed_out:boolean,f2p:struct<passed:array<string>,failed:array<string>,missing:array<string>>,p2p:struct<passed:array<string>,failed:array<string>,missing:array<string>>>"
NONE = "array()"


def extraction(response: Column, track: Column, files: Column, parser: str, select: str) -> Column:
    """The patch or code in a response, by its track; nothing for a track that is neither."""
    nothing = F.struct(*[F.lit({"status": patches.NO_PATCH, "fmt": "none", "parser": parser, "n_candidates": 0}.get(name, "")).cast(kind).alias(name) if kind != "array<string>" else F.expr(NONE).cast(kind).alias(name) for name, kind in (f.split() for f in patches.SCHEMA.split(", "))])
    patch = patches.extract_column(F.when(track == "swe", response), parser, select, files)
    code = patches.extract_code_column(F.when(track == "unittest", response), select=select)
    return F.when(track == "swe", patch).when(track == "unittest", code).otherwise(nothing)


def invalid_kind(flags: Column) -> Column:
    """The kind of error that an inspected patch is refused with."""
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    return F.when(has("edits_tests"), "invalid_edits_tests").when(has("path_escape", "edits_verifier", "edits_config"), "invalid_forbidden_path").otherwise("invalid_hack_pattern")


def graded(
    responses: DataFrame,
    tasks: DataFrame,
    outcomes: DataFrame,
    cfg: scoring.ScoreConfig = scoring.ScoreConfig(),
    *,
    key: str = "response_id",
    parser: str = "fallback",
    select: str = "last",
    requested_fmt: str = "fenced_diff",
    forbid_tests: bool = True,
    forbid_config: bool = True,
    verifier_version: str = "",
    rubric_version: str = "",
) -> DataFrame:
    """key, instance_id, data_source, every column of scoring.ROW and resp_len, one row for each response.

    responses: key, instance_id, data_source, response, response_len. tasks (one row for each instance_id): track (swe or unittest), files (sources by path as JSON text), test_ids, gold_patch, rubrics (array of struct criterion, points, tags). outcomes (one row for each key): o, as OUTCOME.

    A response whose instance or track is unknown counts as one without a patch. One without a usable patch or one that inspection refuses needs no outcome; any other that has none is infra_other. Joins are plain equi-joins; the Python of the extraction sees the response and the sources alone.
    """
    known = tasks.select("instance_id", F.col("track").alias("_tf_track"), "files", "test_ids", "gold_patch", "rubrics", F.lit(True).alias("_tf_known"))
    rows = registry_lookup(responses, known.where("_tf_track = 'unittest'"), known.where("_tf_track = 'swe'")).join(known, "instance_id", "left")
    rows = rows.withColumn("_tf_known", F.coalesce("_tf_known", F.lit(False)))
    x = extraction(F.col("response"), F.when(F.col("_tf_known"), F.col("track")), F.col("files"), parser, select)
    rows = rows.withColumn("x", x)
    usable = F.col("x.status") == patches.SUCCESS
    flags = F.when(usable & (F.col("track") == "swe"), patches.inspect_flags(F.col("x.patch"), F.col("x.touched_files"), F.col("test_ids"), forbid_tests, forbid_config)).otherwise(F.expr(NONE).cast("array<string>"))
    rows = rows.withColumn("hack_flags", flags)
    refused = patches.verdict(F.col("hack_flags")) == "invalid"
    rows = rows.withColumn("refused", refused).join(outcomes.select(key, F.col("o").cast(OUTCOME).alias("o")), key, "left")
    seen = usable & ~F.col("refused")
    got = lambda name, default: F.when(seen, F.coalesce(F.col(f"o.{name}"), F.lit(default))).otherwise(F.lit(default))
    n = lambda kind, *parts: sum((F.greatest(F.lit(0), F.coalesce(F.size(F.col(f"o.{kind}.{p}")), F.lit(0))) for p in parts), F.lit(0))
    all_of = ("passed", "failed", "missing")
    kind = (
        F.when(~usable, F.when(F.col("x.status") == patches.NO_PATCH, "format_no_patch").otherwise("format_parse_fail"))
        .when(F.col("refused"), invalid_kind(F.col("hack_flags")))
        .when(F.col("o").isNull(), "infra_other")
        .otherwise(F.coalesce(F.col("o.err_kind"), F.lit("ok")))
    )
    rows = rows.withColumns(
        {
            "extract_status": F.col("x.status"),
            "err_kind": kind,
            "apply_status": got("apply_status", "not_attempted"),
            "ran": got("ran", False),
            "timed_out": got("timed_out", False),
            "f2p_passed": F.when(seen, n("f2p", "passed")).otherwise(0),
            "f2p_total": F.when(seen, n("f2p", *all_of)).otherwise(0),
            "p2p_passed": F.when(seen, n("p2p", "passed")).otherwise(0),
            "p2p_total": F.when(seen, n("p2p", *all_of)).otherwise(0),
            "patch_fmt": F.col("x.fmt"),
            "parser": F.when(F.col("track") == "unittest", "code_block").otherwise(F.col("x.parser")),
            "touched_files": F.col("x.touched_files"),
        }
    )
    gold = F.coalesce("gold_patch", F.lit(""))
    f2p = scoring.fraction(F.col("f2p_passed"), F.col("f2p_total"), 0.0)
    rubric = lambda fmt: testruns.evaluate_rubric(F.col("rubrics"), ran=F.col("ran"), timed_out=F.col("timed_out"), f2p_frac=f2p, p2p_all=F.col("p2p_passed") == F.col("p2p_total"), status=F.col("extract_status"), fmt=F.col("patch_fmt"), touched=F.col("touched_files"), patch_len=F.length("x.patch"), gold_touched=F.col("_tf_gold"), gold_len=F.length(gold), requested_fmt=fmt)["score"]
    rows = rows.withColumn("_tf_gold", patches.touched_column(gold))
    score = F.when(F.coalesce(F.size("rubrics"), F.lit(0)) > 0, F.when(F.col("track") == "unittest", rubric("any")).otherwise(rubric(requested_fmt))).otherwise(0.0)
    rows = rows.withColumn("rubric_score", F.coalesce(score, F.lit(0.0)))
    return scoring.score_rows(rows, cfg, keep=(key, "instance_id", "data_source"), verifier_version=verifier_version, rubric_version=rubric_version)


def with_stage(cfg: scoring.ScoreConfig, step: int, schedule: scaffold.ScaffoldConfig) -> scoring.ScoreConfig:
    """cfg with the scaffold's stage at a step of training, which decides whether rubrics count."""
    from dataclasses import replace

    done = step / max(1, schedule.total_steps)
    first, second = schedule.stage_boundaries
    return replace(cfg, rusca_stage="rule" if not schedule.enable or done >= second else "scaffold" if done < first else "transition")
