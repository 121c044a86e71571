"""A curated dataset from a training table, its validation records and measured success rates: decisions, splits, repaired prompts, enriched rows, files and manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import sinks
from . import curation

SPLITS = ("train", "validation", "test")
#: Columns of the written tables, and of the audit table.
COLUMNS = ("data_source", "prompt", "ability", "reward_model", "extra_info")
AUDIT = ("instance_id", "variant_type", "repo", "lang", "split", "status", "reason", "flags", "n_f2p_effective", "n_p2p_effective", "p_hat_orig", "p_hat_source_orig", "empirical_success_rate")
UNIT_ENVIRONMENT = "python_3.11-slim-bookworm+ut_venv"  # a fixed value


@dataclass(frozen=True)
class BuildConfig:
    version: str = "curated_v1"
    seed: int = 0
    lo: float = 0.05
    hi: float = 0.95
    hard_rule: str = "no_signal"  # no_signal | p_hat
    max_prompt_tokens: int = 30_000
    n_val_units: int = 400
    n_test_units: int = 600
    n_val_repos: int = 3
    n_test_repos: int = 3
    verifier_version: str = "vf_v001"
    reward_version: str = "rw_v001_baseline"
    rubric_version: str = "rb_v001_code_hint"


def decided(rows: DataFrame, repo_records: DataFrame, unit_records: DataFrame, cfg: BuildConfig) -> DataFrame:
    """rows with status, reason, flags and the effective test ids of their validation records.

    rows: TRAINING_ROW with position, and optionally prompt_tokens and judge_verdict. repo_records and unit_records: instance_id and v, as repo_decision() and unit_decision() read it.
    """
    info = F.col("extra_info")
    flat = rows.select(*COLUMNS, "position", *[info[c].alias(c) for c in ("instance_id", "variant_type", "repo", "lang", "harness")], info["p_hat"].alias("p_hat_orig"), info["p_hat_source"].alias("p_hat_source_orig"), *[F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("prompt_tokens", "int"), ("judge_verdict", "string"))])
    flat = curation.first_seen(flat, curation.prompt_text(F.col("prompt")), "position", "instance_id")
    is_repo = F.coalesce(F.col("variant_type").startswith("swe"), F.lit(False))
    none = F.array().cast("array<string>")

    def part(ours: DataFrame, records: DataFrame, decision: tuple, effective: bool) -> DataFrame:
        out = ours.join(records.select("instance_id", "v"), "instance_id", "left")
        ids = lambda c: F.coalesce(F.col(f"v.{c}"), none) if effective else none
        reason, flags = decision
        return out.select("*", reason.alias("reason"), flags.alias("flags"), ids("f2p_effective").alias("f2p_effective"), ids("p2p_effective").alias("p2p_effective")).drop("v")

    both = part(flat.where(is_repo), repo_records, curation.repo_decision(cfg.max_prompt_tokens), True).unionByName(part(flat.where(~is_repo), unit_records, curation.unit_decision(), False))
    return both.withColumn("status", F.when(F.col("reason") == "", "ok").otherwise("excluded"))


def split_rows(rows: DataFrame, cfg: BuildConfig) -> DataFrame:
    """rows (decided()) with split: repositories whole, unit tests by id, both in hash order; excluded rows in none."""
    is_repo = F.coalesce(F.col("variant_type").startswith("swe"), F.lit(False))
    ok = rows.where("status = 'ok'")
    repos = curation.hash_split(ok.where(is_repo).select(F.col("repo").alias("_tf_k")).distinct(), "_tf_k", cfg.n_test_repos, cfg.n_val_repos, cfg.seed)
    units = curation.hash_split(ok.where(~is_repo).select(F.col("instance_id").alias("_tf_k")).distinct(), "_tf_k", cfg.n_test_units, cfg.n_val_units, cfg.seed)
    dealt = lambda ours, key, splits: ours.join(splits, F.col(key).eqNullSafe(F.col("_tf_k")), "left").drop("_tf_k")
    out = dealt(rows.where(is_repo), "repo", repos).unionByName(dealt(rows.where(~is_repo), "instance_id", units))
    return out.withColumn("split", F.when(F.col("status") == "ok", F.col("split")).otherwise("excluded"))


def banded(rows: DataFrame, rates: DataFrame | None, cfg: BuildConfig) -> DataFrame:
    """rows with empirical_success_rate and empirical_n; training rows outside the band are excluded. rates: instance_id, p_hat, reward_std, n."""
    if rates is None:
        return rows.withColumn("empirical_success_rate", F.lit(None).cast("double")).withColumn("empirical_n", F.lit(0).cast("long"))
    out = rows.join(rates.select("instance_id", F.col("p_hat").cast("double").alias("empirical_success_rate"), F.col("n").cast("long").alias("_tf_n"), "reward_std"), "instance_id", "left")
    reason, flag = curation.band(F.col("split"), F.col("empirical_success_rate"), F.col("reward_std"), cfg.lo, cfg.hi, cfg.hard_rule)
    out = out.withColumn("_tf_why", reason).withColumn("_tf_flag", flag)
    gone = F.col("_tf_why") != ""
    return (
        out.withColumn("flags", F.concat("flags", F.array_compact(F.array("_tf_flag"))))
        .withColumn("reason", F.when(gone, F.col("_tf_why")).otherwise(F.col("reason")))
        .withColumn("status", F.when(gone, "excluded").otherwise(F.col("status")))
        .withColumn("split", F.when(gone, "excluded").otherwise(F.col("split")))
        .withColumn("empirical_n", F.coalesce("_tf_n", F.lit(0).cast("long")))
        .drop("_tf_why", "_tf_flag", "_tf_n", "reward_std")
    )


def repaired(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows whose unit-test prompts name what the hidden tests need. units: instance_id, harness, entry_point, assertions (array of string)."""
    names = units.select("instance_id", text.required_names(F.col("harness"), F.col("entry_point"), F.col("assertions")).alias("_tf_names"))
    out = rows.join(names, "instance_id", "left")
    ours = F.when(~F.coalesce(F.col("variant_type").startswith("swe"), F.lit(False)), F.col("_tf_names")).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_tf_names", F.coalesce(ours, F.array().cast("array<string>")))
    fixed = curation.with_names_line(out, F.col("_tf_names"), F.col("lang"))
    return fixed.withColumn("flags", F.when(F.size("_tf_names") > 0, F.concat("flags", F.array(F.lit("PROMPT_FIX_ENTRY_POINT")))).otherwise(F.col("flags"))).drop("_tf_names")


def enriched(rows: DataFrame, cfg: BuildConfig) -> DataFrame:
    """rows whose extra_info says what was decided, measured and by which versions."""
    is_repo = F.coalesce(F.col("variant_type").startswith("swe"), F.lit(False))
    id_ = F.coalesce("instance_id", F.lit(""))
    values = {
        "environment_id": F.when(is_repo, F.substring_index(F.coalesce("extra_info.image_name", F.lit("")), "/", -1)).otherwise(UNIT_ENVIRONMENT),
        "f2p_effective": F.col("f2p_effective"),
        "p2p_effective": F.col("p2p_effective"),
        "n_f2p_effective": F.size("f2p_effective"),
        "n_p2p_effective": F.size("p2p_effective"),
        "empirical_success_rate": F.coalesce("empirical_success_rate", F.lit(-1.0)),
        "empirical_n": F.col("empirical_n"),
        "prompt_tokens": F.coalesce("prompt_tokens", F.lit(-1)),
        "data_quality_status": F.col("status"),
        "exclusion_reason": F.col("reason"),
        "quality_flags": F.array_join("flags", ";"),
        "verifier_version": F.lit(cfg.verifier_version),
        "reward_version": F.lit(cfg.reward_version),
        "rubric_version": F.lit(cfg.rubric_version),
        "dataset_version": F.lit(cfg.version),
        "split": F.col("split"),
        "task_type": F.when(is_repo, "swe_patch").otherwise(F.concat(F.lit("unittest_"), F.coalesce("harness", F.lit("")))),
        "difficulty": F.coalesce("extra_info.difficulty_band", F.lit("")),
        "base_commit": F.when(is_repo & id_.contains("."), F.element_at(F.split(id_, r"\."), 2)).otherwise(""),
        "branch": F.when(is_repo, id_).otherwise(""),
    }
    return curation.enriched(rows, values)


def build(rows: DataFrame, repo_records: DataFrame, unit_records: DataFrame, *, rates: DataFrame | None = None, units: DataFrame | None = None, cfg: BuildConfig = BuildConfig()) -> DataFrame:
    """The whole table: COLUMNS with enriched extra_info, and the columns of AUDIT. Every row of the input is in it once."""
    out = banded(split_rows(decided(rows, repo_records, unit_records, cfg), cfg), rates, cfg)
    out = enriched(repaired(out, units) if units is not None else out, cfg)
    out = out.withColumn("n_f2p_effective", F.size("f2p_effective")).withColumn("n_p2p_effective", F.size("p2p_effective"))
    return out.select(*COLUMNS, *AUDIT)


def write_dataset(spark: SparkSession, built: DataFrame, path: str, cfg: BuildConfig = BuildConfig(), **facts: object) -> dict:
    """Writes the whole table, a table for each split, the excluded rows, instance_audit (CSV) and dataset_manifest (JSON) below path; returns the manifest. The table is computed once and read back for the rest."""
    sinks.write_parquet(built, f"{path}/whole.parquet")
    whole = spark.read.schema(built.schema).parquet(f"{path}/whole.parquet")
    tables = {name: whole.where(F.col("split") == name) for name in SPLITS}
    for name, df in tables.items():
        sinks.write_parquet(df.select(*COLUMNS), f"{path}/{name}.parquet")
    gone = whole.where("status = 'excluded'")
    sinks.write_parquet(gone.select(*COLUMNS, F.col("reason").alias("exclusion_reason"), "instance_id"), f"{path}/excluded.parquet")
    audit = whole.select(*[F.array_join("flags", ";").alias("flags") if c == "flags" else F.col(c) for c in AUDIT]).withColumnRenamed("reason", "exclusion_reason")
    sinks.write_csv(audit, f"{path}/instance_audit.csv")
    is_repo = F.col("variant_type").startswith("swe")
    repos = {name: sorted(r[0] for r in df.where(is_repo & F.col("repo").isNotNull()).select("repo").distinct().collect()) for name, df in tables.items()}
    out = sinks.manifest(tables, "variant_type", version=cfg.version, seed=cfg.seed, band=[cfg.lo, cfg.hi], verifier_version=cfg.verifier_version, reward_version=cfg.reward_version, rubric_version=cfg.rubric_version, swe_repos=repos, **facts)
    out["counts"]["excluded"] = gone.count()
    out["exclusions"] = {r[0]: r[1] for r in curation.reason_counts(whole).collect()}
    out["exclusions_by_variant"] = {f"{r[0]}:{r[1]}": r[2] for r in curation.reason_counts(whole, "variant_type").collect()}
    out["flags"] = {r[0]: r[1] for r in curation.flag_counts(whole).collect()}
    spark.createDataFrame([(sinks.to_json(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/dataset_manifest.json")
    return out


def quality_report(manifest: dict, rates: DataFrame | None = None, meanings: dict[str, str] | None = None) -> str:
    """A Markdown report of a manifest: counts, exclusions, flags and, with rates (variant_type, p_hat), the empirical difficulty of each variant."""
    meanings = meanings or {}
    counts = manifest["counts"]
    variants = sorted({k for name in SPLITS for k in counts[name]} - {"total"})
    row = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    rule = lambda n: "|" + "---|" * n
    ranked = lambda d: sorted(d.items(), key=lambda x: (-x[1], x[0]))
    lines = [f"# Dataset quality report: `{manifest['version']}`", "", "## Counts", "", row(["split", "total", *variants]), rule(2 + len(variants))]
    lines += [row([name, counts[name]["total"], *(counts[name].get(v, 0) for v in variants)]) for name in SPLITS] + [row(["excluded", counts["excluded"], *[""] * len(variants)])]
    for title, key in (("Exclusions by reason", "exclusions"), ("Flags", "flags")):
        lines += ["", f"## {title}", "", row([key, "count", "meaning"]), rule(3), *(row([k, n, meanings.get(k, "")]) for k, n in ranked(manifest[key]))]
    if rates is not None:
        share = lambda c: F.avg(c.cast("double"))
        p = F.col("p_hat")
        by = rates.groupBy("variant_type").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p_hat"), share(p == 0).alias("zero"), share(p == 1).alias("one"), share(p.between(0.2, 0.8)).alias("in_band")).orderBy("variant_type")
        lines += ["", "## Empirical difficulty", "", sinks.to_markdown(by).rstrip("\n")]
    return "\n".join(lines) + "\n"


def ablation_report(runs: DataFrame, family: str, baseline: str, metrics: list[str], *, run: str = "experiment_id", limit: int = 1000) -> str:
    """A Markdown table of each family's runs with the differences of their metrics to the family's baseline run (a boolean column)."""
    from . import ordering

    table = ordering.delta_to_baseline(runs, family, F.col(baseline), metrics)
    shown = [c for m in metrics for c in (m, f"delta_{m}")]
    parts = ["# Ablation report"]
    for name in sorted(r[0] for r in sinks.small(runs.select(family).distinct().where(F.col(family).isNotNull()), limit)):
        parts += ["", f"## {name}", "", sinks.to_markdown(table.where(F.col(family) == name).select(run, *shown).orderBy(run), limit).rstrip("\n")]
    return "\n".join(parts) + "\n"
