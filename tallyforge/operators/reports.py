"""Reports composed from one pass over a table: what a curated dataset holds, and which arm to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from . import ordering

#: Sections of quality_facts(): which columns of the audit a fact is counted by, and what must hold.
SECTIONS = ("counts", "exclusions", "flags", "validation", "difficulty")


def quality_facts(audit: DataFrame) -> DataFrame:
    """section, a, b, n, mean, share_zero, share_one, share_band: all numbers of a dataset's report, from one scan.

    audit: a row for each instance with split (excluded for those that are left out), variant, track, reason ('' if kept), flags (array of string, NAME or NAME:detail), status (of its validation), p_hat (null where none was measured). Each row states its facts, and facts are summed before they are dealt out, so the result is as small as there are kinds of them.

    counts: rows by split (a) and variant (b; null for all of a split); exclusions: by reason; flags: of kept rows, by name; validation: by track (a) and status (b); difficulty: of measured rows, by variant, with mean p_hat and the shares of 0, of 1 and of [0.2, 0.8]. A row without flags, reason or status has none of those facts; null splits and variants count as 'none'.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    none = F.lit(None).cast("string")
    fact = lambda section, a, b, p=None: F.struct(F.lit(section).alias("section"), a.alias("a"), b.alias("b"), (F.lit(None).cast("double") if p is None else p).alias("p"))
    kept = F.coalesce("reason", F.lit("")) == ""
    flags = F.when(kept, F.coalesce("flags", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    p = F.col("p_hat").cast("double")
    facts = F.concat(
        F.array(fact("counts", text("split"), text("variant")), fact("counts", text("split"), none)),
        F.array_compact(F.array(F.when(~kept, fact("exclusions", F.col("reason"), none)), F.when(F.col("status").isNotNull(), fact("validation", text("track"), F.col("status"))), F.when(p.isNotNull(), fact("difficulty", text("variant"), none, p)))),
        F.transform(flags, lambda f: fact("flags", F.substring_index(f, ":", 1), none)),
    )
    each = audit.select(F.explode(facts).alias("f")).select("f.*")
    share = lambda c: F.avg(c.cast("int"))
    return each.groupBy("section", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"), share(F.col("p") == 0).alias("share_zero"), share(F.col("p") == 1).alias("share_one"), share(F.col("p").between(0.2, 0.8)).alias("share_band"))


def quality_report(facts: DataFrame, title: str, meanings: dict[str, str] | None = None, limit: int = 10_000) -> str:
    """quality_facts() as Markdown: counts by split and variant, exclusions, flags, validation and difficulty, largest first. meanings: what a reason or flag means."""
    rows = {s: [] for s in SECTIONS}
    for r in sinks.small(facts, limit):
        rows[r.section].append(r)
    said = meanings or {}
    line = lambda *cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    head = lambda *names: [line(*names), "|" + "---|" * len(names)]
    counts = {(r.a, r.b): r.n for r in rows["counts"]}
    variants = sorted({b for _, b in counts if b is not None})
    splits = sorted({a for a, _ in counts}, key=lambda a: (a == "excluded", a))
    out = [f"# {title}", "", "## Rows by split", "", *head("split", "total", *variants), *[line(s, counts[s, None], *[counts.get((s, v), 0) for v in variants]) for s in splits]]
    for section, name in (("exclusions", "Exclusions by reason"), ("flags", "Flags of kept rows")):
        out += ["", f"## {name}", "", *head("name", "rows", "meaning"), *[line(r.a, r.n, said.get(r.a, "")) for r in sorted(rows[section], key=lambda r: (-r.n, r.a))]]
    out += ["", "## Validation", "", *head("track", "status", "rows"), *[line(r.a, r.b, r.n) for r in sorted(rows["validation"], key=lambda r: (r.a, -r.n, r.b))]]
    if rows["difficulty"]:
        out += ["", "## Measured difficulty", "", *head("variant", "rows", "mean rate", "never solved", "always solved", "in 0.2 to 0.8"), *[line(r.a, r.n, f"{r.mean:.3f}", *[f"{x:.1%}" for x in (r.share_zero, r.share_one, r.share_band)]) for r in sorted(rows["difficulty"], key=lambda r: r.a)]]
    return "\n".join(out) + "\n"


#: Sheets of a study's workbook, in their order.
SHEETS = ("Experiments", "TrainingCurves", "RubricVersions", "VerifierVersions", "RewardVersions", "Ablations", "InstanceResults", "DatasetAudit", "Difficulty", "EnvironmentManifest", "FinalSelection")


def study_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """A workbook of a study: a sheet for each of SHEETS, those without a table saying so. DatasetAudit is, if not given, the rows of InstanceResults whose status isn't ok."""
    if odd := sorted(set(tables) - set(SHEETS)):
        raise ValueError(f"no such sheets: {odd}")
    known = dict(tables)
    if "DatasetAudit" not in known and "status" in (known["InstanceResults"].columns if "InstanceResults" in known else ()):
        known["DatasetAudit"] = known["InstanceResults"].where(~F.col("status").eqNullSafe("ok"))
    empty = next(iter(known.values())).sparkSession.range(0).select() if known else None
    if empty is None:
        raise ValueError("a workbook needs at least one table")
    sinks.write_workbook({name: known.get(name, empty) for name in SHEETS}, path)


def final_selection(arms: DataFrame, solved: DataFrame, baseline: Column, samples: int = 8, z: float = 1.0, validation_n: int = 435, most_grad: float = 100.0, most_invalid: float = 0.6) -> DataFrame:
    """arms with test_solve, test_reward, test_n, primary, primary_se, delta, significant, stable and rank.

    arms: experiment_id, val_resolved, val_p2p, val_apply, val_invalid, max_grad_norm (arms whose run ended well). solved: experiment_id, variant, n_instances, mean_p_hat, mean_reward (measured on the test split). Test figures are means weighted by instances. The primary metric is the test solve rate if any arm has one, else val_resolved; its standard error is that of a rate over all samples of the test split (the largest number of instances that an arm has there, times samples), or over validation_n. significant: the distance to the baseline arm (the first by experiment_id that `baseline` holds for; null without one) is over z standard errors of a difference. stable: gradients stay below most_grad (a missing norm doesn't) and invalid responses below most_invalid (missing ones do). Ranked by stable, primary, val_p2p, val_apply, ties by experiment_id.
    """
    by_n = lambda c: F.sum(F.col(c) * F.col("n_instances")) / F.sum("n_instances")
    tests = solved.groupBy("experiment_id").agg(by_n("mean_p_hat").alias("test_solve"), by_n("mean_reward").alias("test_reward"), F.sum("n_instances").alias("test_n"))
    rows = arms.join(tests, "experiment_id", "left")
    measured, largest = rows.agg(F.count("test_solve"), F.max("test_n")).head()  # two numbers
    name, n = ("test_solve", largest * samples) if measured else ("val_resolved", validation_n)
    rows = rows.withColumn("primary", F.col(name))
    base = rows.where(baseline).agg(F.min_by(F.coalesce("primary", "val_resolved"), "experiment_id")).head()[0]  # one number
    p = F.col("primary")
    rows = rows.withColumn("primary_se", F.sqrt(F.greatest(p * (1 - p), F.lit(1e-6)) / n)).withColumn("delta", p - F.lit(base).cast("double"))
    rows = rows.withColumn("significant", F.abs("delta") > z * F.col("primary_se") * 2**0.5)
    rows = rows.withColumn("stable", (F.coalesce("max_grad_norm", F.lit(1e9)) < most_grad) & (F.coalesce("val_invalid", F.lit(0.0)) < most_invalid))
    return ordering.ranked(rows, "stable", "primary", "val_p2p", "val_apply", tie="experiment_id")


def run_summary(curves: DataFrame, decided: DataFrame | None = None, run: str = "run") -> DataFrame:
    """A row for each run: n_steps, and of its curves (run, step, reward, kl, entropy, grad_norm) the last step's reward, kl and entropy and the largest gradient norm; with the decisions on runs (statistics.decisions()), if given."""
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step")))
    out = curves.groupBy(run).agg(F.count_distinct("step").alias("n_steps"), at("reward").alias("final_reward"), at("kl").alias("final_kl"), at("entropy").alias("final_entropy"), F.max("grad_norm").alias("max_grad_norm"))
    return out if decided is None else out.join(decided.select(F.col("run").alias(run), "decision", "reason"), run, "left")
