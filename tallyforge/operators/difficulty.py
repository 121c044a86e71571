"""Difficulty of instances from their rollouts, and summaries of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLLOUT = (
    "instance_id string, data_source string, variant_type string, sample_idx int, prompt_tokens long, response_tokens long, finish_reason string, response string,"
    " rule_correctness_score double, final_reward double, f2p_frac double, patch_extraction_score double, patch_format_score double, patch_apply_score double, infra_excluded double, err_kind string"
)


def per_instance(rollouts: DataFrame, key: str = "instance_id", variant: str = "variant_type") -> DataFrame:
    """A row for each instance: success rate, reward mean and population deviation, rates, over rows that the infrastructure didn't spoil (0 where there are none); tokens over all rows; err_kinds, a map of counts.

    One shuffle for the numbers and one for the histogram, both behind partial aggregates.
    """
    good = F.coalesce(F.col("infra_excluded").cast("double"), F.lit(0.0)) == 0
    mean = lambda c: F.coalesce(F.avg(F.when(good, c)), F.lit(0.0))
    numbers = rollouts.groupBy(key).agg(
        F.min(variant).alias("variant_type"),
        F.count(F.when(good, 1)).alias("n"),
        F.count(F.when(~good, 1)).alias("n_infra"),
        mean(F.col("rule_correctness_score")).alias("p_hat"),
        mean(F.col("final_reward")).alias("mean_reward"),
        F.coalesce(F.stddev_pop(F.when(good, F.col("final_reward"))), F.lit(0.0)).alias("reward_std"),
        mean(((F.col("f2p_frac") > 0) & (F.col("f2p_frac") < 1)).cast("double")).alias("frac_partial"),
        F.coalesce(F.max(F.when(good, F.col("f2p_frac"))), F.lit(0.0)).alias("max_f2p_frac"),
        mean(F.col("f2p_frac")).alias("mean_f2p_frac"),
        mean(F.col("patch_extraction_score")).alias("extract_rate"),
        mean(F.col("patch_format_score")).alias("format_rate"),
        mean(F.col("patch_apply_score")).alias("apply_rate"),
        F.avg("response_tokens").alias("mean_resp_tokens"),
    )
    if "err_kind" not in rollouts.columns:
        return numbers
    kinds = rollouts.groupBy(key, F.coalesce("err_kind", F.lit("ok")).alias("kind")).count()
    kinds = kinds.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("err_kinds"))
    return numbers.join(kinds, key)


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def per_variant(instances: DataFrame) -> DataFrame:
    p, flat = F.col("p_hat"), F.col("reward_std") == 0
    return instances.groupBy("variant_type").agg(
        F.count(F.lit(1)).alias("n_instances"),
        F.avg("p_hat").alias("mean_p_hat"),
        share(p == 0).alias("frac_zero"),
        share((p == 0) & flat).alias("frac_zero_and_no_signal"),
        share(flat).alias("frac_reward_std_zero"),
        share(p == 1).alias("frac_one"),
        share(p.between(0.2, 0.8)).alias("frac_band"),
        *[F.avg(c).alias(c) for c in ("mean_reward", "extract_rate", "apply_rate", "mean_resp_tokens")],
    )


# Upper ends of the bins of the success rate; each goes from the one before.
BINS = (("very_hard", 0.05), ("hard", 0.2), ("medium", 0.5), ("easy", 0.8), ("very_easy", 0.95))


def difficulty_bin(p: Column, std: Column) -> Column:
    out = F.when((p == 0) & (F.coalesce(std, F.lit(0.0)) == 0), "unsolved_no_signal")
    for name, end in BINS:
        out = out.when(p < end, name)
    return out.otherwise("trivial")


def difficulty_score(p: Column) -> Column:
    """0 (always solved) to 10, halves to the even number."""
    return F.bround(10 * (1 - p)).cast("int")


def train_recommended(p: Column, std: Column) -> Column:
    return p.between(0.05, 0.95) | ((p < 0.05) & (std > 0))


def single_table(rows: DataFrame, instances: DataFrame, key: str = "instance_id") -> DataFrame:
    """rows that have been measured, with what was measured and the bins of it."""
    p, std = F.col("p_hat"), F.coalesce("reward_std", F.lit(0.0))
    out = rows.join(instances.select(key, "n", "p_hat", "mean_reward", "reward_std", "max_f2p_frac", "apply_rate"), key)
    return out.withColumns({"partial_signal": std > 0, "difficulty": difficulty_bin(p, std), "difficulty_score": difficulty_score(p), "train_recommended": train_recommended(p, std)})


def group_report(table: DataFrame, *keys: str) -> DataFrame:
    """Means and shares of each group of the single table."""
    p = F.col("p_hat")
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p_hat"), share(p == 0).alias("share_zero"), share(p.between(0.2, 0.8)).alias("share_band"), F.sum(F.col("train_recommended").cast("long")).alias("train_recommended"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def step_track_means(log: DataFrame, fields: list[str]) -> DataFrame:
    """Means by step and track; a null counts as 0."""
    return log.groupBy("step", "track").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in fields])


def mean_of_track_means(scores: DataFrame, value: str = "value", track: str = "track") -> DataFrame:
    """The unweighted mean of the tracks' means."""
    return scores.groupBy(track).agg(F.avg(value).alias("m")).agg(F.avg("m").alias(value))


def derived_val_metrics(metrics: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: for each name, the mean over data sources of the metrics `section/source/sub/mean@1`. metrics: key, value."""
    pick = lambda section, sub: F.avg(F.when(F.col("key").startswith(section) & F.col("key").contains(f"/{sub}/") & F.col("key").endswith("mean@1"), F.col("value")))
    return metrics.agg(*[pick(*at).alias(name) for name, at in wanted.items()])


def parser_rates(results: DataFrame) -> DataFrame:
    """Extraction and validity rates of each parser and selection; fmts, a map of counts. The results are read once, since they may be costly to make."""
    got, valid = F.col("status") != "no_patch", F.col("status") == "diff_parse_success"
    counts = results.groupBy("parser", "select", "fmt").agg(F.count(F.lit(1)).alias("n"), F.count("status").alias("known"), F.count_if(got).alias("got"), F.count_if(valid).alias("valid"))
    share_ = lambda c: F.sum(c) / F.sum("known")
    fmts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("fmt", F.col("n").alias("count")))))  # an entry for each format
    return counts.groupBy("parser", "select").agg(share_("got").alias("extract_rate"), share_("valid").alias("valid_rate"), F.sum("n").alias("n"), fmts.alias("fmts"))


def recovery_pivot(results: DataFrame, wrappings: list[str]) -> DataFrame:
    """Share of recovered references by parser and selection (rows) and wrapping (columns)."""
    return results.groupBy("parser", "select").pivot("wrapping", wrappings).agg(F.round(F.avg(F.col("recovered_gold").cast("double")), 3))
