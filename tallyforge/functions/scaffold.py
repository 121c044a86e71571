"""Rubric scaffolding of prompts: how many criteria a training step still shows, which, and where they go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScaffoldConfig:
    """Fixed values of the default schedule."""

    enable: bool = True
    total_steps: int = 50
    center_frac: float = 0.20
    steepness: float = 2.5
    min_lam_cutoff: float = 0.01
    group_jitter: float = 0.0
    group_mode: str = "linear"
    max_criteria: int = 6
    stage_boundaries: tuple[float, float] = (0.10, 0.24)


def lam(step: Column, cfg: ScaffoldConfig = ScaffoldConfig()) -> Column:
    """Share of the scaffold left at a step: a falling logistic curve."""
    if not cfg.enable or cfg.total_steps <= 0:
        return F.lit(0.0)
    return 1 / (1 + F.exp(cfg.steepness * 50 / cfg.total_steps * (step - cfg.center_frac * cfg.total_steps)))


def stage(step: Column, cfg: ScaffoldConfig = ScaffoldConfig()) -> Column:
    if not cfg.enable:
        return F.lit("rule")
    done = step / max(1, cfg.total_steps)
    first, second = cfg.stage_boundaries
    return F.when(done < first, "scaffold").when(done < second, "transition").otherwise("rule")


def lam_group(index: Column, size: Column, cfg: ScaffoldConfig = ScaffoldConfig()) -> Column:
    """Factor of the index-th (from 0) of a group's rollouts, from 1 down to 0; 1 where that is unknown."""
    if cfg.group_mode != "linear":
        return F.lit(1.0)
    return F.when(index.isNull() | size.isNull() | (size <= 1), 1.0).otherwise(F.greatest(F.lit(0.0), (size - 1 - index) / (size - 1)))


def n_inject(step: Column, n_criteria: Column, cfg: ScaffoldConfig = ScaffoldConfig(), *, variant: Column | None = None, index: Column | None = None, size: Column | None = None) -> Column:
    """How many criteria to show, halves rounded up."""
    left = lam(step, cfg)
    base = left * F.least(n_criteria, F.lit(cfg.max_criteria))
    if index is not None and size is not None:
        base = base * lam_group(index, size, cfg)
    if cfg.group_jitter > 0 and variant is not None:
        unit = F.conv(F.substring(F.md5(variant), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF
        base = base * F.when(variant != "", 1 + cfg.group_jitter * (2 * unit - 1)).otherwise(1.0)
    n = F.greatest(F.lit(0), F.least(n_criteria, F.floor(base + 0.5).cast("int")))
    return F.when(left < cfg.min_lam_cutoff, 0).otherwise(n)


def select_criteria(rubrics: Column, k: Column | int) -> Column:
    """The k criteria (criterion, points, tags map) of the lowest scaffold_rank among those that may be shown, in a stable order."""
    ranked = F.transform(rubrics, lambda c, i: F.struct(F.coalesce(c["tags"]["scaffold_rank"].cast("int"), F.lit(9)).alias("rank"), i.alias("at"), F.coalesce(c["tags"]["inject"].cast("boolean"), F.lit(True)).alias("shown"), c["criterion"].alias("criterion")))
    order = F.array_sort(F.filter(ranked, lambda c: c["shown"]))
    return F.transform(F.slice(order, F.lit(1), F.lit(k) if isinstance(k, int) else k), lambda c: c["criterion"])


def scaffold_text(criteria: Column, lang: Column) -> Column:
    head = F.when(lang == "ko", "다음 지침을 따르세요:").otherwise("Follow these guidelines:")
    lines = F.array_join(F.transform(criteria, lambda c: F.concat(F.lit("- "), c)), "\n")
    return F.when(F.size(criteria) > 0, F.concat(head, F.lit("\n"), lines, F.lit("\n"))).otherwise(F.lit(""))


def append_to_last_user(messages: Column, text: Column) -> Column:
    """messages (role, content) with text after the last user message's content; unchanged where text is empty or no user speaks."""
    at = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)))
    changed = F.transform(messages, lambda m, i: F.when(i == at, F.struct(m["role"].alias("role"), F.concat(F.regexp_replace(m["content"], r"\s+$", ""), text).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return F.when((text != "") & at.isNotNull(), changed).otherwise(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def inject(messages: Column, criteria: Column, lang: Column) -> Column:
    text = scaffold_text(criteria, lang)
    return append_to_last_user(messages, F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise(F.lit("")))
