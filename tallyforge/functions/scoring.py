"""Scores of graded responses as column expressions: credit for repaired tests, factors for broken ones, gates, length."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreConfig:
    """Parameters of a score. The defaults are fixed values of the baseline ladder."""

    version: str = "baseline"
    mode: str = "ladder"  # ladder | additive
    gating: bool = True
    s_no_patch: float = 0.0
    s_parse_fail: float = 0.0
    s_invalid: float = 0.0
    s_apply_fail: float = 0.05
    s_applies: float = 0.10
    w_partial: float = 0.60
    s_f2p_all_regressed: float = 0.85
    s_resolved: float = 1.0
    floor_after_p2p: float = 0.05
    f2p_mode: str = "pow"  # binary | linear | sqrt | pow | ladder
    f2p_gamma: float = 1.5
    f2p_ladder: tuple[tuple[float, float], ...] = ((0.34, 0.2), (0.67, 0.5), (1.0, 1.0))
    p2p_mode: str = "pow"  # none | linear | pow | capped | tolerance | confidence | catastrophic
    p2p_max: float = 0.75
    p2p_gamma: float = 1.5
    p2p_tolerance: int = 0
    p2p_cap: float = 0.5
    p2p_conf_z: float = 1.0
    p2p_catastrophic_frac: float = 0.5
    p2p_catastrophic_mult: float = 0.25
    patch_format_weight: float = 0.05
    patch_apply_weight: float = 0.05
    f2p_weight: float = 0.60
    p2p_weight: float = 0.0
    regression_penalty: float = 0.5
    resolved_bonus: float = 0.30
    timeout_penalty: float = 0.0
    rubric_weight: float = 0.0
    rusca_stage: str = "rule"  # scaffold | transition | rule
    overlong_buffer: int = 0
    overlong_penalty: float = 1.0
    max_response_length: int = 4096
    infra_score: float = 0.0
    notes: str = ""

    def to_dict(self) -> dict:
        """As a mapping that YAML can hold and from_dict() reads."""
        return {f.name: [list(x) for x in value] if isinstance(value := getattr(self, f.name), tuple) else value for f in fields(self)}

    @classmethod
    def from_dict(cls, values: dict) -> ScoreConfig:
        """From a parsed YAML mapping; unknown names fail."""
        values = {k: v for k, v in values.items() if k != "_comment"}
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown score settings: {sorted(unknown)}")
        if "f2p_ladder" in values:
            values["f2p_ladder"] = tuple((float(a), float(b)) for a, b in values["f2p_ladder"])
        return cls(**values)


def fraction(n: Column, total: Column, empty: float) -> Column:
    """n / total, or `empty` where there is nothing to count."""
    return F.when(total > 0, n / total).otherwise(F.lit(empty))


def f2p_credit(frac: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Credit in [0, 1] for the share of repaired tests."""
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), frac.cast("double")))
    match cfg.f2p_mode:
        case "binary":
            return F.when(f >= 1, 1.0).otherwise(0.0)
        case "linear":
            return f
        case "sqrt":
            return F.sqrt(f)
        case "pow":
            return F.pow(f, F.lit(cfg.f2p_gamma))
        case "ladder":
            steps = [F.when(f >= at - 1e-9, F.lit(credit)) for at, credit in sorted(cfg.f2p_ladder, reverse=True)]
            return F.coalesce(*steps, F.lit(0.0))
    raise ValueError(f"unknown f2p mode {cfg.f2p_mode}")


def wilson_lower(k: Column, n: Column, z: float = 1.0) -> Column:
    """Lower bound of the Wilson interval of k / n, 0 where n is 0."""
    p, z2 = k / n, z * z
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (p + z2 / (2 * n) - spread) / (1 + z2 / n))).otherwise(F.lit(0.0))


def p2p_factor(passed: Column, total: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Factor on the credit for tests that broke; 1 where there are none to break."""
    broken = F.greatest(F.lit(0), total - passed)
    reg = broken / total
    excused = F.greatest(F.lit(0), broken - cfg.p2p_tolerance) / total
    powered = lambda x: F.greatest(F.lit(0.0), 1 - cfg.p2p_max * F.pow(x, F.lit(cfg.p2p_gamma)))
    match cfg.p2p_mode:
        case "none":
            return F.lit(1.0)
        case "linear":
            out = F.greatest(F.lit(0.0), 1 - cfg.p2p_max * reg)
        case "pow":
            out = powered(reg)
        case "capped":
            out = F.greatest(F.lit(0.0), 1 - F.least(F.lit(cfg.p2p_cap), cfg.p2p_max * reg))
        case "tolerance":
            out = powered(excused)
        case "confidence":
            out = powered(wilson_lower(broken, total, cfg.p2p_conf_z))
        case "catastrophic":
            out = F.when(reg >= cfg.p2p_catastrophic_frac, F.lit(cfg.p2p_catastrophic_mult)).otherwise(powered(excused))
        case _:
            raise ValueError(f"unknown p2p mode {cfg.p2p_mode}")
    return F.when(total > 0, out).otherwise(F.lit(1.0))


def state(extract_status: Column, err_kind: Column, apply_status: Column, ran: Column) -> Column:
    """no_patch, parse_fail, invalid, infra, apply_fail or ran; the first that holds."""
    kind = F.coalesce(err_kind, F.lit("ok"))
    return (
        F.when(extract_status == "no_patch", "no_patch")
        .when(extract_status == "diff_parse_fail", "parse_fail")
        .when(kind.startswith("invalid_"), "invalid")
        .when(kind.startswith("infra_"), "infra")
        .when((kind == "format_apply_fail") | F.coalesce(apply_status == "patch_apply_fail", F.lit(False)), "apply_fail")
        .when(F.coalesce(ran, F.lit(False)), "ran")
        .otherwise("infra")
    )


def overlong(response_len: Column, cfg: ScoreConfig) -> Column:
    """Penalty (0 or below) that grows over the last overlong_buffer tokens of the allowed length."""
    if cfg.overlong_buffer <= 0 or cfg.max_response_length <= 0:
        return F.lit(0.0)
    over = response_len - (cfg.max_response_length - cfg.overlong_buffer)
    return F.when(over > 0, -F.least(F.lit(1.0), over / cfg.overlong_buffer) * cfg.overlong_penalty).otherwise(F.lit(0.0))


#: What scored() reads; those that a table lacks get these values.
INPUTS = {"extract_status": "diff_parse_success", "err_kind": "ok", "apply_status": "patch_apply_success", "ran": True, "f2p_passed": 0, "f2p_total": 0, "p2p_passed": 0, "p2p_total": 0, "rubric_score": 0.0, "timed_out": False, "response_len": None, "patch_fmt": "none", "parser": "", "track": ""}
#: The columns of a scored row, always all of them, in order; score repeats final_reward.
ROW = (
    "patch_extraction_score", "patch_format_score", "patch_apply_score", "f2p_score", "f2p_frac", "p2p_preservation_score", "p2p_frac", "rubric_score", "rule_correctness_score", "timeout_error_penalty", "length_component",
    "final_reward", "score_before_overlong", "answer_match", "infra_excluded", "gated_out", "err_kind", "state", "patch_fmt", "parser", "track", "n_f2p", "t_f2p", "n_p2p", "t_p2p", "touched_files", "hack_flags",
    "reward_version", "verifier_version", "rubric_version", "score",
)


def reward_columns(columns: list[str], cfg: ScoreConfig = ScoreConfig()) -> dict[str, Column]:
    """The score of each row and its parts, from outcome columns (INPUTS)."""
    get = lambda name: F.col(name) if name in columns else F.lit(INPUTS[name])
    st = state(get("extract_status"), get("err_kind"), get("apply_status"), get("ran"))
    ran = st == "ran"
    frac = F.when(ran, fraction(get("f2p_passed"), get("f2p_total"), 0.0)).otherwise(F.lit(0.0))
    kept = F.when(ran, fraction(get("p2p_passed"), get("p2p_total"), 1.0)).otherwise(F.lit(1.0))
    credit = F.when(ran, f2p_credit(frac, cfg)).otherwise(F.lit(0.0))
    factor = F.when(ran, p2p_factor(get("p2p_passed"), get("p2p_total"), cfg)).otherwise(F.lit(1.0))
    resolved = ran & (frac >= 1) & (kept >= 1)
    formatted = get("extract_status") == "diff_parse_success"
    applied = ran | get("apply_status").isin("patch_apply_success", "git_apply_check_success")
    rubric = F.coalesce(get("rubric_score"), F.lit(0.0))
    weight = cfg.rubric_weight if cfg.rusca_stage != "rule" else 0.0
    if cfg.mode == "ladder":
        full = F.when(kept >= 1, F.lit(cfg.s_resolved)).otherwise(F.greatest(F.lit(cfg.floor_after_p2p), cfg.s_f2p_all_regressed * factor))
        if weight > 0:
            full = F.least(F.lit(1.0), full + weight * rubric * F.when(kept >= 1, F.lit(1.0)).otherwise(factor))
        part = F.greatest(F.lit(cfg.floor_after_p2p), (cfg.s_applies + cfg.w_partial * credit + weight * rubric) * factor)
        gates = {"infra": cfg.infra_score, "no_patch": cfg.s_no_patch, "parse_fail": cfg.s_parse_fail, "invalid": cfg.s_invalid, "apply_fail": cfg.s_apply_fail}
        base = F.when(frac >= 1, full).otherwise(part)
        for name, value in gates.items():
            base = F.when(st == name, F.lit(value)).otherwise(base)
    elif cfg.mode == "additive":
        base = cfg.patch_format_weight * formatted.cast("double") + cfg.patch_apply_weight * applied.cast("double")
        base = base + F.when(ran | F.lit(not cfg.gating), weight * rubric).otherwise(0.0)
        earned = cfg.f2p_weight * credit + cfg.p2p_weight * kept + F.when(resolved, cfg.resolved_bonus).otherwise(0.0) - cfg.regression_penalty * (1 - factor)
        base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.when(ran, earned).otherwise(0.0)))
        base = F.when(st == "infra", F.lit(cfg.infra_score)).when(st == "invalid", F.lit(cfg.s_invalid)).otherwise(base)
    else:
        raise ValueError(f"unknown mode {cfg.mode}")
    timeout = F.when(F.coalesce(get("timed_out"), F.lit(False)), F.lit(-cfg.timeout_penalty)).otherwise(F.lit(0.0))
    before = base + timeout  # after the clip, so it can go below 0
    length = overlong(get("response_len"), cfg)
    return {
        "state": st,
        "err_kind_out": F.when(st == "no_patch", "format_no_patch").when(st == "parse_fail", "format_parse_fail").otherwise(F.coalesce(get("err_kind"), F.lit("ok"))),
        "patch_extraction_score": (get("extract_status") != "no_patch").cast("double"),
        "patch_format_score": formatted.cast("double"),
        "patch_apply_score": applied.cast("double"),
        "f2p_frac": frac,
        "f2p_score": credit,
        "p2p_frac": kept,
        "p2p_preservation_score": factor,
        "rule_correctness_score": resolved.cast("double"),
        "answer_match": resolved.cast("double"),
        "rubric_score": rubric,
        "n_f2p": get("f2p_passed").cast("double"),
        "t_f2p": get("f2p_total").cast("double"),
        "n_p2p": get("p2p_passed").cast("double"),
        "t_p2p": get("p2p_total").cast("double"),
        "patch_fmt": F.coalesce(get("patch_fmt"), F.lit("none")),
        "parser": F.coalesce(get("parser"), F.lit("")),
        "track": F.coalesce(get("track"), F.lit("")),
        "touched_files": F.greatest(F.lit(0), F.size("touched_files")).cast("double") if "touched_files" in columns else F.lit(0.0),
        "hack_flags": F.array_join(F.array_distinct("hack_flags"), ";") if "hack_flags" in columns else F.lit(""),
        "reward_version": F.lit(cfg.version),
        "timeout_error_penalty": timeout,
        "infra_excluded": (st == "infra").cast("double"),
        "gated_out": st.isin("no_patch", "parse_fail", "invalid", "apply_fail").cast("double"),
        "score_before_overlong": before,
        "length_component": length,
        "final_reward": before + length,
    }


def scored(df, cfg: ScoreConfig = ScoreConfig()):
    """df with the columns of reward_columns() (those of df that are named alike give way) and score, which repeats final_reward."""
    out = df.withColumns(reward_columns(df.columns, cfg))
    return out.withColumn("score", F.col("final_reward"))


def baseline_score(st: Column, f2p_frac: Column, p2p_frac: Column) -> Column:
    """The baseline ladder in closed form, from a state and two shares: what scored() must give with default settings for states other than parse_fail and infra."""
    lost = F.greatest(F.lit(0.0), 1 - p2p_frac)
    factor = 1 - 0.75 * F.pow(lost, F.lit(1.5))
    ran = F.when((f2p_frac >= 1) & (lost <= 0), 1.0).otherwise(F.greatest(F.lit(0.05), F.when(f2p_frac >= 1, 0.85).otherwise(0.10 + 0.60 * F.pow(f2p_frac, F.lit(1.5))) * factor))
    return F.when(st.isin("no_patch", "invalid"), 0.0).when(st == "apply_fail", 0.05).otherwise(ran)


def score_rows(df, cfg: ScoreConfig = ScoreConfig(), *, keep: tuple[str, ...] = (), verifier_version: str = "", rubric_version: str = ""):
    """keep, the columns of ROW and resp_len, for outcomes as scored() takes them (and touched_files, hack_flags: arrays)."""
    made = reward_columns(df.columns, cfg)
    made |= {"err_kind": made.pop("err_kind_out"), "score": made["final_reward"], "verifier_version": F.lit(verifier_version), "rubric_version": F.lit(rubric_version)}
    length = F.col("response_len") if "response_len" in df.columns else F.lit(None)
    return df.select(*keep, *[F.coalesce(made[name], F.lit("")).alias(name) if name in TEXTS else F.coalesce(made[name].cast("double"), F.lit(0.0)).alias(name) for name in ROW], length.cast("long").alias("resp_len"))


TEXTS = {"err_kind", "state", "patch_fmt", "parser", "track", "hack_flags", "reward_version", "verifier_version", "rubric_version"}


def clean_number(x: Column, kind: str) -> Column:
    """Output cells: booleans as 0 or 1, null, NaN and infinities as 0, arrays joined by semicolons, else as they are."""
    if kind == "boolean":
        return F.coalesce(x.cast("double"), F.lit(0.0))
    if kind in ("double", "float"):
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double"))
    if kind.startswith("array"):
        return F.array_join(x.cast("array<string>"), ";", "")
    if kind == "string":
        return x
    return F.coalesce(x.cast("double"), F.lit(0.0))


def cleaned(df):
    """df with every cell by clean_number() and structs flattened to dotted names."""
    flat = []

    def walk(fields, path):
        for f in fields:
            name = [*path, f.name]
            col = F.col(".".join(f"`{p}`" for p in name))
            if f.dataType.typeName() == "struct":
                walk(f.dataType.fields, name)
            else:
                flat.append(clean_number(col, f.dataType.simpleString()).alias(".".join(name)))

    walk(df.schema.fields, [])
    return df.select(*flat)
