"""Recorded test runs: summary lines, test ids, outcomes, effective sets, rubrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

# Patterns of test output.
ANSI = "\x1b\\[[0-9;]*[A-Za-z]"
CASE = r"(?m)^[ \t]*(PASSED|FAILED|ERROR|XFAIL|XPASS|SKIPPED)[ \t]+(\S+)"
BROKEN = r"No module named pytest|INTERNALERROR|unrecognized arguments|ImportError while loading conftest|usage: pytest"
RAN = r"collected \d+ item|no tests ran|=+ (test session starts|ERRORS|FAILURES)"
P2P_CAP = 30
CHECKABLE = ("failing_test", "tests_pass", "output_format", "complexity", "no_extra")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ANSI, "")


def parse_summary(text: Column) -> Column:
    """map of test id to status; of an id that is listed twice the last status. Ids keep the order of their first mention."""
    found = let(strip_ansi(text), lambda x: F.struct(F.regexp_extract_all(x, F.lit(CASE), F.lit(2)).alias("ids"), F.regexp_extract_all(x, F.lit(CASE), F.lit(1)).alias("status")))

    def last(f: Column) -> Column:
        back = let(F.reverse(f["ids"]), lambda b: F.transform(F.array_distinct(f["ids"]), lambda n: F.element_at(f["status"], F.size(b) - F.array_position(b, n).cast("int") + 1)))
        return F.map_from_arrays(F.array_distinct(f["ids"]), back)

    return let(found, last)


def pytest_ran(text: Column) -> Column:
    plain = strip_ansi(text)
    return plain.rlike(RAN) & ~plain.rlike(BROKEN)


def clean_ids(ids: Column) -> Column:
    """Ids with `::`; a parameter that was cut off goes; in order, without repeats."""
    real = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda t: t.contains("::"))
    return F.array_distinct(F.transform(real, lambda t: F.when(t.contains("[") & ~t.endswith("]"), F.substring_index(t, "[", 1)).otherwise(t)))


def as_list(col: Column, is_text: bool) -> Column:
    """An array column, or one that holds arrays as JSON text."""
    return F.from_json(col, "array<string>") if is_text else col


def selected_ids(ids: Column, effective: Column | None = None, cap: int | None = None) -> Column:
    """Ids to run: cleaned, not inside a package's __init__.py, in the effective set if that has any, at most cap."""
    out = F.filter(clean_ids(ids), lambda t: ~F.substring_index(t, "::", 1).endswith("__init__.py"))
    if effective is not None:
        out = F.when(F.size(F.coalesce(effective, F.array().cast("array<string>"))) > 0, F.filter(out, lambda t: F.array_contains(effective, t))).otherwise(out)
    return F.slice(out, 1, cap) if cap else out


def matched_by(names: Column) -> Column:
    """All ids that match one of the names: a name itself, and what stands before each `[` or `::` in it."""
    parts = lambda name: F.split(name, r"(?=\[|::)")
    heads = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), ""))
    return F.array_distinct(F.flatten(F.transform(names, lambda name: let(parts(name), heads))))


def evaluate(results: Column, ids: Column) -> Column:
    """struct(passed, failed, missing): an id passes if all that match it (itself, its parameters, its members) passed; without a match it is missing. Ids keep their order, a repeated one counts once. Ids and what matches them meet in hash sets, so a row costs what it holds."""

    def sorted_out(x: Column) -> Column:
        there = F.array_intersect(ids, x["all"])
        return F.struct(F.array_except(there, x["bad"]).alias("passed"), F.array_intersect(ids, x["bad"]).alias("failed"), F.array_except(ids, x["all"]).alias("missing"))

    known = lambda r: F.struct(matched_by(F.map_keys(r)).alias("all"), matched_by(F.map_keys(F.map_filter(r, lambda k, v: v != "PASSED"))).alias("bad"))
    return let(let(results, known), sorted_out)


def outcome_fraction(outcome: Column, empty: float = 0.0) -> Column:
    n = F.size(outcome["passed"])
    total = n + F.size(outcome["failed"]) + F.size(outcome["missing"])
    return F.when(total > 0, n / total).otherwise(F.lit(empty))


def effective_f2p(f2p: Column, empty_failed: Column, gold_failed: Column) -> Column:
    """Ids that fail without a change and do not fail with the reference one, in order."""
    return F.filter(f2p, lambda t: F.array_contains(empty_failed, t) & ~F.array_contains(gold_failed, t))


def effective_p2p(p2p: Column, *failed_or_missing: Column) -> Column:
    """Ids that neither fail nor are missing in any of the runs, in order."""
    gone = F.concat(*failed_or_missing)
    return F.filter(p2p, lambda t: ~F.array_contains(gone, t))


def norm_out(text: Column) -> Column:
    """Program output for comparison: outer white space and that at line ends removed."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[^\S\n]+(?=\n)", "")


def evaluate_rubric(rubrics: Column, *, ran: Column, timed_out: Column, f2p_frac: Column, p2p_all: Column, status: Column, fmt: Column, touched: Column, patch_len: Column, gold_touched: Column, gold_len: Column, requested_fmt: str = "fenced_diff", max_extra_ratio: float = 3.0) -> Column:
    """struct(score, checked, satisfied, total_points) over those criteria (criterion, points, tags map) that a run can check, weighted by points."""
    yes = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    subset = F.when(F.size(gold_touched) > 0, F.size(F.array_except(touched, gold_touched)) == 0).otherwise(F.lit(True))
    small = F.when(gold_len > 0, patch_len <= max_extra_ratio * F.greatest(F.lit(1), gold_len)).otherwise(F.lit(True))
    extra = F.when(F.size(touched) <= 0, 0.0).when(subset & small, 1.0).when(subset | small, 0.5).otherwise(0.0)
    formatted = (status == "diff_parse_success") & (F.lit(requested_fmt == "any") | (fmt == requested_fmt))
    marks = F.create_map(
        F.lit("failing_test"), F.when(ran, f2p_frac).otherwise(F.lit(0.0)), F.lit("tests_pass"), yes(ran & p2p_all), F.lit("output_format"), yes(formatted), F.lit("complexity"), yes(ran & ~timed_out), F.lit("no_extra"), extra
    )
    verify = lambda c: F.trim(F.coalesce(c["tags"]["verify"], F.lit("")))
    checked = F.filter(rubrics, lambda c: verify(c).isin(*CHECKABLE))
    total = F.aggregate(checked, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["points"], F.lit(0.0)))
    got = F.aggregate(checked, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["points"], F.lit(0.0)) * marks[verify(c)])
    return F.struct(F.when(total != 0, got / total).otherwise(F.lit(0.0)).alias("score"), F.size(checked).alias("checked"), got.alias("satisfied"), total.alias("total_points"))
