import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scaffold, scoring

BASE = {"extract_status": "diff_parse_success", "err_kind": "ok", "apply_status": "patch_apply_success", "ran": True, "f2p_passed": 0, "f2p_total": 10, "p2p_passed": 30, "p2p_total": 30, "rubric_score": 0.0, "timed_out": False, "response_len": 0}
SCHEMA = "extract_status string, err_kind string, apply_status string, ran boolean, f2p_passed int, f2p_total int, p2p_passed int, p2p_total int, rubric_score double, timed_out boolean, response_len int"


def rows(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c)[f.split()[0]] for f in SCHEMA.split(", ")) for c in changes], SCHEMA)


def scores(spark, cfg, *changes):
    return [r.score for r in scoring.scored(rows(spark, *changes), cfg).collect()]


def test_known_ladder_values(spark):
    got = scores(spark, scoring.ScoreConfig(), {"f2p_passed": 5}, {"f2p_passed": 10, "p2p_passed": 29}, {"f2p_passed": 10, "p2p_passed": 0}, {"f2p_passed": 10})
    assert [round(x, 3) for x in got] == [0.312, 0.846, 0.212, 1.0]


def test_states_in_order(spark):
    df = rows(spark, {"extract_status": "no_patch"}, {"extract_status": "diff_parse_fail"}, {"err_kind": "invalid_edits_tests"}, {"err_kind": "infra_other"}, {"apply_status": "patch_apply_fail"}, {}, {"ran": False})
    assert [r.state for r in scoring.scored(df).collect()] == ["no_patch", "parse_fail", "invalid", "infra", "apply_fail", "ran", "infra"]


def test_grid_equals_the_formula_and_grows_with_repairs(spark):
    grid = [(f, p) for f in (0, 2, 5, 8, 9, 10) for p in (0, 15, 29, 30)]
    got = scores(spark, scoring.ScoreConfig(), *[{"f2p_passed": f, "p2p_passed": p} for f, p in grid])
    for (f, p), x in zip(grid, got):
        m = 1 - 0.75 * (1 - p / 30) ** 1.5
        want = (1.0 if p == 30 else max(0.05, 0.85 * m)) if f == 10 else max(0.05, (0.1 + 0.6 * (f / 10) ** 1.5) * m)
        assert x == pytest.approx(want)
    by_p = {p: [x for (_, q), x in zip(grid, got) if q == p] for p in (0, 15, 29, 30)}
    assert all(xs == sorted(xs) for xs in by_p.values())


def test_additive_timeout_comes_after_the_clip_and_length_last(spark):
    cfg = scoring.ScoreConfig(mode="additive", timeout_penalty=0.4, overlong_buffer=100, max_response_length=1000)
    got = scores(spark, cfg, {"f2p_passed": 10, "timed_out": True}, {"extract_status": "no_patch", "ran": False, "apply_status": "", "timed_out": True}, {"f2p_passed": 10, "response_len": 950})
    assert got == pytest.approx([0.6, -0.4, 0.5])


def test_unknown_settings_fail():
    with pytest.raises(ValueError):
        scoring.ScoreConfig.from_dict({"nope": 1})
    assert scoring.ScoreConfig.from_dict({"f2p_ladder": [[0.5, 0.1]]}).f2p_ladder == ((0.5, 0.1),)


def test_nulls_and_nan_clean_to_zero(spark):
    df = spark.createDataFrame([(None, float("nan"), [None, "a"], True)], "a int, b double, c array<string>, d boolean")
    assert tuple(scoring.cleaned(df).head()) == (0.0, 0.0, ";a", 1.0)


def test_scaffold_points(spark):
    df = spark.createDataFrame([(0,), (10,), (12,), (40,)], "s int")
    got = df.select(F.round(scaffold.lam(F.col("s")), 4).alias("l"), scaffold.n_inject(F.col("s"), F.lit(5)).alias("n"), scaffold.stage(F.col("s")).alias("g")).collect()
    assert [tuple(r) for r in got] == [(1.0, 5, "scaffold"), (0.5, 3, "transition"), (0.0067, 0, "rule"), (0.0, 0, "rule")]
