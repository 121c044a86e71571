"""From response to scored row."""

from pyspark.sql import functions as F

from tallyforge.functions import scaffold, scoring
from tallyforge.operators import grading

PATCH = "```diff\ndiff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n-a\n+b\n```\n"
RUN = "struct<ran:boolean,err_kind:string,apply_status:string,timed_out:boolean,f2p:struct<passed:array<string>,failed:array<string>,missing:array<string>>,p2p:struct<passed:array<string>,failed:array<string>,missing:array<string>>>"


def rows(spark):
    responses = spark.createDataFrame(
        [
            (1, "swe1", "x", PATCH.format("src/a.py"), 10),
            (2, "swe1", "x", PATCH.format("tests/test_a.py"), 10),
            (3, "swe1", "x", PATCH.format("../a.py"), 10),
            (4, "swe1", "x", "no patch", None),
            (5, "swe1", "x", PATCH.format("src/a.py"), 10),
            (6, "ut1", "x", "```python\nx = 1\n```", 10),
            (7, "ut1", "x", "```python\nx =\n```", 10),
            (8, "gone", "t15_unittest/x", "```python\nx = 1\n```", 10),
            (9, None, "other", None, 10),
            (10, "swe1", "x", PATCH.format("src/a.py"), 10),
        ],
        "response_id long, instance_id string, data_source string, response string, response_len long",
    )
    rubric = [("c", 1.0, {"verify": "failing_test"}), ("d", 3.0, {"verify": "output_format"})]
    tasks = spark.createDataFrame(
        [("swe1", "swe", None, ["src/check.py::t"], PATCH.format("src/a.py"), rubric), ("ut1", "unittest", None, None, None, None)],
        "instance_id string, track string, files string, test_ids array<string>, gold_patch string, rubrics array<struct<criterion:string,points:double,tags:map<string,string>>>",
    )
    run = lambda good, bad, gone=(): (True, "ok", "patch_apply_success", False, (list(good), list(bad), list(gone)), (["p", "q"], [], []))
    outcomes = spark.createDataFrame([(1, run("ab", "")), (2, run("ab", "")), (4, run("ab", "")), (6, run("a", "b", "c")), (10, (False, "infra_timeout", "not_attempted", True, None, None))], f"response_id long, o {RUN}")
    return responses, tasks, outcomes


def test_rows_of_every_state(spark):
    out = grading.graded(*rows(spark), verifier_version="v")
    assert [c for c in out.columns if c in scoring.ROW] == list(scoring.ROW)
    got = {r.response_id: r for r in out.collect()}
    assert len(got) == 10 and all(v is not None for r in got.values() for k, v in r.asDict().items() if k in scoring.ROW)
    state = {k: (r.state, r.err_kind, r.track) for k, r in got.items()}
    assert state == {
        1: ("ran", "ok", "swe"), 2: ("invalid", "invalid_edits_tests", "swe"), 3: ("invalid", "invalid_forbidden_path", "swe"), 4: ("no_patch", "format_no_patch", "swe"), 5: ("infra", "infra_other", "swe"),
        6: ("ran", "ok", "unittest"), 7: ("parse_fail", "format_parse_fail", "unittest"), 8: ("no_patch", "format_no_patch", "unittest"), 9: ("no_patch", "format_no_patch", "unknown"), 10: ("infra", "infra_timeout", "swe"),
    }
    assert (got[1].answer_match, got[1].score, got[1].touched_files, got[1].t_p2p, got[1].hack_flags, got[1].rubric_score) == (1.0, 1.0, 1.0, 2.0, "", 1.0)
    assert (got[2].hack_flags, got[2].t_f2p, got[3].hack_flags) == ("edits_tests", 0.0, "path_escape")
    assert (got[6].n_f2p, got[6].t_f2p, got[6].parser, got[6].patch_fmt) == (1.0, 3.0, "code_block", "fenced_code")
    assert got[4].resp_len is None and got[4].rubric_score == 0.0 and got[5].rubric_score == 0.75


def test_no_responses(spark):
    responses, tasks, outcomes = rows(spark)
    assert grading.graded(responses.where("response_id < 0"), tasks, outcomes).count() == 0
    assert grading.graded(responses, tasks.where("track = 'x'"), outcomes).where("state = 'no_patch'").count() == 10


def test_closed_form_equals_the_ladder(spark):
    df = spark.range(11 * 31).select((F.col("id") % 11).cast("int").alias("f2p_passed"), F.lit(10).alias("f2p_total"), (F.col("id") % 31).cast("int").alias("p2p_passed"), F.lit(30).alias("p2p_total"))
    out = scoring.scored(df).select("score", scoring.baseline_score(F.col("state"), F.col("f2p_frac"), F.col("p2p_frac")).alias("closed"))
    assert out.where(F.abs(F.col("score") - F.col("closed")) > 1e-9).count() == 0


def test_settings_round_trip():
    cfg = scoring.ScoreConfig(f2p_mode="ladder", f2p_ladder=((0.5, 0.1), (1.0, 1.0)))
    assert scoring.ScoreConfig.from_dict(cfg.to_dict()) == cfg
    schedule = scaffold.ScaffoldConfig()
    stages = [grading.with_stage(cfg, k, schedule).rusca_stage for k in (0, int(0.2 * schedule.total_steps), schedule.total_steps)]
    assert stages == ["scaffold", "transition", "rule"]
