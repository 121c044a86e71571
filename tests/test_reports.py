"""Reports, workbooks, committed batches, digests and settings, written and read back."""

import hashlib
import math
import os
import random
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scoring, testruns
from tallyforge.operators import ordering, reports, statistics
from tallyforge.sources import commits, readers, sinks
from tallyforge.streaming import logs


def sheets_of(path):
    """name -> rows of a workbook."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    out = {}
    with zipfile.ZipFile(path) as book:
        names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{space['m']}}}sheet")]
        for k, name in enumerate(names, 1):
            rows = []
            for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{{{space['m']}}}row"):
                cells = []
                for c in row:
                    text = c.find("m:is/m:t", space)
                    value = c.find("m:v", space)
                    cells.append(text.text or "" if text is not None else None if value is None else bool(int(value.text)) if c.get("t") == "b" else float(value.text))
                rows.append(cells)
            out[name] = rows
        assert "[Content_Types].xml" in book.namelist() and "_rels/.rels" in book.namelist()
    return out


def test_workbook_holds_all_cells(spark, tmp_path):
    rows = [(1, "a<b & \"c\"\n ", 0.5, True, ["x"]), (2, None, float("nan"), False, None), (1 << 53, "\x01 é 😀", -1e300, None, [])]
    df = spark.createDataFrame(rows, "k long, s string, d double, b boolean, l array<string>").coalesce(1)
    sinks.write_workbook({"One [1]": df, "Two": df.where("k < 0"), "None": df.select()}, f"{tmp_path}/book.xlsx")
    got = sheets_of(f"{tmp_path}/book.xlsx")
    assert list(got) == ["One _1_", "Two", "None"] and got["Two"] == [["k", "s", "d", "b", "l"]] and got["None"] == [["note"], ["no rows"]]
    assert got["One _1_"][1:] == [[1.0, 'a<b & "c"\n ', 0.5, True, "['x']"], [2.0, None, None, False, None], [float(1 << 53), "� é 😀", -1e300, None, "[]"]]


def test_sheets_go_on_when_they_are_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 11)
    sinks.write_workbook({"n": spark.range(25).coalesce(1), "m": spark.range(10).coalesce(1)}, f"{tmp_path}/book.xlsx")
    got = sheets_of(f"{tmp_path}/book.xlsx")
    assert {k: len(v) for k, v in got.items()} == {"n": 11, "n 2": 11, "n 3": 6, "m": 11}
    assert [r[0] for k in ("n", "n 2", "n 3") for r in got[k][1:]] == [float(x) for x in range(25)]


def test_study_workbook_has_all_sheets(spark, tmp_path):
    instances = spark.createDataFrame([("a", "ok"), ("b", "gold_fail"), ("c", None)], "instance_id string, status string")
    reports.study_workbook({"InstanceResults": instances, "Ablations": instances.limit(1)}, f"{tmp_path}/study.xlsx")
    got = sheets_of(f"{tmp_path}/study.xlsx")
    assert tuple(got) == reports.SHEETS and sorted(r[0] for r in got["DatasetAudit"][1:]) == ["b", "c"] and got["Difficulty"] == [["note"], ["no rows"]]
    with pytest.raises(ValueError, match="no such sheets"):
        reports.study_workbook({"Other": instances}, f"{tmp_path}/x.xlsx")


AUDIT = "split string, variant string, track string, reason string, flags array<string>, status string, p_hat double"


def test_quality_report_has_the_sections(spark):
    rows = [
        ("train", "v1", "swe", "", ["F2P_PRUNED:3", "dup_of:x"], "ok", 0.0), ("train", "v1", "swe", "", ["F2P_PRUNED:1"], "ok", 0.5), ("train", "v2", "ut", "", None, None, None), ("test", None, "ut", "", [], "gold|fail", 1.0),
        ("excluded", "v1", "swe", "NO_TESTS", ["F2P_PRUNED:9"], "ok", 1.0), ("excluded", "v2", None, "DUPLICATE", [], None, None), ("excluded", "v2", None, "NO_TESTS", [], None, None),
    ]
    facts = reports.quality_facts(spark.createDataFrame(rows, AUDIT))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Scan ") == 1 and "partial_count" in plan
    text = reports.quality_report(facts, "Data", {"NO_TESTS": "nothing to run"})
    assert re.findall("^#+ (.*)$", text, re.M) == ["Data", "Rows by split", "Exclusions by reason", "Flags of kept rows", "Validation", "Measured difficulty"]
    for line in ("| split | total | none | v1 | v2 |", "| test | 1 | 1 | 0 | 0 |", "| train | 3 | 0 | 2 | 1 |", "| excluded | 3 | 0 | 1 | 2 |", "| NO_TESTS | 2 | nothing to run |", "| DUPLICATE | 1 |  |", "| F2P_PRUNED | 2 |  |", "| dup_of | 1 |  |", "| swe | ok | 3 |", "| ut | gold\\|fail | 1 |", "| v1 | 3 | 0.500 | 33.3% | 33.3% | 33.3% |"):
        assert line in text.splitlines(), line
    nothing = reports.quality_report(reports.quality_facts(spark.createDataFrame([], AUDIT)), "Data")
    assert "| split | total |" in nothing and "Measured" not in nothing
    with pytest.raises(ValueError):
        reports.quality_report(facts, "Data", limit=3)


def test_final_selection(spark):
    arms = [("e0_baseline", 0.4, 0.9, 0.8, 0.1, 3.0), ("e1", 0.5, 0.9, 0.9, None, 3.0), ("e2", 0.5, 0.9, 0.9, 0.1, None), ("e3", 0.41, 0.5, 0.9, 0.7, 3.0)]
    arms = spark.createDataFrame(arms, "experiment_id string, val_resolved double, val_p2p double, val_apply double, val_invalid double, max_grad_norm double")
    solved = spark.createDataFrame([("e0_baseline", "a", 10, 0.5, 0.1), ("e0_baseline", "b", 30, 0.1, 0.2), ("e1", "a", 10, 0.9, 0.3), ("e9", "a", 1000, 0.9, 0.3)], "experiment_id string, variant string, n_instances long, mean_p_hat double, mean_reward double")
    base = F.col("experiment_id").endswith("baseline")
    got = {r.experiment_id: r for r in reports.final_selection(arms, solved, base).collect()}
    assert [got[e]["rank"] for e in ("e1", "e0_baseline", "e2", "e3")] == [1, 2, 3, 4] and got["e0_baseline"].test_solve == pytest.approx(0.2)
    se = math.sqrt(0.9 * 0.1 / (40 * 8))
    assert got["e1"].primary_se == pytest.approx(se) and got["e1"].delta == pytest.approx(0.7) and got["e1"].significant and got["e2"].primary is None and got["e2"].significant is None
    assert (got["e1"].stable, got["e2"].stable, got["e3"].stable) == (True, False, False)
    plain = {r.experiment_id: r for r in reports.final_selection(arms, solved.where("n_instances < 0"), base).collect()}
    assert plain["e1"].primary == 0.5 and plain["e1"].primary_se == pytest.approx(math.sqrt(0.25 / 435)) and plain["e1"].delta == pytest.approx(0.1)
    alone = reports.final_selection(arms, solved, F.lit(False)).collect()
    assert all(r.delta is None and r.significant is None for r in alone)


def test_run_summary(spark):
    curves = spark.createDataFrame([("a", 1, 0.1, 0.5, None, 2.0), ("a", 3, 0.4, None, 1.5, 9.0), ("a", 2, 0.2, 0.3, 1.0, None), ("b", 1, None, None, None, None)], "run string, step long, reward double, kl double, entropy double, grad_norm double")
    decided = statistics.decisions(spark.createDataFrame([("p", 1, "a", 0.3)], "plan string, at int, run string, v double"), "plan", "at", "run", "v", F.col("at") == 1)
    got = {r.run: tuple(r)[1:] for r in reports.run_summary(curves, decided).collect()}
    assert got == {"a": (3, 0.4, 0.3, 1.5, 9.0, "keep", "baseline"), "b": (1, None, None, None, None, None, None)}


def test_a_batch_that_is_lost_half_way(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/t", "k long"
    assert commits.read_committed(spark, path, schema).count() == 0
    assert commits.commit(spark.range(10).toDF("k"), path, 0)
    inner = commits._path
    monkeypatch.setattr(commits, "_path", lambda s, p: (_ for _ in ()).throw(RuntimeError("killed")) if p.endswith("/_commits/1") else inner(s, p))
    with pytest.raises(RuntimeError, match="killed"):
        commits.commit(spark.range(99).toDF("k"), path, 1)  # written, but killed before its marker
    monkeypatch.undo()
    assert os.path.isdir(commits.folder(f"{tmp_path}/t", 1)) and commits.read_committed(spark, path, schema).count() == 10
    before = commits.read_committed(spark, path, schema)
    assert commits.commit(spark.range(20).toDF("k"), path, 1) and not commits.commit(spark.range(5).toDF("k"), path, 1)
    assert commits.read_committed(spark, path, schema).count() == 20 and before.count() == 10  # a reader of the last table goes on
    for batch in (2, 3):
        commits.commit(spark.range(batch).toDF("k"), path, batch)
    assert commits.committed(spark, path) == [2, 3] and not os.path.isdir(commits.folder(f"{tmp_path}/t", 0))


def test_streams_commit_whole_batches(spark, tmp_path):
    rows = spark.createDataFrame([("i", "swe", 1, 0.5, 1.0), ("j", "swe", 1, None, 0.0)], "instance_id string, track string, step int, final_reward double, infra_excluded double")
    base = f"file://{tmp_path}"
    for turn in (1, 2):
        sinks.append_log(rows, f"{base}/log")
        for start, out in ((lambda log: logs.write_means(logs.running_means(log), f"{base}/means", f"{base}/cp1"), "means"), (lambda log: logs.append_batches(log, f"{base}/all", f"{base}/cp2"), "all")):
            q = start(logs.read_log_stream(spark, f"{base}/log"))
            q.processAllAvailable()
            q.stop()
            assert len(commits.committed(spark, f"{base}/{out}")) == turn
        r = commits.read_committed(spark, f"{base}/means", "step int, track string, n long, final_reward double").collect()
        assert [(x.step, x.track, x.n, x.final_reward) for x in r] == [(1, "swe", 2 * turn, 0.25)]
        assert commits.read_appended(spark, f"{base}/all", "instance_id string, at timestamp").count() == 2 * turn


def test_digests_of_files_of_any_size(spark, tmp_path):
    """Files of many splits, without a last line end, with carriage returns, of raw bytes, and of nothing."""
    rng = random.Random(1)
    files = {"long.txt": b"".join(b"line %d of it\n" % k for k in range(200_000)), "open.bin": bytes(rng.randrange(256) for _ in range(50_000)), "cr.txt": b"a\r\n\r\nb\r", "ends.txt": b"\n\n\n", "empty.txt": b"", "one.txt": b"x"}
    os.mkdir(f"{tmp_path}/files")
    for name, raw in files.items():
        with open(f"{tmp_path}/files/{name}", "wb") as f:
            f.write(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = {os.path.basename(r.path): (r.bytes, r.sha) for r in readers.file_digests(spark, f"file://{tmp_path}/files").collect()}
        assert spark.read.text(f"file://{tmp_path}/files/long.txt").rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: (len(raw), hashlib.sha256(raw).hexdigest()[:16]) for name, raw in files.items()}


def test_settings_there_and_back(tmp_path):
    path = f"{tmp_path}/settings.yaml"
    config = scoring.ScoreConfig(version="é v2", mode="additive")
    readers.write_yaml(config, path)
    assert readers.settings_of(scoring.ScoreConfig, readers.read_yaml(path)) == config
    with open(path, encoding="utf-8") as f:
        assert f.read().startswith("version: é v2\nmode: additive\n")

    @dataclass(frozen=True)
    class Own:
        a: int = 1
        steps: tuple = ((0.1, 2), (0.2, 3))

    readers.write_yaml(Own(a=5), path)
    assert readers.settings_of(Own, readers.read_yaml(path)) == Own(a=5) and readers.settings_of(Own, {}) == Own()
    with pytest.raises(ValueError, match="has no"):
        readers.settings_of(Own, {"b": 1})
    with open(path, "w", encoding="utf-8") as f:
        f.write("")
    assert readers.read_yaml(path) == {}


def test_fold_of_maps(spark):
    rows = [("a", 1, {"x": 1, "y": 2}), ("a", 2, {"y": None, "z": 3}), ("a", 0, {"x": 9}), ("b", 1, {}), ("b", 2, {"q": 1}), (None, 1, {"n": 1})]
    got = {r.k: r.v for r in ordering.fold_map(spark.createDataFrame(rows, "k string, at int, v map<string,int>"), "k", "at", "v").collect()}
    assert got == {"a": {"x": 1, "y": None, "z": 3}, "b": {"q": 1}, None: {"n": 1}}


def test_program_output_is_compared_without_line_ends(spark):
    rows = ["  a  \n b\t \n\n", "", " \n ", "x  \ny", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").coalesce(1).orderBy("k").select(testruns.norm_out(F.col("t"))).collect()]
    assert got[0] == "a\n b" and got[1] == got[2] == "" and got[4] is None
