"""A dataset from training rows to files and manifest."""

import json

from pyspark.sql import functions as F

from tallyforge.operators import building, curation

REPO = "struct<extract_ok:boolean,gold_touches_tests:boolean,gold_needs_ignore_ws:boolean,gold:struct<ran:boolean,apply:string,log_tail:string,err_kind:string>,empty:struct<ran:boolean,n_f2p:int>,f2p_effective:array<string>,p2p_effective:array<string>,f2p_dropped:array<string>,p2p_dropped:array<string>>"
UNIT = "struct<n_tests:int,has_reference:boolean,gold_ok:boolean,empty_ok:boolean,empty:struct<n_f2p:int,t_f2p:int>>"


def tables(spark):
    fields = [f.split(":")[0] for f in curation.TRAINING_ROW.split("extra_info struct<")[1].split(",") if ":" in f and "<" not in f.split(":")[0]]
    assert "instance_id" in fields
    info = lambda **k: F.struct(*[F.lit(k.get(n)).cast(t).alias(n) for n, t in (("instance_id", "string"), ("variant_type", "string"), ("repo", "string"), ("lang", "string"), ("harness", "string"), ("p_hat", "double"), ("p_hat_source", "string"), ("image_name", "string"), ("difficulty_band", "string"))])
    made = None
    for k in range(20):
        swe = k % 2 == 0
        x = info(instance_id=f"own__r{k % 6}.c{k}.lm__h{k}" if swe else f"u{k}", variant_type="swe_32k" if swe else "ut_function", repo=f"r{k % 6}" if swe else None, lang="ko" if k == 3 else "en", harness=None if swe else "function", image_name=f"reg/img{k}")
        prompt = F.array(F.struct(F.lit("user").alias("role"), F.lit("same" if k in (5, 7) else f"do {k}").alias("content")))
        one = spark.range(1).select(F.lit("d").alias("data_source"), prompt.alias("prompt"), F.lit("code").alias("ability"), F.struct(F.lit("rule").alias("style"), F.lit("g").alias("ground_truth")).alias("reward_model"), x.alias("extra_info"), F.lit(k).alias("position"))
        made = one if made is None else made.unionByName(one)
    ok = lambda **k: (k.get("extract", True), False, k.get("ws", False), (True, "patch_apply_success", "", ""), (False, 0), ["a"] if k.get("f2p", True) else [], ["b", "c"], [], ["x"])
    repo = spark.createDataFrame([(f"own__r{k % 6}.c{k}.lm__h{k}", ok(extract=k != 2, f2p=k != 4, ws=k == 6)) for k in range(0, 18, 2)], f"instance_id string, v {REPO}")
    unit = spark.createDataFrame([(f"u{k}", (0 if k == 1 else 3, True, True, k != 9, (1, 4))) for k in range(1, 20, 2)], f"instance_id string, v {UNIT}")
    rates = spark.createDataFrame([("u11", 0.99, 0.1, 8), ("u13", 0.01, 0.0, 8), ("u15", 0.01, 0.2, 8), ("u17", 0.5, 0.2, 8)], "instance_id string, p_hat double, reward_std double, n int")
    units = spark.createDataFrame([("u3", "function", "solve", ["assert helper(1)"]), ("u5", "function", None, [])], "instance_id string, harness string, entry_point string, assertions array<string>")
    return made, repo, unit, rates, units


def test_build_and_write(spark, tmp_path):
    made, repo, unit, rates, units = tables(spark)
    cfg = building.BuildConfig(n_test_units=0, n_val_units=0, n_test_repos=1, n_val_repos=1)
    built = building.build(made, repo, unit, rates=rates, units=units, cfg=cfg)
    rows = {r.instance_id: r for r in built.collect()}
    assert len(rows) == 20
    why = {k.split(".")[1][1:] if "." in k else k: r.reason for k, r in rows.items()}
    assert (why["2"], why["4"], why["18"], why["u1"], why["u7"], why["u11"], why["u13"], why["u15"], why["u17"]) == ("BROKEN_ENV", "NO_VALID_F2P", "UNVALIDATED", "NO_TESTS", "DUPLICATE", "TOO_EASY", "TOO_HARD", "", "")
    assert rows["u7"].flags == ["dup_of:u5"] and "HARD_BUT_PARTIAL_SIGNAL" in rows["u15"].flags and "EMPTY_PASSES_SOME:1/4" in rows["u9"].flags
    assert rows["u3"].prompt[0].content.endswith("`solve`, `helper`") and "PROMPT_FIX_ENTRY_POINT" in rows["u3"].flags and "테스트" in rows["u3"].prompt[0].content
    assert rows["u5"].prompt[0].content == "same"
    by_repo = {}
    for r in rows.values():
        if r.repo and r.status == "ok":
            by_repo.setdefault(r.repo, set()).add(r.split)
    assert all(len(x) == 1 for x in by_repo.values()) and {"train", "validation", "test"} == set().union(*by_repo.values())
    x = rows["own__r0.c6.lm__h6"].extra_info
    assert (x.environment_id, x.base_commit, x.n_p2p_effective, x.task_type, x.exclusion_reason, x.empirical_success_rate) == ("img6", "c6", 2, "swe_patch", "", -1.0) and "GOLD_WHITESPACE_MISMATCH" in x.quality_flags
    manifest = building.write_dataset(spark, built, f"file://{tmp_path}/out", cfg)
    counts = manifest["counts"]
    assert counts["excluded"] == sum(r.status == "excluded" for r in rows.values()) and sum(counts[s]["total"] for s in building.SPLITS) + counts["excluded"] == 20
    assert manifest["exclusions"]["TOO_EASY"] == 1 and manifest["flags"]["P2P_PRUNED"] == 9
    stored = json.loads("\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/out/dataset_manifest.json").collect()))
    assert stored["counts"] == counts
    assert spark.read.csv(f"file://{tmp_path}/out/instance_audit.csv", header=True).count() == 20
    assert spark.read.parquet(f"file://{tmp_path}/out/train.parquet").columns == list(building.COLUMNS)
    report = building.quality_report(manifest, built.select("variant_type", F.col("empirical_success_rate").alias("p_hat")).where("p_hat IS NOT NULL"), {"TOO_EASY": "above the band"})
    assert "| TOO_EASY | 1 | above the band |" in report and "| ut_function |" in report


def test_build_without_rates_on_no_rows(spark):
    made, repo, unit, _, _ = tables(spark)
    assert building.build(made.where("position < 0"), repo, unit).count() == 0
    assert building.build(made, repo, unit).where("split = 'excluded'").count() > 0


def test_ablation_report(spark):
    runs = spark.createDataFrame([("f", "a", True, 0.5), ("f", "b", False, 0.7), ("g", "c", True, None)], "family string, experiment_id string, base boolean, val double")
    report = building.ablation_report(runs, "family", "base", ["val"])
    assert "## f" in report and "| b | 0.7 | 0.2 |" in report and "| c |  |  |" in report
