import difflib
import hashlib
import inspect
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import testruns, text
from tallyforge.operators import audits, curation, difficulty, ordering, statistics
from tallyforge.plans import queries
from tallyforge.sources import commits, readers, sinks
from tallyforge.streaming import logs


def test_outcomes_keep_missing_apart(spark):
    log = "\x1b[32mPASSED\x1b[0m a.py::t[1]\nFAILED a.py::t[2] - boom\nPASSED a.py::u\nFAILED a.py::u\nPASSED a.py::u\ncollected 3 items"
    df = spark.createDataFrame([(log, ["a.py::t", "a.py::u", "a.py::v", "a.py::t[cut"])], "log string, ids array<string>")
    o = testruns.evaluate(testruns.parse_summary(F.col("log")), testruns.clean_ids(F.col("ids")))
    r = df.select(o.alias("o"), testruns.pytest_ran(F.col("log")).alias("ran")).head()
    assert (r.o.passed, r.o.failed, r.o.missing, r.ran) == (["a.py::u"], ["a.py::t"], ["a.py::v"], True)
    empty = spark.createDataFrame([(None, [])], "log string, ids array<string>").select(testruns.outcome_fraction(o, 1.0).alias("f")).head()
    assert empty.f == 1.0


def test_norm_out(spark):
    assert spark.createDataFrame([(" a  \n b\t\n\n",)], "t string").select(testruns.norm_out(F.col("t")).alias("x")).head().x == "a\n b"


def test_all_infra_rows_give_zero_rates(spark):
    df = spark.createDataFrame([("i", "v", 1.0, 0.5, 0.5, 1.0, 1.0, 1.0, 10, 1.0, "infra")], "instance_id string, variant_type string, rule_correctness_score double, final_reward double, f2p_frac double, patch_extraction_score double, patch_format_score double, patch_apply_score double, response_tokens long, infra_excluded double, err_kind string")
    r = difficulty.per_instance(df).head()
    assert (r.n, r.n_infra, r.p_hat, r.reward_std, r.mean_resp_tokens, r.err_kinds) == (0, 1, 0.0, 0.0, 10.0, {"infra": 1})


def test_score_rounds_to_even(spark):
    df = spark.createDataFrame([(0.75,), (0.85,), (0.95,)], "p double")
    assert [r[0] for r in df.select(difficulty.difficulty_score(F.col("p"))).collect()] == [round(10 * (1 - p)) for p in (0.75, 0.85, 0.95)]


def test_quantiles_equal_sorted_index(spark):
    rng = random.Random(1)
    values = [rng.randrange(20) for _ in range(333)]
    r = audits.quantile_summary(spark.createDataFrame([(v,) for v in values], "v int"), "v").head()
    at = sorted(values)
    assert [r.p10, r.p50, r.p99] == [at[round(p * 332)] for p in (0.1, 0.5, 0.99)]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    rows = [(k, f"g{k % 2}", " ".join(base[k % 6][:j] + ["zz"] + base[k % 6][j + 1 :])) for k in range(24) for j in [rng.randrange(38, 40) if k % 3 else 20]] + [(99, "g0", None), (100, "g0", "")]
    got = {(r.g, r.a, r.b) for r in audits.similar_pairs(spark.createDataFrame(rows, "i int, g string, t string"), "g", "i", "t").collect()}
    sets = {i: (g, {" ".join(w[k : k + 5]) for w in [(t or "").split()] for k in range(max(1, len(w) - 4))}) for i, g, t in rows}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(sets[a][0], a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])}
    want |= {(sets[i][0], rep[i], i) for i in sets if rep[i] != i}
    assert got == want and len(want) > 3


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_only_the_rarest_shingles_of_a_set_are_dealt(spark, threshold):
    rows = [(f"g{k % 2}", k, [*range(1000 * k, 1000 * k + 5 + k), -7]) for k in range(12)]
    for r in audits.shingle_heads(spark.createDataFrame(rows, "g string, i int, s array<long>"), threshold).collect():
        s = next(x for _, i, x in rows if i == r.i)
        assert r.n == len(s) and len(r.p) == len(s) - math.ceil(len(s) * threshold) + 1 and set(r.p) < set(s) and -7 not in r.p


def test_pairs_beyond_a_broadcast_are_the_same(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("i"), F.lit("g").alias("g"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), 40 + F.col("id") % 4), lambda w: w * (F.col("id") % 5 + 1)).cast("array<string>")).alias("t"))
    want = sorted(audits.similar_pairs(rows, "g", "i", "t").collect())
    monkeypatch.setattr(audits, "MOST_PAIRS", 0)
    assert sorted(audits.similar_pairs(rows, "g", "i", "t").collect()) == want and len(want) > 40


def test_copies_give_rows_not_pairs(spark):
    rows = spark.range(400).select(F.col("id").alias("i"), F.lit("g").alias("g"), F.lit("one two three four five six seven").alias("t"))
    got = audits.similar_pairs(rows, "g", "i", "t").collect()
    assert sorted((r.a, r.b) for r in got) == [(0, k) for k in range(1, 400)]


def test_close_texts(spark):
    df = spark.createDataFrame([("abcdefghij", "abcdefghik"), ("abc", "xyz"), (None, "a")], "a string, b string")
    assert [round(r.ratio, 3) for r in audits.close_texts(df, "a", "b", 0.85).collect()] == [0.9]
    assert audits.close_texts(df, "a", "b", 0.9).collect() == []
    near = spark.createDataFrame([("abcdefghijklmnopqrst", "abcdefghijklmnopqrsu")], "a string, b string")
    assert audits.close_texts(near, "a", "b").head().ratio == difflib.SequenceMatcher(None, "abcdefghijklmnopqrst", "abcdefghijklmnopqrsu", autojunk=False).ratio()


def test_identical_prompts_keep_all_of_a_large_group(spark):
    rows = spark.range(2600).select(F.col("id").alias("i"), F.when(F.col("id") < 2500, "same").when(F.col("id") < 2502, None).otherwise(F.col("id").cast("string")).alias("t"))
    got = Counter((r.prompt_md5, r.n, r.first_item) for r in audits.identical_prompts(rows, "t", "i").collect())
    assert got == {(hashlib.md5(b"same").hexdigest(), 2500, 0): 2500, (None, 2, 2500): 2}


def test_fold_tells_null_from_absent(spark):
    log = spark.createDataFrame([("a", 1, 5, "x", ["n", "s"]), ("a", 2, None, None, ["n"])], "id string, at int, n int, s string, present array<string>")
    assert tuple(ordering.fold_records(log, "id", "at", "present").head()) == ("a", None, "x")
    assert tuple(ordering.fold_records(log.drop("present"), "id", "at").head()) == ("a", 5, "x")


def test_shorter_correct_response_has_the_higher_advantage(spark):
    df = spark.createDataFrame([("g", 1.0, 10), ("g", 1.0, 90), ("g", 0.0, 50), ("h", 1.0, 5)], "g string, s double, n int")
    out = {(r.g, r.n): r.advantage for r in ordering.group_advantage(df, "g", "s", "n").collect()}
    assert out["g", 10] > out["g", 90] > out["g", 50] and out["h", 5] == 0
    plain = {(r.g, r.n): r.advantage for r in ordering.group_advantage(df, "g", "s", "n", beta=0).collect()}
    assert plain["g", 10] == plain["g", 90]


def test_sampler_resumes_and_weighs(spark):
    tasks = ["swe"] * 40 + ["ut"] * 360
    variants = ["swe_32k"] * 40 + ["function"] * 200 + ["pytest"] * 100 + ["stdio"] * 60
    rows = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(zip(tasks, variants))], "i long, t string, v string").cache()
    make = lambda **k: ordering.Sampler(rows, "t", "v", "i", **k)
    a = make(task_weights={"swe": 0.5, "ut": 0.5}, seed=3)
    whole = [r.i for r in a.order(0).orderBy("position").collect()]
    assert len(whole) == 400 == len(a)
    for bucket in set(variants):  # every item of a bucket once before any comes again
        n, of = variants.count(bucket), [k for k in whole if variants[k] == bucket]
        assert all(len(set(of[k : k + n])) == len(of[k : k + n]) for k in range(0, len(of), n))
    first = [x for _, x in zip(range(100), iter(a))]
    b = make(task_weights={"swe": 0.5, "ut": 0.5}, seed=3)
    b.restore(a.state())
    assert first + list(b) == whole and b.state() == {"seed": 3, "epoch": 1, "cursor": 0}
    other = [r.i for r in a.order(1).orderBy("position").collect()]
    assert other != whole and 0.4 < Counter(tasks[k] for k in other)["swe"] / 400 < 0.6
    assert 0.05 < Counter(tasks[r.i] for r in make(seed=1).order(0).collect())["swe"] / 400 < 0.16
    named = Counter(variants[r.i] for r in make(variant_weights={"function": 0.5, "pytest": 0.5}, task_weights={"ut": 1.0}).order().collect())
    assert set(named) == {"function", "pytest"}
    assert ordering.Sampler(rows.where("i < 0"), "t", "v", "i").order().count() == 0
    with pytest.raises(ValueError):
        make(task_weights={"nothing": 1.0}).order()


def test_weighted_order_prefers_weight_and_splits_buckets(spark):
    rows = spark.range(2000).select(F.col("id").alias("i"), F.when(F.col("id") < 1990, "hot").alias("b"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("w"))
    got = ordering.weighted_order(rows, ["b"], "i", "w").collect()
    assert sorted(r.place for r in got if r.b == "hot") == list(range(1, 1991)) and sorted(r.place for r in got if r.b is None) == list(range(1, 11))
    early = [r.i % 2 == 0 for r in got if r.b == "hot" and r.place <= 200]
    assert 0.8 < sum(early) / len(early) < 0.97


def test_numbers_are_placed_by_one_computation_a_row(spark):
    cuts = [-1.0, 0.0, 0.5, 2.0, 2.5]
    for some in (cuts, cuts[:1], cuts[:3], []):
        numbers = [-5.0, -1.0, 0.2, 0.5, 2.2, 9.0, float("inf"), float("nan"), None]
        got = [r.n for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(ordering.cuts_below(F.col("x"), some).alias("n")).collect()]
        assert got == [0 if x is None else len(some) if math.isnan(x) else sum(c < x for c in some) for x in numbers]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(2000).select(F.col("id").alias("i"), F.lit("b").alias("b"))
    assert not re.search(r"lambda \S+ < [^,]*md5", plan(ordering.weighted_order(rows, ["b"], "i", None)))


def test_draws_of_a_sampler_are_hashed_once(spark):
    rows = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("t"), (F.col("id") % 2).alias("v"))
    plan = ordering.Sampler(rows, "t", "v", "i", draws=50).order()._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and not re.search(r"<= [^,]*md5", plan)


def test_statistics(spark):
    assert statistics.mcnemar_exact(0, 0) == 1.0
    tails = spark.createDataFrame([(b, c) for b in (0, 1, 7, 400) for c in (0, 1, 2, 9, 380)], "b long, c long").withColumn("p", statistics.mcnemar_p(F.col("b"), F.col("c")))
    assert all(r.p == pytest.approx(statistics.mcnemar_exact(r.b, r.c)) for r in tails.collect())
    assert statistics.mcnemar_exact(1, 9) == pytest.approx(2 * sum(math.comb(10, k) for k in (0, 1)) / 2**10)
    pairs = spark.createDataFrame([(k, f"t{k % 2}", float(k % 3 == 0), float(k % 4 == 0)) for k in range(60)], "item int, track string, arm double, base double")
    lo, hi = statistics.paired_bootstrap(pairs, 200).head()
    delta = pairs.groupBy("track").agg(F.avg(F.col("arm") - F.col("base")).alias("d")).agg(F.avg("d")).head()[0]
    assert lo < delta < hi
    assert statistics.decide(0.5, 0.4)[0] == "keep" and statistics.decide(0.4, 0.4)[0] == "reject"
    assert statistics.decide(0.9, 0.1, guards={"kl": 1.0}, metrics={"kl": 2.0})[0] == "reject"


def test_bootstrap_draws_the_references_iterations(spark, monkeypatch):
    seen = []
    inner = statistics.paired_bootstrap
    monkeypatch.setattr(statistics, "paired_bootstrap", lambda pairs, **k: seen.append(k) or inner(pairs, **k))
    monkeypatch.setattr(queries, "arm_pairs", lambda *_: spark.range(400).select(F.col("id").alias("item"), F.lit("t").alias("track"), F.lit(0.0).alias("base"), (F.col("id") % 4 == 0).cast("double").alias("arm")))
    lo, hi = queries.QUERIES["paired_bootstrap"](spark, "").head()
    se = math.sqrt(0.25 * 0.75 / 400)
    assert inspect.signature(inner).parameters["iterations"].default == 10_000 and seen == [{}]
    assert lo == pytest.approx(0.25 - 1.96 * se, abs=0.1 * se) and hi == pytest.approx(0.25 + 1.96 * se, abs=0.15 * se)


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "x", "c")], "i long, k string, r string")
    assert sorted((r.i, r.dup_of) for r in curation.first_seen(rows, F.col("k"), "i", "i").collect()) == [(1, None), (2, 1), (3, None)]
    assert sorted(r.i for r in curation.group_split(rows, "k", 1, 1).collect()) == [1, 2, 3]
    assert len({r.split for r in curation.group_split(rows, "k", 1, 0).collect()}) == 2
    assert sorted(r.split for r in curation.hash_split(rows, "k", 0, 0).collect()) == ["train"] * 3
    assert curation.hash_split(rows, "r", 5, 1).where("split <> 'test'").count() == 0
    log = spark.createDataFrame([(None, "a", 1, 1), (None, "a", 2, 2), (None, "a", 2, 3), ("x", None, 1, 4)], "arm string, item string, step int, at int")
    assert sorted((r.arm or "", r.item or "", r.step, r["at"]) for r in ordering.final_step(log, "arm", "item", "step", "at").collect()) == [("", "a", 2, 3), ("x", "", 1, 4)]


def test_quantiles_of_a_whole_table(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.5, -3.0]) for _ in range(999)]
    got = audits.quantile_summary(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").head()
    values.sort()
    assert (got.n, got.min, got.max) == (999, values[0], values[-1])
    assert [got[f"p{round(100 * p)}"] for p in audits.QUANTILES] == [values[round(p * 998)] for p in audits.QUANTILES]
    assert audits.quantile_summary(spark.createDataFrame([], "v double"), "v").head().n is None


def test_small_sinks_refuse_large_results(spark):
    assert sinks.to_markdown(spark.range(3), 3).count("\n") == 5
    with pytest.raises(ValueError):
        sinks.to_markdown(spark.range(4), 3)


def test_curation_decisions(spark):
    v = "struct<extract_ok:boolean,gold_touches_tests:boolean,gold_needs_ignore_ws:boolean,gold:struct<ran:boolean,apply:string,log_tail:string,err_kind:string>,empty:struct<ran:boolean,n_f2p:int>,f2p_effective:array<string>,f2p_dropped:array<string>,p2p_dropped:array<string>>"
    good = (True, False, False, (True, "ok", "", ""), (True, 0), ["a"], ["x"], None)
    rows = [(None, "swe_32k", None, "drop", good), ("p", "swe_32k", None, None, good), (None, "swe_64k", None, None, None), (None, "swe_32k", 10, None, None), (None, "swe_32k", 10, None, (True, True, False, (True, "", "", ""), (True, 2), ["a"], None, None)), (None, "swe_32k", 10, None, (True, False, False, (False, "patch_apply_fail", "No such file", ""), (True, 0), ["a"], None, None)), (None, "swe_32k", 10, None, (True, False, False, (True, "", "", ""), (True, 0), [], None, None))]
    df = spark.createDataFrame(rows, f"dup_of string, variant_type string, prompt_tokens int, judge_verdict string, v {v}")
    reason, flags = curation.repo_decision()
    got = df.select(reason.alias("r"), F.array_join(flags, ";").alias("f")).collect()
    assert [r.r for r in got] == ["", "DUPLICATE", "CONTEXT_OVERFLOW", "UNVALIDATED", "BUG_IN_TEST_FILE", "BROKEN_BRANCH", "NO_VALID_F2P"]
    assert got[0].f == "F2P_PRUNED:1;JUDGE_DROP" and got[1].f.startswith("dup_of:p")
    u = "struct<n_tests:int,has_reference:boolean,gold_ok:boolean,empty_ok:boolean,empty:struct<n_f2p:int,t_f2p:int>>"
    units = spark.createDataFrame([(None, None), (None, (0, True, True, True, None)), (None, (3, True, False, True, None)), (None, (3, True, True, False, (2, 3))), (None, (3, False, None, False, (1, 3)))], f"dup_of string, v {u}")
    reason, flags = curation.unit_decision()
    got = units.select(reason.alias("r"), F.array_join(flags, ";").alias("f")).collect()
    assert [r.r for r in got] == ["UNVALIDATED", "NO_TESTS", "REFERENCE_SOLUTION_FAILS", "BASELINE_ANOMALY", ""]
    assert got[4].f == "EMPTY_PASSES_SOME:1/3;no_reference_solution"


def test_sources_and_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert readers.read_jsonl(spark, f"{base}/none", "a int").count() == 0
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in readers.read_jsonl(spark, f"{base}/t.jsonl", "a int", tolerant=True).collect()) == [1, 2]
    (tmp_path / "x1.jsonl").write_text('{"id": "a", "v": 1}\n{"id": "a", "v": 2}\n{"id": "b", "v": 1}\n')
    (tmp_path / "x2.jsonl").write_text('{"id": "b", "v": 9}\n')
    assert {r.id: r.v for r in readers.read_index(spark, f"{base}/x*.jsonl", "id string, v int", "id").collect()} == {"a": 2, "b": 9}
    df = spark.createDataFrame([("k", ["a", "b"], 1)], "variant_type string, xs array<string>, n int")
    sinks.write_csv(df, f"{base}/csv")
    assert readers.read_csv(spark, f"{base}/csv", "variant_type string, xs string, n int").head().xs == "a;b"
    sinks.write_jsonl(df, f"{base}/gz", gzip=True)
    assert any(p.name.endswith(".json.gz") for p in (tmp_path / "gz").iterdir())
    sinks.append_log(df, f"{base}/log")
    sinks.append_log(df, f"{base}/log")
    assert readers.read_jsonl(spark, f"{base}/log", df.schema).count() == 2
    m = sinks.manifest({"train": df})
    assert m["counts"]["train"] == {"total": 1, "k": 1} and m["digest"]["train"] == sinks.content_digest(df)
    want = hashlib.sha256((tmp_path / "x2.jsonl").read_bytes()).hexdigest()[:16]
    assert [r.sha for r in readers.file_digests(spark, f"{base}/x2.jsonl").collect()] == [want]
    assert sinks.to_markdown(df).splitlines()[2] == "| k | ['a', 'b'] | 1 |"


def test_train_log(spark):
    lines = ["\x1b[36mstep:1 - critic/score/mean:np.float64(0.5) actor/ppo_kl:1e-3\x1b[0m", "noise", "step:1 - critic/score/mean:0.75", "step:2 - actor/entropy:nan"]
    got = readers.curves(readers.parse_train_log(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))).orderBy("step").collect()
    assert (got[0].reward, got[0].kl, got[0].entropy) == (0.75, 0.001, None) and math.isnan(got[1].entropy)
    assert readers.parse_run_info("start=a git=b\nEND_TRAIN rc=0 c") == {"end_rc": 0, "end_time": "c", "start_time": "a", "git": "b"}


def test_orders_of_one_key_are_steps_of_their_own(spark, tmp_path):
    rows = [(8, "F", 10.5), (8, "O", 16.0), (7, "P", 3.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    got = queries.training_curves(spark, f"file://{tmp_path}").collect()
    assert sorted((r.step, r.reward, str(r.kl)) for r in got if r.reward) == [(8, 10.5, "nan"), (8, 16.0, "-2.0")] and [(r.step, r.kl) for r in got if not r.reward] == [(7, math.inf)]
    lines = spark.createDataFrame([("a", "step:1 - actor/lr:1 actor/entropy:2"), ("b", "step:1 - actor/lr:3")], "f string, value string")
    assert sorted((r.f, r.step, r.metrics) for r in readers.parse_train_log(lines, log="f").collect()) == [("a", 1, {"actor/entropy": 2.0, "actor/lr": 1.0}), ("b", 1, {"actor/lr": 3.0})]


def test_small_numbers_are_written_without_powers(spark):
    numbers = [0.0009, 0.00009, 0.00004, 0.0, 1.0, 0.5, 0.1203, -0.0007, 12345678.25, None]
    got = [r.t for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(text.plain_number(F.col("x"), 4).alias("t")).collect()]
    assert got == ["0.0009", "0.0001", "0.0", "0.0", "1.0", "0.5", "0.1203", "-0.0007", "12345678.25", None]


def test_log_stream(spark, tmp_path):
    rows = spark.createDataFrame([("i", "swe", 1, 0.5, 1.0), ("j", "swe", 1, None, 0.0)], "instance_id string, track string, step int, final_reward double, infra_excluded double")
    sinks.append_log(rows, f"file://{tmp_path}/log")
    q = logs.write_means(logs.running_means(logs.read_log_stream(spark, f"file://{tmp_path}/log")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    r = commits.read_committed(spark, f"file://{tmp_path}/out", "step int, track string, n long, final_reward double").head()
    assert (r.step, r.track, r.n, r.final_reward) == (1, "swe", 2, 0.25)
