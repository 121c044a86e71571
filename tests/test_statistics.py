"""Statistics, orders and ratios against plain versions."""

import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import audits, ordering, statistics


def test_mcnemar_equals_the_exact_sum(spark):
    counts = [(b, c) for b in (0, 1, 2, 14, 15, 16, 40, 399, 400) for c in (0, 1, 5, 15, 60, 380, 1500)] + [(2990, 3010), (3200, 3300), (6000, 6000), (9000, 9400), (5, 4000)]
    rows = spark.createDataFrame(counts, "b long, c long").withColumn("p", statistics.mcnemar_p(F.col("b"), F.col("c"))).collect()
    assert len(rows) == len(counts)
    for r in rows:
        n, k = r.b + r.c, min(r.b, r.c)
        term = tail = 1
        for i in range(k):
            term = term * (n - i) // (i + 1)
            tail += term
        want = 1.0 if n == 0 else min(1.0, 2 * tail / 2**n)
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300), (r.b, r.c)


def test_mcnemar_of_large_counts(spark):
    """Beyond exact sums: the normal tail with a continuity correction, which is near enough there."""
    big = 100_000_000
    rows = spark.createDataFrame([(big, big + d) for d in (0, 1, 10_000, 20_000, 30_000)], "b long, c long").withColumn("p", statistics.mcnemar_p(F.col("b"), F.col("c"))).collect()
    for r in rows:
        z = (abs(r.b - r.c) - 1) / math.sqrt(r.b + r.c)
        assert r.p == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-6)


def test_draws_are_poisson(spark):
    draws = spark.range(40_000).withColumn("h", F.md5(F.concat_ws(":", F.lit("3"), "id")))
    for n, j in ((1, 1), (500, 0), (33, 0)):
        w = draws.select(statistics.resampled(F.lit(n).cast("long"), F.lit(j), statistics.digits(F.col("h"), 0), statistics.digits(F.col("h"), 1)).alias("w"))
        mean, var, zero = w.agg(F.avg("w"), F.var_samp("w"), F.avg((F.col("w") == 0).cast("int"))).head()
        assert mean == pytest.approx(n, rel=0.02) and var == pytest.approx(n, rel=0.05) and zero == pytest.approx(math.exp(-n), abs=0.01)


def test_bootstrap_equals_the_normal_interval(spark):
    rng = random.Random(1)
    rows = [(f"t{k % 2}", rng.gauss(0.2, 1.0), 0.0) for k in range(600)] + [(None, 5.0, 0.0), ("t0", None, 1.0)]
    lo, hi = statistics.paired_bootstrap(spark.createDataFrame(rows, "track string, arm double, base double"), 3000).head()
    d = [np.array([(a or 0) - (b if a is not None else 0) for t, a, b in rows if t == x]) for x in ("t0", "t1")]
    mean, se = sum(x.mean() for x in d) / 2, math.sqrt(sum(x.var() / len(x) for x in d)) / 2
    assert lo == pytest.approx(mean - 1.96 * se, abs=0.12 * se) and hi == pytest.approx(mean + 1.96 * se, abs=0.12 * se)


def test_bootstrap_by_group_and_counts(spark):
    rows = [(g, "t", float(k % 4 == 0), 0.0) for g, n in (("a", 20), ("b", 4000)) for k in range(n)]
    got = {r.g: (r.lo, r.hi) for r in statistics.paired_bootstrap(spark.createDataFrame(rows, "g string, track string, arm double, base double"), 2000, keys=["g"]).collect()}
    for g, n in (("a", 20), ("b", 4000)):
        se = math.sqrt(0.25 * 0.75 / n)
        assert got[g][0] == pytest.approx(0.25 - 1.96 * se, abs=0.5 * se) and got[g][1] == pytest.approx(0.25 + 1.96 * se, abs=0.5 * se)
    plan = statistics.paired_bootstrap(spark.createDataFrame(rows, "g string, track string, arm double, base double"), 50, keys=["g"])._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "partial_sum" in plan
    assert statistics.paired_bootstrap(spark.createDataFrame([], "g string, track string, arm double, base double"), 10, keys=["g"]).collect() == []


def test_arms_are_compared_whole(spark):
    log = [("a0", i, f"t{i % 2}", 5, i, float(i % 2), False) for i in range(40)]
    log += [("a1", i, f"t{i % 2}", s, 100 * s + i, float((i + s) % 3 == 0), i == 7) for i in range(30) for s in (1, 2)]
    log += [("a1", 3, "t1", 2, 900, 1.0, False), ("a2", 999, "t0", 4, 1, 1.0, False), ("a1", 50, "t0", 9, 1, 1.0, True)]
    scores = statistics.last_scores(spark.createDataFrame(log, "arm string, item int, track string, step int, at int, v double, infra boolean"), "arm", "item", "track", "step", "at", "v", F.col("infra"))
    got = {r.arm: r for r in statistics.compare_arms(scores, "a0", iterations=300).collect()}
    base = {i: float(i % 2) for i in range(40)}
    mine = {i: float((i + 2) % 3 == 0) for i in range(30) if i != 7} | {3: 1.0}
    wins, losses = (sum(f(mine[i], base[i]) for i in mine) for f in (lambda x, y: x > y, lambda x, y: x < y))
    rates = [np.mean([v for i, v in mine.items() if i % 2 == t]) for t in (0, 1)]
    r = got["a1"]
    assert (r.step, r.n_shared, r.wins, r.losses) == (2, 29, wins, losses)
    assert r.resolved == pytest.approx(sum(rates) / 2) and r.delta == pytest.approx(sum(rates) / 2 - 0.5) and r.p == pytest.approx(statistics.mcnemar_exact(wins, losses))
    assert [(t.track, t.n) for t in r.per_track] == [("t0", 15), ("t1", 14)] and r.lo < r.hi and r.tied == (r.lo <= 0 <= r.hi)
    assert (got["a2"].n_shared, got["a2"].resolved, got["a2"].p) == (0, None, None) and set(got) == {"a1", "a2"}


def plain_decisions(runs, guards, least, independent):
    out, state = {}, {}
    for plan, at, run, value, base, failed, *metrics in sorted(runs, key=lambda r: (str(r[0]), r[1], r[2])):
        best, best_value, aborted = state.get(plan, (None, None, False))
        broken = sorted(g for (g, limit), m in zip(guards.items(), metrics) if m is not None and m > limit)
        ok = value is not None and not failed
        keep, reason = False, None
        if aborted:
            reason = "aborted"
        elif base:
            keep, reason = ok, "baseline"
            aborted = not ok
        elif not ok:
            reason = "failed"
        elif broken:
            reason = "guards"
        else:
            keep = best_value is None or value > best_value + least
            reason = "better" if keep else "not better"
        out[plan, run] = (None if reason == "aborted" else "keep" if keep else "reject", reason, tuple(broken), best, best_value)
        if keep and (base or not independent or best_value is None or value > best_value):
            best, best_value = run, value
        state[plan] = (best, best_value, aborted)
    return out


@pytest.mark.parametrize(("least", "independent"), [(0.0, True), (0.05, True), (-0.1, False), (-0.1, True)])
def test_decisions_equal_a_plain_fold(spark, least, independent):
    rng = random.Random(2)
    pick = lambda *x: rng.choice(x)
    runs = [(pick("a", "b", "c", None), rng.randrange(100), f"r{k}", pick(None, rng.random(), rng.random()), k % 40 == 0, pick(False, False, None, True), pick(None, rng.random()), rng.random()) for k in range(300)]
    table = spark.createDataFrame(runs, "plan string, at int, run string, v double, base boolean, failed boolean, kl double, len double").repartition(5)
    guards = {"len": 0.9, "kl": 0.8}
    got = statistics.decisions(table, "plan", "at", "run", "v", F.col("base"), F.col("failed"), guards, least, independent).collect()
    order = {"len": 7, "kl": 6}
    want = plain_decisions([(*r[:6], *(r[order[g]] for g in guards)) for r in runs], guards, least, independent)
    assert {(r.plan, r.run): (r.decision, r.reason, tuple(r.broken), r.best, r.best_value) for r in got} == want and len(got) == 300
    assert {r.reason for r in got} == set(statistics.REASONS)


def test_decisions_go_on_over_batches(spark):
    """One plan of more rows than an Arrow batch: the state is carried on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = spark.range(1000).select(F.lit("p").alias("plan"), F.col("id").alias("at"), F.col("id").cast("string").alias("run"), (F.col("id") * 1.0).alias("v"))
        got = statistics.decisions(rows, "plan", "at", "run", "v", F.col("at") == 0).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.best for r in got] == [None, *map(str, range(999))] and all(r.decision == "keep" for r in got)
    assert statistics.decisions(rows.where("id < 0"), "plan", "at", "run", "v", F.col("at") == 0).collect() == []


def test_ranks_by_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0.5, 0.5, 0.5, rng.random(), None]), rng.choice([True, False, None])) for k in range(500)]
    table = spark.createDataFrame(rows, "id int, score double, stable boolean").repartition(4)
    out = ordering.ranked(table, "score", "stable", tie="id")
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, not r[2], r[0])
    assert {r.id: r["rank"] for r in out.collect()} == {r[0]: k for k, r in enumerate(sorted(rows, key=key), 1)}
    assert "SinglePartition" not in out._jdf.queryExecution().toString() and out.columns == ["id", "score", "stable", "rank"]
    assert ordering.ranked(table.where("id < 0"), "score", tie="id").collect() == []


def test_advantages_without_windows(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot", "hot", "b", None, f"one{k}"]), rng.choice([0.0, 1.0, 1.0, None]), rng.randrange(1, 90)) for k in range(400)]
    table = spark.createDataFrame(rows, "id int, g string, s double, n int")
    out = ordering.group_advantage(table, "g", "s", "n", beta=0.4)
    assert "Window" not in out._jdf.queryExecution().toString() and out.columns == ["id", "g", "s", "n", "advantage"]
    got = {r.id: r.advantage for r in out.collect()}
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g]
        scores = [r[2] for r in mine if r[2] is not None]
        right = [r for r in mine if r[2] is not None and r[2] >= 0.999]
        std = lambda v: float(np.std(v, ddof=1)) if len(v) > 1 else None
        lengths = [r[3] for r in right]
        z = {r[0]: (r[3] - np.mean(lengths)) / (std(lengths) + 1e-6) if std(lengths) else 0.0 for r in right}
        part = {k: 1 / (1 + math.exp(-v)) for k, v in z.items()}
        for r in mine:
            if len(mine) == 1:
                want = 0.0
            else:
                want = None if r[2] is None or std(scores) is None else (r[2] - np.mean(scores)) / (std(scores) + 1e-6)
            if want is not None and r[0] in part and len(right) >= 2:
                want -= 0.4 * len(right) / len(mine) * (part[r[0]] - (sum(part.values()) - part[r[0]]) / (len(right) - 1))
            assert got[r[0]] == (None if want is None else pytest.approx(want, abs=1e-9)), r


def test_ratios_equal_difflib():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abc \n😀") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("😀a", "a😀")] + [(some(rng.randrange(300)), some(rng.randrange(300))) for _ in range(20)]
    base = some(900)
    pairs += [(base, base[:400] + some(30) + base[380:]), (base, base[::-1]), ("x" * 400, "x" * 399 + "y")]
    for a, b in pairs:
        assert text.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_bounds_equal_quick_ratios_and_rule_out_first(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcé 😀") for _ in range(n))
    base = some(200)
    pairs = [("", ""), ("", "a"), ("aab", "aba"), (base, base[:-3]), (base, base[::-1]), (base, some(200)), (base, "z" * 200), (None, "q")]
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = {r.k: r for r in table.select("k", text.length_bound(F.col("a"), F.col("b")).alias("x"), text.letter_bound(F.col("a"), F.col("b")).alias("y")).collect()}
    for k, (a, b) in enumerate(pairs[:-1]):
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert got[k].x == pytest.approx(m.real_quick_ratio()) and got[k].y == pytest.approx(m.quick_ratio())
    close = audits.close_texts(table, "a", "b", 0.9)
    want = {k for k, (a, b) in enumerate(pairs) if difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() > 0.9}
    assert {r.k for r in close.collect()} == want
    plan = close._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.index("ArrowEvalPython") < plan.rindex("Filter")  # the filters by bounds are below


def test_close_pairs_of_documents(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice("one two three four five six seven eight".split()) + str(rng.randrange(40)) for _ in range(n))
    base = words(120)
    docs = [(1, "s", base), (2, "s", base + " more"), (3, "s", base), (4, "t", base), (5, "s", words(120)), (6, "s", base[: len(base) // 2] + words(60)), (7, "s", None)]
    got = {(r.a, r.b): r.ratio for r in audits.close_pairs(spark.createDataFrame(docs, "i int, g string, body string"), "g", "i", "body").collect()}
    assert set(got) == {(1, 2), (1, 3)} and got[1, 3] == 1.0 and got[1, 2] == difflib.SequenceMatcher(None, base, base + " more", autojunk=False).ratio()
