"""Statistics for comparing runs: standard errors, paired tests, bootstrap intervals, whole comparisons of arms, decisions in order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from .ordering import final_step

#: Iterations of the bootstrap that a row is dealt out for.
BLOCK = 250
#: Counts up to which a bootstrap weight is a sum of draws; beyond, it is one draw from the sum's distribution.
FEW = 32
#: Steps of the continued fraction and the shape up to which it is used; beyond, points of the quadrature.
STEPS, SHAPE, POINTS = 200, 3000, 32
#: Numbers that a draw's digest gives are below this.
WHOLE = 1 << 32


def binomial_se(p: Column, n: Column, floor: float = 0.0) -> Column:
    """Standard error of a rate; null for no rows. floor: least variance that counts."""
    return F.when(n > 0, F.sqrt(F.greatest(p * (1 - p), F.lit(floor)) / n))


def paired(arm: DataFrame, baseline: DataFrame, item: str, track: str, value: str) -> DataFrame:
    """track, item, base, arm: values on the items that both have."""
    return arm.select(item, track, F.col(value).alias("arm")).join(baseline.select(item, F.col(value).alias("base")), item)


def discordant(pairs: DataFrame, *keys: str) -> DataFrame:
    """b: pairs that only the arm solves; c: that only the baseline does (of each group)."""
    return pairs.groupBy(*keys).agg(F.count(F.when((F.col("arm") > 0.5) & (F.col("base") <= 0.5), 1)).alias("b"), F.count(F.when((F.col("arm") <= 0.5) & (F.col("base") > 0.5), 1)).alias("c"))


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact binomial probability of discordant counts as uneven as b and c."""
    n = b + c
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(b, c) + 1))
    return min(1.0, 2 * tail / 2**n)


def stirling_rest(z: Column) -> Column:
    """ln(gamma(z)) less Stirling's formula, for whole numbers from 1 on."""
    exact = [math.lgamma(k) - ((k - 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi)) for k in range(1, 16)]
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return F.when(z < 16, F.element_at(F.array(*map(F.lit, exact)), F.least(F.lit(15), z.cast("int")))).otherwise(series)


def half_beta(a: Column, b: Column) -> Column:
    """The regularised incomplete beta function at 1/2 of whole numbers a >= b >= 1, in a bounded number of steps: a continued fraction while b is small, Gauss's quadrature of the last standard deviations below 1/2 beyond."""
    a, b = a.cast("double"), b.cast("double")
    skew = (a - b) / (a + b)
    # x^a (1 - x)^b / B(a, b) at 1/2, relative to the same at the mean, where Stirling's formula leaves no large numbers to cancel
    rest = stirling_rest(a + b) - stirling_rest(a) - stirling_rest(b)
    height = F.sqrt(a * b / (2 * math.pi * (a + b))) * F.exp(rest)
    front = height * F.exp(-(a * F.log1p(skew) + b * F.log1p(-skew))) / a

    def fraction(front: Column, a: Column, b: Column) -> Column:
        tiny = lambda x: F.when(F.abs(x) < 1e-300, F.lit(1e-300)).otherwise(x)
        start = let(1 / tiny(1 - (a + b) / (a + 1) / 2), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))

        def half(acc: Column, top: Column) -> Column:
            return let(F.struct((1 / tiny(1 + top * acc["d"])).alias("d"), tiny(1 + top / acc["c"]).alias("c")), lambda x: F.struct(x["c"].alias("c"), x["d"].alias("d"), (acc["h"] * x["c"] * x["d"]).alias("h")))

        def step(acc: Column, m: Column) -> Column:
            even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) / 2
            odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)) / 2
            return let(half(acc, even), lambda x: half(x, odd))

        return front * F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), start, step, lambda acc: acc["h"])

    def quadrature(a: Column, b: Column) -> Column:
        at, weight = np.polynomial.legendre.leggauss(POINTS)
        mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        low = F.greatest(F.lit(0.0), F.least(mean - 10 * spread, 0.5 - 5 * spread))
        # the density at t, relative to the mean's: exp(a ln(t / mean) + b ln((1 - t) / (1 - mean))) / (t (1 - t))
        density = lambda t: F.exp(a * F.log1p((t - mean) / mean) + b * F.log1p((mean - t) / (1 - mean))) / (t * (1 - t))
        points = F.array(*[F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(at, weight)])
        area = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["w"] * density(low + (0.5 - low) * p["x"]))
        return height * area * (0.5 - low)

    return F.when(b <= SHAPE, let(F.struct(front.alias("f"), a.alias("a"), b.alias("b")), lambda v: fraction(v["f"], v["a"], v["b"]))).otherwise(quadrature(a, b))


def mcnemar_p(b: Column, c: Column) -> Column:
    """mcnemar_exact() as an expression, whose work doesn't grow with the counts."""
    low, n = F.least(b, c), b + c
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * half_beta(n - low, low + 1)))


def mcnemar(pairs: DataFrame) -> tuple[int, int, float]:
    b, c = discordant(pairs).head()
    return b, c, mcnemar_exact(b, c)


def digits(digest: Column, place: int) -> Column:
    """The number below WHOLE that the place-th eight hex digits of a digest are."""
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long")


def poisson_bounds() -> list[int]:
    """The numbers below which a draw of the Poisson distribution of mean 1 is 0, 1, 2, ...; beyond the last it is their count."""
    total, out = 0.0, []
    for k in range(10):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * WHOLE))
    return out


def resampled(n: Column, j: Column, x: Column, y: Column) -> Column:
    """Weights of equal items in one iteration of a Poisson bootstrap: the j-th of n draws of mean 1, or, for j = 0, one draw from the sum of n of them by its normal quantile and the first correction for skewness. x, y: whole numbers below WHOLE, evenly spread."""
    one = sum(((x >= bound).cast("double") for bound in poisson_bounds()[1:]), (x >= poisson_bounds()[0]).cast("double"))
    z = F.sqrt(-2 * F.log((x + 0.5) / WHOLE)) * F.cos(2 * math.pi * ((y + 0.5) / WHOLE))
    many = F.greatest(F.lit(0.0), F.floor(n + F.sqrt(n.cast("double")) * z + (z * z - 1) / 6 + 0.5).cast("double"))
    return F.when(j > 0, one).otherwise(many)


def differences(pairs: DataFrame, keys: list[str], track: str = "track") -> DataFrame:
    """keys, track, d, n, place: how often each difference of arm and base occurs in each track, and a text that stands for it in draws. Null tracks are left out, null differences are 0."""
    d = F.coalesce(F.col("arm").cast("double") - F.col("base").cast("double"), F.lit(0.0))
    counts = pairs.where(F.col(track).isNotNull()).groupBy(*keys, F.col(track).cast("string").alias("track"), F.round(d, 9).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    named = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], "track", F.round(F.col("d") * 1_000_000_000, 0).cast("long").cast("string"))
    return counts.withColumn("place", named)


def paired_bootstrap(pairs: DataFrame, iterations: int = 10_000, seed: int = 0, track: str = "track", keys: list[str] | None = None) -> DataFrame:
    """keys, lo, hi: the 95 % interval of the mean over tracks of the mean difference, items resampled within each track.

    Pairs are first counted by track and difference. In each iteration each difference gets a weight by a seeded hash (resampled()); weights and weighted differences of an iteration and a track are summed before they are dealt out. No task holds a track, and a difference costs the same whether one pair has it or a billion. A track of which an iteration draws nothing is left out of its mean.
    """
    keys, spark = keys or [], pairs.sparkSession
    draws = F.explode(F.when(F.col("n") <= FEW, F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(F.array(F.lit(0).cast("long"))))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // BLOCK)))
    dealt = differences(pairs, keys, track).withColumn("block", blocks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "place").withColumn("j", draws)
    drawn = dealt.withColumn("it", F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.lit(iterations), (F.col("block") + 1) * BLOCK) - 1)))
    hashed = drawn.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "it", "place", "j")))
    numbered = hashed.withColumns({"x": digits(F.col("h"), 0), "y": digits(F.col("h"), 1)})
    weighed = numbered.withColumn("w", resampled(F.col("n"), F.col("j"), F.col("x"), F.col("y")))
    sums = weighed.groupBy(*keys, "it", "track").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d")).alias("s"))
    means = sums.groupBy(*keys, "it").agg(F.avg(F.when(F.col("w") > 0, F.col("s") / F.col("w"))).alias("delta"))
    sorted_ = means.where(F.col("delta").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list("delta")).alias("ds"))  # a number for each iteration
    at = lambda q: F.element_at("ds", F.least(F.size("ds"), F.floor(q * F.size("ds")).cast("int") + 1))
    return sorted_.select(*keys, at(0.025).alias("lo"), at(0.975).alias("hi"))


def last_scores(log: DataFrame, arm: str, item: str, track: str, step: str, position: str, value: str, excluded: Column | None = None) -> DataFrame:
    """arm, step, item, track, value of each arm's last step, without excluded records; of an item that is there twice the last one."""
    rows = log if excluded is None else log.where(~F.coalesce(excluded, F.lit(False)))
    rows = rows.select(F.col(arm).alias("arm"), F.col(item).alias("item"), F.col(track).alias("track"), F.col(step).alias("step"), F.col(position).alias("position"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    return final_step(rows, "arm", "item", "step", "position").select("arm", "step", "item", "track", "value")


def compare_arms(scores: DataFrame, baseline: str, binary: bool = True, iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """A row for each arm of scores (last_scores()) but the baseline: step, n_shared (items that both have), resolved (mean of its tracks' means on those), delta to the baseline's own, lo and hi (paired bootstrap of the difference on shared items), wins, losses, p (McNemar, null unless binary), tied (whether the interval holds 0) and per_track (array of struct track, rate, n, se).

    Arms without shared items have n_shared 0 and nulls. One join by item brings all arms to the baseline; all else is sums by arm and track.
    """
    base = scores.where(F.col("arm") == baseline)
    mean = lambda df, *keys: df.groupBy(*keys, "track").agg(F.avg("value").alias("rate"), F.count(F.lit(1)).alias("n"))
    own = mean(base).agg(F.avg("rate")).head()[0]  # one number
    arms = scores.where(F.col("arm") != baseline)
    shared = arms.join(base.select("item", F.col("value").alias("base")), "item").select("arm", "item", "track", "base", "value")
    tracks = mean(shared, "arm").withColumn("se", binomial_se(F.col("rate"), F.col("n")) if binary else F.lit(None).cast("double"))
    rates = tracks.groupBy("arm").agg(F.avg("rate").alias("resolved"), F.sum("n").alias("n_shared"), F.array_sort(F.collect_list(F.struct("track", "rate", "n", "se"))).alias("per_track"))
    won = shared.groupBy("arm").agg(F.count_if(F.col("value") > F.col("base")).alias("wins"), F.count_if(F.col("value") < F.col("base")).alias("losses"))
    interval = paired_bootstrap(shared.withColumnRenamed("value", "arm_value").select("arm", "track", F.col("arm_value"), "base").withColumnsRenamed({"arm": "name", "arm_value": "arm"}), iterations, seed, keys=["name"]).withColumnRenamed("name", "arm")
    p = mcnemar_p(F.col("wins"), F.col("losses")) if binary else F.lit(None).cast("double")
    steps = arms.groupBy("arm").agg(F.max("step").alias("step"))
    out = steps.join(rates, "arm", "left").join(won, "arm", "left").join(interval, "arm", "left")  # a row for each arm
    return out.select("arm", "step", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "resolved", (F.col("resolved") - F.lit(own)).alias("delta"), "lo", "hi", "wins", "losses", F.when(F.col("wins").isNotNull(), p).alias("p"), ((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("tied"), "per_track")


def noise_band(rows: DataFrame, value: str, n: Column, baseline: float, z: float = 1.0) -> DataFrame:
    """rows with se, delta and significant: whether the distance to the baseline is over z standard errors of a difference."""
    se = binomial_se(F.col(value), n, 1e-6)
    return rows.withColumn("se", se).withColumn("delta", F.col(value) - baseline).withColumn("significant", F.abs("delta") > z * F.col("se") * math.sqrt(2))


def decide(value: float | None, best: float | None, *, failed: bool = False, guards: dict[str, float] | None = None, metrics: dict[str, float] | None = None, min_improvement: float = 0.0) -> tuple[str, str]:
    """(keep or reject, why) of a single run by its metric, the best so far and upper limits on other metrics; decisions() does so for whole tables."""
    broken = sorted(k for k, limit in (guards or {}).items() if (metrics or {}).get(k) is not None and metrics[k] > limit)
    if value is None or failed:
        return "reject", "run failed or no validation metric"
    if broken:
        return "reject", f"guard metrics violated: {broken}"
    if best is None or value > best + min_improvement:
        return "keep", f"{value:.4f} > best {best}"
    return "reject", f"{value} <= best {best}"


#: What decides about a run, in this order.
REASONS = ("aborted", "baseline", "failed", "guards", "better", "not better")


def decisions(runs: DataFrame, plan: str, position: str, run: str, value: str, baseline: Column, failed: Column | None = None, guards: dict[str, float] | None = None, min_improvement: float = 0.0, independent: bool = True) -> DataFrame:
    """A decision on each run of each plan, in order: plan, position, run, decision (keep, reject, or null where the plan was aborted before), reason (one of REASONS), broken (guards whose limit the run passes, sorted), best and best_value (the best run before this one).

    The baseline is kept unless it failed or has no value, which aborts its plan. Any other run is rejected if it failed or has no value, if a guard metric is over its limit (a null one isn't), or if its value isn't above the best one by more than min_improvement; else it is kept and becomes the best (if independent, only if its value is the higher one). Before a baseline there is no best, and any sound run is better. Runs are dealt by plan, sorted, and folded as a stream: a task holds one run and one state, however long its plans are. Rows that tie in position are taken by run; a null plan is one like others.
    """
    limits = guards or {}
    broken = F.array_sort(F.array_compact(F.array(*[F.when(F.col(g) > limit, F.lit(g)) for g, limit in limits.items()]))) if limits else F.array().cast("array<string>")
    value_ = F.col(value).cast("double")
    sound = value_.isNotNull() & ~F.isnan(value_) & ~F.coalesce(failed if failed is not None else F.lit(False), F.lit(False))
    rows = runs.select(F.col(plan).cast("string").alias("plan"), F.col(position).alias("position"), F.col(run).cast("string").alias("run"), value_.alias("value"), F.coalesce(baseline, F.lit(False)).alias("base"), sound.alias("sound"), broken.alias("broken"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, best_value, aborted = (), None, None, False
        for x in batches:
            out: list[tuple] = []
            for plan_, run_, v, base, ok, over in zip(*(x.column(c).to_pylist() for c in ("plan", "run", "value", "base", "sound", "broken"))):
                if at != (plan_,):
                    at, best, best_value, aborted = (plan_,), None, None, False
                before = (best, best_value)
                if aborted:
                    decision, reason = None, "aborted"
                elif base:
                    decision, reason, aborted = ("keep", "baseline", False) if ok else ("reject", "baseline", True)
                    best, best_value = (run_, v) if ok else before
                elif not ok:
                    decision, reason = "reject", "failed"
                elif over:
                    decision, reason = "reject", "guards"
                elif best_value is not None and not v > best_value + min_improvement:
                    decision, reason = "reject", "not better"
                else:
                    decision, reason = "keep", "better"
                    if not independent or best_value is None or v > best_value:
                        best, best_value = run_, v
                out.append((decision, reason, *before))
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("plan", "position", "run")), *made[:2], x.column("broken"), *made[2:]], names=["plan", "position", "run", "decision", "reason", "broken", "best", "best_value"])

    kind = dict(rows.dtypes)["position"]
    ordered = rows.repartition("plan").sortWithinPartitions("plan", "position", "run")
    return ordered.mapInArrow(fold, f"plan string, position {kind}, run string, decision string, reason string, broken array<string>, best string, best_value double")
