"""Cumulative incidence with competing risks, follow-up, and control of false discoveries."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cloglog_interval
from ..sources.scratch import written
from .ordered import PER_RANGE, joined, running_sums, with_ranges

#: Event codes: 0 censored, 1 event, 2 competing.
CENSORED, EVENT, COMPETING = 0, 1, 2


def risk_table(obs: DataFrame, keys: Sequence[str], months: str = "months", event: str = "event") -> DataFrame:
    """Per segment and distinct time (4 decimals): events, competing, censored, and at risk. The
    countdown runs over distinct times, not over observations."""
    t = obs.groupBy(*keys, F.round(months, 4).alias("t")).agg(*[F.count_if(F.col(event) == c).alias(n) for c, n in ((EVENT, "d1"), (COMPETING, "d2"), (CENSORED, "d0"))])
    left = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("at_risk", F.sum(F.col("d0") + F.col("d1") + F.col("d2")).over(left))


def aalen_johansen(risk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Risk table -> with survival, cif, its variance (Aalen's form, from running sums) and bounds."""
    w = Window.partitionBy(*keys).orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    n, d1 = F.col("at_risk"), F.col("d1")
    d = F.col("d1") + F.col("d2")
    # a product as a sum of logs; a time at which all fall ends it at zero
    ended = F.max(F.when(d >= n, 1).otherwise(0))
    logs = F.sum(F.when(d < n, F.log1p(-d / n)).otherwise(0.0))
    product = lambda frame: F.when(F.coalesce(ended.over(frame), F.lit(0)) == 1, 0.0).otherwise(F.exp(F.coalesce(logs.over(frame), F.lit(0.0))))
    out = risk.withColumns({"s_before": product(before), "survival": product(upto)})
    out = out.withColumn("cif", F.sum(F.col("s_before") * d1 / n).over(upto))
    # var F(t) = sum (F(t)-F_i)^2 a_i + sum b_i - 2 sum (F(t)-F_i) c_i, expanded in F(t)
    safe = F.when(n > d, n * (n - d))
    a = F.coalesce(d / safe, F.lit(0.0))
    b = F.when(n > 1, F.col("s_before") ** 2 * d1 * (n - d1) / n**3).otherwise(0.0)
    c = F.col("s_before") * d1 / n**2
    f = F.col("cif")
    total = lambda x: F.sum(x).over(upto)
    out = out.withColumn("variance", F.greatest(F.lit(0.0), f * f * total(a) - 2 * f * total(f * a) + total(f * f * a) + total(b) - 2 * (f * total(c) - total(f * c))))
    low, high = cloglog_interval(f, F.col("variance"))
    return out.withColumns({"low": low, "high": high}).drop("s_before")


def at_horizons(curve: DataFrame, keys: Sequence[str], horizons: Sequence[float]) -> DataFrame:
    """The step function at each horizon: the last time not after it, 0 before the first."""
    rows = curve.select(*keys, "t", "cif", F.explode(F.array(*map(F.lit, map(float, horizons)))).alias("horizon"))
    return rows.groupBy(*keys, "horizon").agg(F.coalesce(F.max_by(F.when(F.col("t") <= F.col("horizon"), F.col("cif")), F.when(F.col("t") <= F.col("horizon"), F.col("t"))), F.lit(0.0)).alias("cif"))


def median_follow_up(obs: DataFrame, keys: Sequence[str], months: str = "months", event: str = "event") -> DataFrame:
    """Reverse Kaplan-Meier median: censoring is the event. Null where half is never reached."""
    risk = risk_table(obs, keys, months, event)
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    fall = F.when(F.col("d0") >= F.col("at_risk"), F.lit(-1e9)).otherwise(F.log1p(-F.col("d0") / F.col("at_risk")))
    s = risk.withColumn("s", F.exp(F.sum(fall).over(w)))
    return s.groupBy(*keys).agg(F.min(F.when(F.col("s") <= 0.5, F.col("t"))).alias("median_months"))


def variance_by_ranges(obs: DataFrame, keys: Sequence[str], months: str = "months", event: str = "event", per_range: int = PER_RANGE) -> DataFrame:
    """keys, t, d0, d1, d2, at_risk, survival, cif, variance, low, high: as aalen_johansen of risk_table, for segments
    with any number of distinct times.

    Times are cut into ranges. Within a range, survival and incidence are those at its start, S and F, times and plus
    local ones (survival S l, incidence F + S g), so the six sums of the variance are polynomials in S and F whose
    coefficients are local running sums: one pass over rows gives these, one over range totals gives S, F
    and the six sums before each range.
    """
    keys = list(keys)
    own = [*keys, "_range"]
    counted = obs.groupBy(*keys, F.round(months, 4).alias("t")).agg(*[F.count_if(F.col(event) == c).alias(n) for c, n in ((EVENT, "d1"), (COMPETING, "d2"), (CENSORED, "d0"))])
    risk = running_sums(with_ranges(written(counted), "t", per_range), keys, "t", {"at_risk": F.col("d0") + F.col("d1") + F.col("d2")}, descending=True)

    w = Window.partitionBy(*own).orderBy("t")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    n, d1 = F.col("at_risk"), F.col("d1")
    d = d1 + F.col("d2")
    risk = risk.withColumns({"_end": F.when(d >= n, 1).otherwise(0), "_log": F.when(d < n, F.log1p(-d / n)).otherwise(0.0), "_a": F.when(n > d, d / (n * (n - d))).otherwise(0.0)})
    product = lambda frame: F.when(F.coalesce(F.max("_end").over(frame), F.lit(0)) == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum("_log").over(frame), F.lit(0.0))))
    local = risk.withColumns({"_l": product(earlier), "_s": product(upto)})
    local = local.withColumn("_g", F.sum(F.col("_l") * d1 / n).over(upto))
    g, b, c = F.col("_g"), F.col("_l") ** 2 * ((n - d1) / n) * (d1 / n**2), F.col("_l") * d1 / n**2
    terms = {"a": F.col("_a"), "ga": g * F.col("_a"), "gga": g * g * F.col("_a"), "b": b, "c": c, "gc": g * c}
    local = local.withColumns({f"_{k}": v for k, v in terms.items() if k != "a"})
    local = written(local.withColumns({f"_sum_{k}": F.sum(f"_{k}").over(upto) for k in terms}))

    last = lambda name: F.max_by(name, "t").alias(name)
    totals = local.groupBy(*own).agg(last("_s"), last("_g"), *[last(f"_sum_{k}") for k in terms])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    some = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    ended = F.coalesce(F.max(F.when(F.col("_s") <= 0, 1).otherwise(0)).over(before), F.lit(0)) == 1
    totals = totals.withColumn("_surv0", F.when(ended, 0.0).otherwise(F.exp(some(F.log(F.greatest("_s", F.lit(1e-300)))))))
    totals = totals.withColumn("_cif0", some(F.col("_surv0") * F.col("_g")))
    S, I, k = F.col("_surv0"), F.col("_cif0"), {name: F.col(f"_sum_{name}") for name in terms}  # noqa: E741
    six = {"a": k["a"], "fa": I * k["a"] + S * k["ga"], "ffa": I * I * k["a"] + 2 * I * S * k["ga"] + S * S * k["gga"], "b": S * S * k["b"], "c": S * k["c"], "fc": I * S * k["c"] + S * S * k["gc"]}
    offsets = totals.select(*own, "_surv0", "_cif0", *[some(x).alias(f"_off_{name}") for name, x in six.items()])

    at = joined(local, offsets, own)
    at = at.withColumns({"survival": S * F.col("_s"), "cif": I + S * F.col("_g"), **{f"_six_{name}": F.col(f"_off_{name}") + x for name, x in six.items()}})
    f, v = F.col("cif"), {name: F.col(f"_six_{name}") for name in six}
    at = at.withColumn("variance", F.greatest(F.lit(0.0), f * f * v["a"] - 2 * f * v["fa"] + v["ffa"] + v["b"] - 2 * f * v["c"] + 2 * v["fc"]))
    low, high = cloglog_interval(f, F.col("variance"))
    return at.select(*keys, "t", "d0", "d1", "d2", "at_risk", "survival", "cif", "variance", low.alias("low"), high.alias("high"))


def step_down(tests: DataFrame, p: str, per_range: int = PER_RANGE) -> DataFrame:
    """p (distinct, not null), q: the least of p m / rank over the ranks from its own on, at most 1; m tests in all.

    Equal p-values are one row with a count, and rank is the number of tests up to them. Ranks run
    from the lowest range, minima from the highest, each over range totals first."""
    counted = written(tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n")))
    m = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = running_sums(with_ranges(counted, "p", per_range), [], "p", {"rank": F.col("n")}).withColumn("raw", F.col("p") * F.lit(float(m)) / F.col("rank"))
    least = ranked.groupBy("_range").agg(F.min("raw").alias("least"))
    above = least.select("_range", F.min("least").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    own = F.min("raw").over(Window.partitionBy("_range").orderBy(F.desc("p")))
    return joined(ranked.withColumn("own", own), above, ["_range"]).select("p", F.least(F.lit(1.0), "own", F.coalesce("above", F.lit(1.0))).alias("q"), F.least("own", F.coalesce("above", F.col("own"))).alias("raw"), F.lit(m).alias("m"))


def false_discovery(family: DataFrame, p: str = "p", per_range: int = PER_RANGE) -> DataFrame:
    """A family of tests -> with q_bh and q_by, the latter by the harmonic number of the family's size. Null
    p-values are no tests and get null."""
    q = step_down(family, p, per_range)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.least("m", F.lit(1000)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    # beyond a thousand terms by the series of the logarithm, exact to the last digits
    m = F.col("m").cast("double")
    harmonic = F.when(F.col("m") <= 1000, harmonic).otherwise(F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))
    q = q.select(F.col("p").alias("_p"), F.col("q").alias("q_bh"), F.least(F.lit(1.0), F.col("raw") * harmonic).alias("q_by"))
    return family.join(q, F.col(p) == F.col("_p"), "left").drop("_p")


def bootstrap_at(obs: DataFrame, keys: Sequence[str], horizon: float, draws: int = 1000, months: str = "months", event: str = "event", seed: str = "b1") -> DataFrame:
    """Percentile interval (2.5 to 97.5 %) of the incidence at a horizon, resampled within each segment.

    Observations are first reduced to cells (segment, distinct time, code, count). A replicate of a cell
    is a Poisson draw with its count as mean, from a hash of seed, replicate and cell: the sum of that many
    Poisson(1) weights. So what is laid out per replicate is cells, not observations."""
    cells = obs.groupBy(*keys, F.round(months, 4).alias("t"), F.col(event).alias("code")).agg(F.count("*").alias("n"))
    own = [*keys, "draw"]
    # cells are few: their replicates are dealt out before anything is computed on them
    rows = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition(*own)
    uniform = [(F.pmod(F.xxhash64(F.lit(f"{seed}{i}"), "draw", *keys, "t", "code"), F.lit(1 << 30)) + 0.5) / float(1 << 30) for i in range(2)]
    rows = rows.withColumn("w", _poisson(F.col("n"), *uniform))
    counts = [F.sum(F.when(F.col("code") == c, F.col("w")).otherwise(0)).alias(n) for c, n in ((EVENT, "d1"), (COMPETING, "d2"), (CENSORED, "d0"))]
    risk = rows.groupBy(*own, "t").agg(*counts).where("d0 + d1 + d2 > 0")
    left = Window.partitionBy(*own).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    risk = risk.withColumn("at_risk", F.sum(F.col("d0") + F.col("d1") + F.col("d2")).over(left))
    # the incidence alone, without its variance: survival before each time, up to the horizon
    before = Window.partitionBy(*own).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    d, n = F.col("d1") + F.col("d2"), F.col("at_risk")
    fall = F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(-1e9))
    terms = risk.withColumn("term", F.exp(F.coalesce(F.sum(fall).over(before), F.lit(0.0))) * F.col("d1") / n)
    points = terms.groupBy(*own).agg(F.sum(F.when(F.col("t") <= horizon, F.col("term")).otherwise(0.0)).alias("cif"))
    cif = F.col("cif")
    return points.groupBy(*keys).agg(F.percentile(cif, F.lit(0.025)).alias("low"), F.percentile(cif, F.lit(0.975)).alias("high"))


def _poisson(mean: Column, u: Column, v: Column) -> Column:
    """A Poisson draw: from the distribution function up to a mean of 30, beyond it the rounded normal."""
    p = F.exp(-mean)
    start = F.struct(p.alias("p"), p.alias("upto"), F.lit(0).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        return F.struct(p.alias("p"), (a["upto"] + p).alias("upto"), (a["k"] + F.when(u >= a["upto"], 1).otherwise(0)).alias("k"))

    small = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(30), mean).cast("int") * 2 + 10), start, step, lambda a: a["k"])
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * pi * v)
    return F.when(mean <= 30, small).otherwise(F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * normal).cast("long")))
