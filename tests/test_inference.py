"""Incomplete beta, step-down and variances by ranges, and the stratified bootstrap, against plain computations."""

from __future__ import annotations

import math
import random
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.functions import beta, stats
from harrow.operators import ordered, resampling, survival
from harrow.sources.scratch import written

PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459")


def log_factorial(n: int) -> Decimal:
    x = Decimal(n)
    return x * x.ln() - x + (2 * PI * x).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def exact_tail(k: int, n: int, p: str) -> float:
    """Terms in 60 digits, summed until they no longer count."""
    getcontext().prec = 60
    a, b = Decimal(p), 1 - Decimal(p)
    term, total = (log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * a.ln() + (n - k) * b.ln()).exp(), Decimal(0)
    while term > total * Decimal("1e-18"):
        total, term, k = total + term, term * (n - k) / (k + 1) * a / b, k + 1
    return float(total)


@pytest.mark.parametrize("k, n, p", [(500_010_000, 10**9, "0.5"), (100_050_000, 10**9, "0.1"), (1_000_500, 10**8, "0.01"), (600, 1000, "0.5")])
def test_tails_of_large_counts(k, n, p):
    assert beta.tail(np.array([k]), np.array([n]), np.array([float(p)]))[0] == pytest.approx(exact_tail(k, n, p), rel=1e-9)


def test_incomplete_beta_identities():
    x = np.linspace(0.001, 0.999, 200)
    assert beta.incomplete(0.5, 0.5, x) == pytest.approx(2 / np.pi * np.arcsin(np.sqrt(x)), abs=1e-12)
    assert beta.incomplete(2.5, 1, x) == pytest.approx(x**2.5, abs=1e-12)
    assert beta.incomplete(1, 7.25, x) == pytest.approx(1 - (1 - x) ** 7.25, abs=1e-12)
    for a, b in ((0.3, 4.1), (12.5, 30.0), (1e6, 2e6)):
        assert beta.incomplete(a, b, x) + beta.incomplete(b, a, 1 - x) == pytest.approx(np.ones(len(x)), abs=1e-10)
        # I_x(a, b) = I_x(a + 1, b) + x^a (1 - x)^b / (a B(a, b))
        step = np.exp(math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        assert beta.incomplete(a, b, x) - beta.incomplete(a + 1, b, x) == pytest.approx(step, rel=1e-5, abs=1e-9)


def test_edges_of_the_incomplete_beta(spark):
    rows = [(2.0, 3.0, -1.0), (2.0, 3.0, 0.0), (2.0, 3.0, 1.0), (2.0, 3.0, 7.0), (0.0, 3.0, 0.5), (None, 3.0, 0.5), (2.0, 3.0, float("nan"))]
    got = spark.createDataFrame(rows, "a double, b double, x double").coalesce(1).select(stats.incomplete_beta("a", "b", "x").alias("i")).collect()
    assert [r["i"] for r in got] == [0.0, 0.0, 1.0, 1.0, None, None, None]
    assert spark.createDataFrame([], "a double, b double, x double").select(stats.beta_fraction("a", "b", "x")).collect() == []


# --- by ranges ----------------------------------------------------------------------------


def test_running_sums_by_ranges(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "b", None]), float(draw.randint(0, 300)), draw.randint(0, 9)) for _ in range(3000)]
    df = written(spark.createDataFrame(rows, "k string, t double, n int"))
    ranged = ordered.with_ranges(df, "t", per_range=100)
    assert ranged.select("_range").distinct().count() > 20
    for descending in (False, True):
        got = {(r["k"], r["t"], r["s"]) for r in ordered.running_sums(ranged, ["k"], "t", {"s": F.col("n")}, descending).collect()}
        after = (lambda a, b: a >= b) if descending else (lambda a, b: a <= b)
        assert got == {(k, t, sum(n for j, u, n in rows if j == k and after(u, t))) for k, t, _ in rows}


def test_medians_by_ranges(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "b", None, "c"]), draw.choice([None, float(draw.randint(0, 50)), draw.random() * 50])) for _ in range(2000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r["k"]: r["median"] for r in ordered.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", per_range=50).collect()}
    assert got == {k: pytest.approx(float(np.median([v for j, v in rows if j == k and v is not None]))) for k in ("a", "b", "c", None, "one", "two")}


def test_variance_by_ranges_equals_the_window_form(spark):
    draw = random.Random(2)
    rows = [(draw.choice("aaab"), round(draw.expovariate(0.2) + 0.03, 3), draw.choice([0, 0, 1, 2])) for _ in range(2000)] + [("c", 5.0, 1), ("c", 5.0, 2), ("d", 1.0, 0)]
    obs = spark.createDataFrame(rows, "g string, months double, event int")
    want = {(r["g"], r["t"]): r for r in survival.aalen_johansen(survival.risk_table(obs, ["g"]), ["g"]).collect()}
    got = {(r["g"], r["t"]): r for r in survival.variance_by_ranges(obs, ["g"], per_range=60).collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        for c in ("at_risk", "survival", "cif", "variance", "low", "high"):
            assert r[c] == pytest.approx(want[key][c], rel=1e-9, abs=1e-12), (key, c)


def test_variance_against_sums_by_hand(spark):
    draw = random.Random(4)
    rows = [("s", float(draw.randint(1, 40)), draw.choice([0, 1, 2])) for _ in range(150)]
    got = {r["t"]: r["variance"] for r in survival.variance_by_ranges(spark.createDataFrame(rows, "g string, months double, event int"), ["g"], per_range=7).collect()}
    times, steps, s, cif = sorted({t for _, t, _ in rows}), [], 1.0, 0.0
    for t in times:
        n = sum(u >= t for _, u, _ in rows)
        d1, d = sum(u == t and e == 1 for _, u, e in rows), sum(u == t and e > 0 for _, u, e in rows)
        cif += s * d1 / n
        steps.append((t, n, d, d1, s, cif))
        s *= 1 - d / n
        v = sum((cif - f) ** 2 * (m / (k * (k - m)) if k > m else 0.0) + p * p * (k - m1) / k * m1 / k**2 - 2 * (cif - f) * p * m1 / k**2 for _, k, m, m1, p, f in steps)
        assert got[t] == pytest.approx(max(v, 0.0), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("per_range", [5, 10**6])
def test_step_down_by_ranges(spark, per_range):
    draw = random.Random(3)
    p = [round(draw.random() ** 3, 3) for _ in range(400)] + [0.0, 1.0, 1.0, None, None]
    rows = survival.false_discovery(spark.createDataFrame(list(enumerate(p)), "i int, p double"), per_range=per_range).collect()
    tests = sorted(x for x in p if x is not None)
    m, harmonic = len(tests), sum(1 / i for i in range(1, len(tests) + 1))
    rank = {x: sum(y <= x for y in tests) for x in set(tests)}
    assert len(rows) == len(p)
    for r in rows:
        if r["p"] is None:
            assert r["q_bh"] is None and r["q_by"] is None
        else:
            raw = min(y * m / rank[y] for y in rank if y >= r["p"])
            assert r["q_bh"] == pytest.approx(min(1, raw)) and r["q_by"] == pytest.approx(min(1, raw * harmonic))


# --- bootstrap within strata ---------------------------------------------------------------


def sample(seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    out = []
    for name, size, share, weight in (("a", 400, 0.9, 1.0), ("b", 200, 0.5, 7.5), ("c", 60, 0.2, 20.0)):
        out += [(name, bool(draw.random() < share), int(draw.integers(1, 4)) * weight) for _ in range(size)]
    return out


def test_bootstrap_is_near_plain_resampling(spark):
    rows = sample(1)
    df = spark.createDataFrame(rows, "s string, ok boolean, w double")
    pairs = resampling.weighted_pairs([("precision", F.col("ok"), F.lit(True))], F.col("w"))
    got = resampling.bootstrap_ratios(df, "s", pairs, draws=2000).first()
    draw, values = np.random.default_rng(9), []
    strata = [np.array([(w * ok, w) for s, ok, w in rows if s == name]) for name in "abc"]
    for _ in range(4000):
        top, bottom = sum(x[draw.integers(0, len(x), len(x))].sum(axis=0) for x in strata)
        values.append(top / bottom)
    values.sort()
    assert got["estimate"] == pytest.approx(sum(w * ok for _, ok, w in rows) / sum(w for *_, w in rows))
    assert got["low"] == pytest.approx(values[int(0.025 * 4000)], rel=0.02)
    assert got["high"] == pytest.approx(values[int(0.975 * 4000) - 1], rel=0.02)


def test_bootstrap_keeps_strata_and_repeats(spark):
    """A share that the strata fix has no spread; draws don't depend on how rows lie; what cannot be formed is null."""
    df = spark.createDataFrame(sample(2) + [(None, True, 1.0), (None, None, 2.0)], "s string, ok boolean, w double")
    pairs = {"fixed": (F.when(F.col("s") == "a", 1.0), F.lit(1.0)), "loose": (F.col("w") * F.col("ok").cast("int"), F.col("w")), "none": (F.lit(1.0), F.lit(0.0))}
    rows = [{r["metric"]: r for r in resampling.bootstrap_ratios(d, "s", pairs, draws=300).collect()} for d in (df, df.repartition(7), df.orderBy("w"))]
    assert rows[0] == rows[1] == rows[2]
    fixed = rows[0]["fixed"]
    assert fixed["low"] == fixed["high"] == fixed["estimate"] == pytest.approx(400 / 662)
    assert rows[0]["loose"]["low"] < rows[0]["loose"]["estimate"] < rows[0]["loose"]["high"]
    assert [rows[0]["none"][c] for c in ("estimate", "low", "high")] == [None] * 3


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([], "s string, x double")
    (row,) = resampling.bootstrap_ratios(df, "s", {"x": (F.col("x"), F.lit(1.0))}, draws=10).collect()
    assert (row["estimate"], row["low"], row["high"]) == (None, None, None)
