"""Statistics against hand-computed values, exact arithmetic and invariants."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from harrow.functions import stats
from harrow.operators import survival


def test_published_intervals(spark):
    df = spark.createDataFrame([(359, 8008), (11, 45), (0, 0)], "k long, n long")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    a, b, none = (tuple(r) for r in df.select(low, high).collect())
    assert a == pytest.approx((0.0405, 0.0496), abs=5e-5)
    assert b == pytest.approx((0.142, 0.387), abs=5e-4)
    assert none == (None, None)


def test_competing_risks_by_hand(spark):
    # of four at risk: an event at 1, a competing end at 2, an event among two at 3, the last one at 4
    obs = spark.createDataFrame([("s", 1.0, 1), ("s", 2.0, 2), ("s", 3.0, 0), ("s", 4.0, 1)], "g string, months double, event int")
    curve = survival.aalen_johansen(survival.risk_table(obs, ["g"]), ["g"])
    assert [(r["t"], round(r["cif"], 6)) for r in curve.orderBy("t").collect()] == [(1.0, 0.25), (2.0, 0.25), (3.0, 0.25), (4.0, 0.75)]
    assert {r["horizon"]: round(r["cif"], 6) for r in survival.at_horizons(curve, ["g"], [0.5, 1, 2, 4]).collect()} == {0.5: 0.0, 1.0: 0.25, 2.0: 0.25, 4.0: 0.75}


def test_both_incidences_sum_to_one_less_survival(spark):
    rows = [("s", 1.0 + (i * 37 % 101) / 7, i % 3) for i in range(200)]
    obs = spark.createDataFrame(rows, "g string, months double, event int")
    swapped = obs.withColumn("event", F.expr("case event when 1 then 2 when 2 then 1 else 0 end"))
    a, b = (survival.aalen_johansen(survival.risk_table(o, ["g"]), ["g"]).orderBy("t").collect() for o in (obs, swapped))
    for x, y in zip(a, b, strict=True):
        assert x["cif"] + y["cif"] + x["survival"] == pytest.approx(1)
        assert 0 <= x["low"] <= x["cif"] + 1e-12 and x["cif"] <= x["high"] + 1e-12
    assert [x["cif"] for x in a] == sorted(x["cif"] for x in a)


def test_analytic_interval_is_near_the_bootstrap(spark):
    rows = [("s", 1.0 + (i * 37 % 101) / 7, i % 3, i) for i in range(300)]
    obs = spark.createDataFrame(rows, "g string, months double, event int, i int")
    curve = survival.aalen_johansen(survival.risk_table(obs, ["g"]), ["g"]).where("t <= 8").orderBy(F.desc("t")).first()
    boot = survival.bootstrap_at(obs, ["g"], 8.0, draws=1000).first()
    width = curve["high"] - curve["low"]
    assert abs(boot["low"] - curve["low"]) < 0.3 * width and abs(boot["high"] - curve["high"]) < 0.3 * width


@pytest.mark.parametrize("k, n, p", [(0, 5, 0.3), (3, 5, 0.3), (5, 5, 0.3), (6, 5, 0.3), (7, 40, 0.05), (30, 200, 0.1)])
def test_binomial_tail_is_exact(spark, k, n, p):
    f = Fraction(str(p))
    exact = sum(comb(n, i) * f**i * (1 - f) ** (n - i) for i in range(k, n + 1))
    got = spark.createDataFrame([(k, n, p)], "k long, n long, p double").select(stats.binomial_tail("k", "n", "p")).first()[0]
    assert got == pytest.approx(float(exact), rel=1e-10, abs=1e-300)


def test_false_discovery_invariants(spark):
    p = [0.001, 0.02, 0.02, 0.3, 0.9, None]
    rows = survival.false_discovery(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")).collect()
    assert len(rows) == 6
    tests = sorted((r for r in rows if r["p"] is not None), key=lambda r: (r["p"], r["q_bh"]))
    for r in tests:
        assert r["p"] <= r["q_bh"] <= r["q_by"] <= 1
    assert [r["q_bh"] for r in tests] == sorted(r["q_bh"] for r in tests)
    assert tests[0]["q_bh"] == pytest.approx(0.005) and tests[1]["q_bh"] == pytest.approx(0.02 * 5 / 3)


def test_beta_above_baseline_has_a_step_without_width(spark):
    df = spark.createDataFrame([(2.0, 8.0, 0.2), (5.0, 5.0, 0.2)], "a double, b double, p double")
    got = [r[0] for r in df.select(stats.prob_above(F.col("a"), F.col("b"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(0.5, abs=1e-6) and got[1] > 0.95
