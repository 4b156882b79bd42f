"""Family F (statistics) and the parts of G that belong to it.

A row of a segment table is a nation: closed orders, and events (closed orders with a return)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import ordered, survival
from .records import SQL as REC
from .records import closed, event, records
from .registry import query, table

SEGMENTS = f"WITH {REC}, seg AS (SELECT nation, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n, count(*) FILTER (o_orderstatus IN ('F', 'O') AND returned) AS k FROM rec GROUP BY nation)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("nation").agg(F.count_if(closed()).alias("n"), F.count_if(closed() & event()).alias("k"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "f01_wilson",
    f"""{SEGMENTS}, p AS (SELECT nation, n, k, k::DOUBLE / nullif(n, 0) AS p FROM seg)
    SELECT nation, round(greatest(0.0, (p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS low,
      round(least(1.0, (p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS high FROM p""",
)
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(segments(spark, sf_dir).select("nation", low.alias("low"), high.alias("high")), "low", "high")


#: Customers, many of them without a closed order.
UNITS = f"WITH {REC}, u AS (SELECT c_custkey, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n, count(*) FILTER (o_orderstatus IN ('F', 'O') AND returned) AS k FROM customer LEFT JOIN rec ON o_custkey = c_custkey GROUP BY 1)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = records(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(closed()).alias("n"), F.count_if(closed() & event()).alias("k"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(by, "c_custkey", "left").fillna(0, ["n", "k"])


def wilson_sql(empty: str) -> str:
    return f"""{UNITS}, p AS (SELECT c_custkey, n, k, k::DOUBLE / nullif(n, 0) AS p FROM u)
    SELECT c_custkey, CASE WHEN n = 0 THEN {empty} ELSE round(greatest(0.0, (p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) END AS low,
      CASE WHEN n = 0 THEN {empty} ELSE round(least(1.0, (p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) END AS high FROM p"""


def unit_wilson(spark: SparkSession, sf_dir: str, empty: float) -> DataFrame:
    low, high = stats.wilson(F.col("k"), F.col("n"), empty=empty)
    return rounded(units(spark, sf_dir).select("c_custkey", low.alias("low"), high.alias("high")), "low", "high")


@query("f02_wilson_empty_filled", wilson_sql("0.0::DOUBLE"))
def wilson_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_wilson(spark, sf_dir, 0.0)


@query("f03_wilson_undefined", wilson_sql("'nan'::DOUBLE"))
def wilson_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_wilson(spark, sf_dir, float("nan"))


BETA = f"""{SEGMENTS}, pool AS (SELECT sum(k)::DOUBLE / sum(n) AS p0 FROM seg), b AS (SELECT nation, p0 * 20 + k AS al, (1 - p0) * 20 + n - k AS be, p0 FROM seg, pool),
  m AS (SELECT nation, p0, al / (al + be) AS mean, sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) AS sd FROM b)"""


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts shrunk towards the pooled rate by a prior of 20 records."""
    seg = segments(spark, sf_dir)
    pool = seg.agg((F.sum("k") / F.sum("n")).alias("p0"))
    both = seg.join(F.broadcast(pool), F.lit(True))  # one row
    return both.withColumns({"al": F.col("p0") * 20 + F.col("k"), "be": (1 - F.col("p0")) * 20 + F.col("n") - F.col("k")})


@query("f04_beta_interval", f"{BETA} SELECT nation, round(mean, 6) AS mean, round(greatest(0.0, mean - 1.645 * sd), 6) AS low, round(least(1.0, mean + 1.645 * sd), 6) AS high FROM m")
def beta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, low, high, _ = stats.beta_mean(F.col("al"), F.col("be"))
    return rounded(posterior(spark, sf_dir).select("nation", mean.alias("mean"), low.alias("low"), high.alias("high")), "mean", "low", "high")


ERF = "sign({x}) * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x}))"


@query(
    "f05_probability_above_baseline",
    f"""{BETA}, z AS (SELECT nation, (p0 - mean) / sd / sqrt(2.0) AS x FROM m), e AS (SELECT nation, x, 1 / (1 + 0.3275911 * abs(x)) AS t FROM z)
    SELECT nation, round(1 - 0.5 * (1 + {ERF.format(x="x", t="t")}), 5) AS above FROM e""",
)
def above_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior(spark, sf_dir).select("nation", F.round(stats.prob_above(F.col("al"), F.col("be"), F.col("p0")), 5).alias("above"))


@query(
    "f07_ranked_outliers",
    f"""{BETA}, r AS (SELECT m.nation, n, k, mean / p0 AS lift, mean FROM m JOIN seg ON m.nation = seg.nation WHERE n >= 10 AND k >= 2)
    SELECT nation, n, k, round(lift, 6) AS lift, row_number() OVER (ORDER BY round(lift, 6) DESC, n DESC, nation)::BIGINT AS place FROM r""",
)
def ranked_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with enough rows and events, by shrunk lift. One row per segment is ranked."""
    from pyspark.sql import Window

    mean = stats.beta_mean(F.col("al"), F.col("be"))[0]
    rows = posterior(spark, sf_dir).where("n >= 10 and k >= 2").select("nation", "n", "k", F.round(mean / F.col("p0"), 6).alias("lift"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("lift"), F.desc("n"), "nation")).cast("long"))


# --- competing risks ----------------------------------------------------------------------

#: An order's follow-up ends at its last shipment; F with a return is the event, F without one the
#: competing end, anything else is censored. Below 0.03 or above 240 months it is left out.
OBS = f"""WITH {REC}, o AS (SELECT o_orderkey, segment, datediff('day', odate, last_ship) / 30.4375 AS months,
    CASE WHEN o_orderstatus = 'F' AND returned THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS event FROM rec),
  obs AS (SELECT segment, months, event FROM o WHERE months BETWEEN 0.03 AND 240),
  tt AS (SELECT segment, round(months, 4) AS t, count(*) FILTER (event = 1) AS d1, count(*) FILTER (event = 2) AS d2, count(*) FILTER (event = 0) AS d0 FROM obs GROUP BY 1, 2),
  risk AS (SELECT *, sum(d0 + d1 + d2) OVER (PARTITION BY segment ORDER BY t DESC)::BIGINT AS at_risk FROM tt)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import elapsed_months

    r = records(spark, sf_dir).withColumn("months", elapsed_months(F.col("odate"), F.col("last_ship")))
    code = F.when((F.col("o_orderstatus") == "F") & event(), survival.EVENT).when(F.col("o_orderstatus") == "F", survival.COMPETING).otherwise(survival.CENSORED)
    reason = F.when(F.col("months").isNull(), "no end").when(F.col("months") < 0.03, "too short").when(F.col("months") > 240, "too long")
    return r.select("o_orderkey", "segment", "months", code.alias("event"), reason.alias("left_out"))


@query("f08_observations", f"WITH {REC}, o AS (SELECT o_orderstatus, returned, datediff('day', odate, last_ship) / 30.4375 AS months FROM rec) SELECT CASE WHEN months IS NULL THEN 'no end' WHEN months < 0.03 THEN 'too short' WHEN months > 240 THEN 'too long' END AS left_out, CASE WHEN o_orderstatus = 'F' AND returned THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS event, count(*) AS n FROM o GROUP BY ALL")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).groupBy("left_out", "event").agg(F.count("*").alias("n"))


@query("f09_risk_table", f"{OBS} SELECT segment, t, d0, d1, d2, at_risk FROM risk")
def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.risk_table(observed(spark, sf_dir).where("left_out is null"), ["segment"]).select("segment", "t", "d0", "d1", "d2", "at_risk")


CURVE = f"""{OBS}, s AS (SELECT *, coalesce(exp(sum(CASE WHEN d1 + d2 < at_risk THEN ln(1 - (d1 + d2)::DOUBLE / at_risk) ELSE -1e9 END) OVER (PARTITION BY segment ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS sb FROM risk),
  c AS (SELECT segment, t, sum(sb * d1 / at_risk) OVER (PARTITION BY segment ORDER BY t) AS cif FROM s)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.aalen_johansen(survival.risk_table(observed(spark, sf_dir).where("left_out is null"), ["segment"]), ["segment"])


@query("f10_cumulative_incidence", f"{CURVE} SELECT segment, round(t, 4) AS t, round(cif, 6) AS cif FROM c")
def cumulative_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(spark, sf_dir).select("segment", "t", F.round("cif", 6).alias("cif"))


@query("f12_incidence_at_horizons", f"{CURVE}, h AS (SELECT unnest([0.5, 1.0, 2.0, 3.0, 4.0]) AS horizon) SELECT segment, horizon::DOUBLE AS horizon, round(coalesce(arg_max(cif, t) FILTER (t <= horizon), 0.0), 6) AS cif FROM c, h GROUP BY ALL")
def at_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survival.at_horizons(curves(spark, sf_dir), ["segment"], [0.5, 1, 2, 3, 4]), "cif")


@query("f15_monthly_points", f"{CURVE}, h AS (SELECT unnest(range(0, 85, 3)) AS horizon) SELECT segment, horizon::DOUBLE AS horizon, round(coalesce(arg_max(cif, t) FILTER (t <= horizon), 0.0), 6) AS cif FROM c, h GROUP BY ALL")
def monthly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survival.at_horizons(curves(spark, sf_dir), ["segment"], range(0, 85, 3)), "cif")


@query("f13_median_follow_up", f"{OBS}, s AS (SELECT segment, t, exp(sum(CASE WHEN d0 >= at_risk THEN -1e9 ELSE ln(1 - d0::DOUBLE / at_risk) END) OVER (PARTITION BY segment ORDER BY t)) AS s FROM risk) SELECT segment, min(t) FILTER (s <= 0.5) AS median_months FROM s GROUP BY segment")
def median_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.median_follow_up(observed(spark, sf_dir).where("left_out is null"), ["segment"])


@query("f14_curve_bundle", f"{OBS}, g AS (SELECT segment, count(*) AS n, count(*) FILTER (event = 1) AS events, count(*) FILTER (event = 2) AS competing, count(*) FILTER (event = 0) AS censored FROM obs GROUP BY segment) SELECT *, round(events::DOUBLE / n, 6) AS naive FROM g")
def curve_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observed(spark, sf_dir).where("left_out is null")
    counts = o.groupBy("segment").agg(F.count("*").alias("n"), *[F.count_if(F.col("event") == c).alias(a) for a, c in (("events", 1), ("competing", 2), ("censored", 0))])
    return counts.withColumn("naive", F.round(stats.rate(F.col("events"), F.col("n")), 6))


@query("f16_bootstrap_interval")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bootstrap of the incidence at two months: each replicate draws the count of every cell
    of time and code, so replicates are grouped sums and no group is held in memory."""
    o = observed(spark, sf_dir).where("left_out is null").select("segment", "months", "event", "o_orderkey")
    return rounded(survival.bootstrap_at(o, ["segment"], 2.0), "low", "high")


# --- exact tails and false discoveries ------------------------------------------------------------

TAIL = f"""{SEGMENTS}, pool AS (SELECT sum(k)::DOUBLE / sum(n) AS p0 FROM seg),
  x AS (SELECT nation, n, k, p0, unnest(range(k, n + 1)) AS i FROM seg, pool),
  tail AS (SELECT nation, least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p0) + (n - i) * ln(1 - p0)))) AS p FROM x GROUP BY nation)"""


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    pool = seg.agg((F.sum("k") / F.sum("n")).alias("p0"))
    return seg.join(F.broadcast(pool), F.lit(True)).select("nation", stats.binomial_tail("k", "n", "p0").alias("p"))  # one row


@query("f19_binomial_tail", f"{TAIL} SELECT nation, round(p, 6) AS p FROM tail")
def binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tails(spark, sf_dir), "p")


@query(
    "f23_false_discovery",
    f"""{TAIL}, r AS (SELECT nation, p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM (SELECT nation, round(p, 6) AS p FROM tail)),
    q AS (SELECT nation, p, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS bh, (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) FROM r) + 1) t(i)) AS c, min(p * m / r) OVER (ORDER BY r DESC) AS raw FROM r)
    SELECT nation, round(bh, 6) AS q_bh, round(least(1.0, raw * c), 6) AS q_by, round(least(1.0, raw * c), 6) <= 0.1 AS flagged FROM q""",
)
def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = rounded(survival.false_discovery(rounded(tails(spark, sf_dir), "p")), "q_bh", "q_by")
    return q.select("nation", "q_bh", "q_by", (F.col("q_by") <= 0.1).alias("flagged"))


@query("f24_correlation", "SELECT event_type, round(coalesce(corr(value, hour(ts)), 0.0), 6) AS r FROM events GROUP BY event_type")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(stats.pearson(F.col("value"), F.hour("ts").cast("double")).alias("r")), "r")


@query("f25_median", "SELECT event_type, round(coalesce(median(value), 0.0), 6) AS m FROM events GROUP BY event_type")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type with its exact median, 0 where no value is known."""
    e = table(spark, sf_dir, "events")
    found = ordered.medians(e, ["event_type"], "value").withColumnRenamed("event_type", "t")
    return e.select("event_type").distinct().join(found, F.col("event_type").eqNullSafe(F.col("t")), "left").select("event_type", F.round(F.coalesce("median", F.lit(0.0)), 6).alias("m"))


@query("f28_compatible_labels", "SELECT l_orderkey, l_linenumber, l_returnflag = l_linestatus OR (l_returnflag = 'A' AND l_linestatus = 'F') AS compatible FROM lineitem")
def compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array("l_returnflag"), F.when(F.col("l_linestatus") == "F", F.array(F.lit("F"), F.lit("A"))).otherwise(F.array("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.arrays_overlap(a, b).alias("compatible"))


@query("f29_agreement", "SELECT quality, toxic, count(*) AS n, count(*) FILTER (quality <> toxic) AS agreeing FROM labels GROUP BY ALL")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") != F.col("toxic")).alias("agreeing"))


@query("f30_interval_excludes_null", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount - l_tax / 2 > 0.02 OR l_discount + l_tax / 2 < 0.02 THEN true WHEN l_tax IS NULL THEN NULL ELSE false END AS decides FROM lineitem")
def interval_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.results import interval_excludes as excludes

    half = F.col("l_tax") / 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", excludes(F.col("l_discount") - half, F.col("l_discount") + half, F.lit(0.02)).alias("decides"))
