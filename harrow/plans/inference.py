"""Families F and G on large families of tests: incomplete beta, tails, step-down, stratified bootstrap, and variances by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import resampling, survival
from .records import closed, event, records
from .registry import query, table
from .statistics import BETA, CURVE, ERF, SEGMENTS, observed, posterior, rounded, segments


@query("f06_error_function", f"WITH v AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 12 AS x FROM lineitem), e AS (SELECT *, 1 / (1 + 0.3275911 * abs(x)) AS t FROM v) SELECT l_orderkey, l_linenumber, round({ERF.format(x='x', t='t')}, 6) AS erf FROM e")
def error_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_quantity") - 25) / 12
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(stats.erf(x), 6).alias("erf"))


#: Per nation the posterior's shape (k + 1, n - k + 1) and the pooled rate; I_x of whole numbers is a binomial tail.
SHAPE = f"""{SEGMENTS}, s AS (SELECT nation, k + 1 AS a, n - k + 1 AS b, (SELECT sum(k)::DOUBLE / sum(n) FROM seg) AS x FROM seg),
  i AS (SELECT nation, a, b, x, sum(exp(lgamma(a + b) - lgamma(i + 1) - lgamma(a + b - i) + i * ln(x) + (a + b - 1 - i) * ln(1 - x))) AS ix
        FROM (SELECT *, unnest(range(a, a + b)) AS i FROM s) GROUP BY ALL)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    pool = seg.agg((F.sum("k") / F.sum("n")).alias("x"))
    return seg.join(F.broadcast(pool), F.lit(True)).select("nation", (F.col("k") + 1).alias("a"), (F.col("n") - F.col("k") + 1).alias("b"), "x")  # one row


@query("f17_continued_fraction", f"{SHAPE} SELECT nation, CASE WHEN x < (a + 1)::DOUBLE / (a + b + 2) THEN round(ix * a / exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)), 5) END AS value FROM i")
def continued_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("nation", F.round(stats.beta_fraction("a", "b", "x"), 5).alias("value"))


@query("f18_incomplete_beta", f"{SHAPE} SELECT nation, round(ix, 6) AS below, round(1 - ix, 6) AS above FROM i")
def incomplete_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely a nation's rate is below the pooled one, and above it (by the mirrored function)."""
    below, above = stats.incomplete_beta("a", "b", "x"), stats.incomplete_beta("b", "a", 1 - F.col("x"))
    return rounded(shapes(spark, sf_dir).select("nation", below.alias("below"), above.alias("above")), "below", "above")


@query(
    "f20_large_family",
    """WITH s AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), p0 AS (SELECT sum(k)::DOUBLE / sum(n) AS p0 FROM s),
    t AS (SELECT l_partkey, round(least(1.0, sum(CASE WHEN k = 0 THEN NULL ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p0) + (n - i) * ln(1 - p0)) END)), 6) AS p
          FROM (SELECT *, unnest(range(k, n + 1)) AS i FROM s, p0) GROUP BY 1),
    c AS (SELECT l_partkey, coalesce(p, 1.0) AS p FROM t), r AS (SELECT p, count(*) AS n FROM c GROUP BY 1), m AS (SELECT p, p * (SELECT count(*) FROM c) / sum(n) OVER (ORDER BY p) AS raw FROM r),
    q AS (SELECT p, least(1.0, min(raw) OVER (ORDER BY p DESC)) AS q FROM m)
    SELECT l_partkey, p, round(q, 5) AS q FROM c JOIN q USING (p)""",
)
def large_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test for each part: exact tail against the pooled share, and its q over the whole family, by ranges of p."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    pool = parts.agg((F.sum("k") / F.sum("n")).alias("p0"))
    tests = parts.join(F.broadcast(pool), F.lit(True)).select("l_partkey", F.round(stats.binomial_tail("k", "n", "p0"), 6).alias("p"))  # one row
    return rounded(survival.false_discovery(tests), "q_bh", digits=5).select("l_partkey", "p", F.col("q_bh").alias("q"))


@query("f32_beta_interval_with_deviation", f"{BETA} SELECT nation, round(mean, 6) AS mean, round(greatest(0.0, mean - 1.645 * sd), 6) AS low, round(least(1.0, mean + 1.645 * sd), 6) AS high, round(sd, 6) AS sd FROM m")
def beta_interval_with_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, low, high, sd = stats.beta_mean(F.col("al"), F.col("be"))
    return rounded(posterior(spark, sf_dir).select("nation", mean.alias("mean"), low.alias("low"), high.alias("high"), sd.alias("sd")), "mean", "low", "high", "sd")


@query("f27_stratified_bootstrap")
def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of "closed" for "returned", weighted by lines, with intervals from 2,000 replicates that keep
    the size of each priority. Draws are random: tests hold it against plain numpy."""
    rows = records(spark, sf_dir).withColumns({"c": closed(), "e": event()})
    c, e, every = F.col("c"), F.col("e"), F.lit(True)
    pairs = resampling.weighted_pairs([("precision", e, c), ("recall", c, e), ("share", e, every)], F.col("n_lines"))
    return rounded(resampling.bootstrap_ratios(rows, "o_orderpriority", pairs), "estimate", "low", "high")


@query(
    "g03_variance_sums",
    f"""{CURVE}, x AS (SELECT s.segment, s.t, at_risk AS n, s.d1, s.d1 + s.d2 AS d, sb, cif FROM s JOIN c ON c.segment = s.segment AND c.t = s.t),
    y AS (SELECT *, CASE WHEN n > d THEN d::DOUBLE / (n * (n - d)) ELSE 0 END AS a, sb * sb * ((n - d1)::DOUBLE / n) * (d1::DOUBLE / n / n) AS b, sb * d1 / n / n AS c FROM x)
    SELECT segment, t, n AS at_risk, round(cif, 6) AS cif, round(greatest(0.0, cif * cif * sum(a) OVER w - 2 * cif * sum(cif * a) OVER w + sum(cif * cif * a) OVER w + sum(b) OVER w - 2 * cif * sum(c) OVER w + 2 * sum(cif * c) OVER w), 8) AS variance
    FROM y WINDOW w AS (PARTITION BY segment ORDER BY t)""",
)
def variance_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidence and its variance by ranges of time: no segment is one task."""
    curve = survival.variance_by_ranges(observed(spark, sf_dir).where("left_out is null"), ["segment"])
    return curve.select("segment", "t", "at_risk", F.round("cif", 6).alias("cif"), F.round("variance", 8).alias("variance"))
