"""The record frame that the cohort queries share: one row per order, with its customer's place and
what its lines say. An order is closed when its status is F or O, an event when a line of it
was returned, and its programme is customer segment and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import table

    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.max("l_shipdate").cast("date").alias("last_ship"), F.count("*").alias("n_lines"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    customers = t("customer").join(places, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), "nation", "region")
    out = t("orders").withColumn("odate", F.to_date("o_orderdate")).drop("o_orderdate").join(customers, "o_custkey").join(lines, "o_orderkey", "left")
    return out.withColumns({"returned": F.coalesce("returned", F.lit(False)), "n_lines": F.coalesce("n_lines", F.lit(0).cast("long"))})


SQL = """rec AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS odate,
    c_mktsegment AS segment, n_name AS nation, r_name AS region, coalesce(returned, false) AS returned, last_ship, coalesce(n_lines, 0) AS n_lines
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, CAST(max(l_shipdate) AS DATE) AS last_ship, count(*) AS n_lines
             FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""


def closed() -> Column:
    return F.col("o_orderstatus").isin("F", "O")


def event() -> Column:
    return F.col("returned")
