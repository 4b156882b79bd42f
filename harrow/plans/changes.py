"""Families D1-D3 and I (snapshots), N (folds), P (checks), O (samples).

The two releases are derived from one table by a fixed edit: the previous release lacks ids that
end in 7, has ids of its own beyond the others, and differs in two fields for some ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, sampling, snapshots
from ..sources.scratch import written
from .registry import query, table

RELEASES = """cur AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_totalprice AS VARCHAR) AS version FROM orders WHERE o_orderkey % 11 <> 5),
prev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority, 'old' AS version FROM orders WHERE o_orderkey % 10 <> 7)"""
DIFF = f"""WITH {RELEASES}, d AS (
  SELECT coalesce(p.id, c.id) AS id, CASE WHEN p.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'removed' ELSE 'changed' END AS kind,
    CASE WHEN p.id IS NOT NULL AND c.id IS NOT NULL THEN (CASE WHEN p.status IS DISTINCT FROM c.status THEN ['status'] ELSE [] END) || (CASE WHEN p.priority IS DISTINCT FROM c.priority THEN ['priority'] ELSE [] END) ELSE [] END AS fields
  FROM prev p FULL OUTER JOIN cur c ON p.id = c.id)"""


def releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cur = o.where(k % 11 != 5).select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("string").alias("version"))
    prev = o.where(k % 10 != 7).select(k.alias("id"), F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 17 != 0, F.col("o_orderpriority")).alias("priority"), F.lit("old").alias("version"))
    return prev, cur


@query("d01_snapshot_diff", f"{DIFF} SELECT id, kind, array_to_string(fields, ',') AS fields FROM d WHERE kind <> 'changed' OR len(fields) > 0")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapshots.diff(*releases(spark, sf_dir), "id", ["status", "priority"])
    return d.select("id", "kind", F.array_join("changed_fields", ",").alias("fields"))


@query("d02_field_changes", f"WITH {RELEASES} SELECT p.id, p.status AS before_status, c.status AS after_status FROM prev p JOIN cur c ON p.id = c.id WHERE p.status IS DISTINCT FROM c.status")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapshots.diff(*releases(spark, sf_dir), "id", ["status", "priority"]).where(F.array_contains("changed_fields", "status"))
    return d.select("id", F.element_at("before", "status").alias("before_status"), F.element_at("after", "status").alias("after_status"))


@query("d03_change_origin", f"{DIFF} SELECT origin, count(*) AS n FROM (SELECT CASE WHEN list_contains(fields, 'status') AND list_contains(fields, 'priority') THEN 'mixed' WHEN list_contains(fields, 'status') THEN 'registry_event' WHEN list_contains(fields, 'priority') THEN 'reclassification' END AS origin FROM d WHERE kind = 'changed' AND len(fields) > 0) GROUP BY origin")
def change_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapshots.diff(*releases(spark, sf_dir), "id", ["status", "priority"]).where("kind = 'changed'")
    return d.groupBy(snapshots.origin(F.col("changed_fields"), ["status"], ["priority"], []).alias("origin")).agg(F.count("*").alias("n"))


@query("d04_override_merge", "SELECT c_custkey, CASE WHEN c_custkey % 25 = 0 THEN 'OVERRIDE' ELSE c_mktsegment END AS segment, c_custkey % 25 = 0 AS overridden FROM customer")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    overrides = c.where("c_custkey % 25 = 0").select("c_custkey", F.lit("OVERRIDE").alias("o"))
    return c.join(overrides, "c_custkey", "left").select("c_custkey", F.coalesce("o", "c_mktsegment").alias("segment"), F.col("o").isNotNull().alias("overridden"))


@query("d08_union_exclusions", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN (SELECT source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)) ")
def union_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    used = d.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select("source").distinct()
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").join(used, "source", "left_anti").select("doc_id")


@query("d09_exclusion_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'reviewed' WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'overlap' ELSE 'pool' END AS reason FROM documents) GROUP BY reason")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.trim("text") == "").alias("empty"))
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("reviewed")).distinct(), "doc_id", "left")
    d = d.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("overlap")).distinct(), "doc_id", "left")
    reason = F.when(F.col("empty"), "empty").when(F.col("reviewed"), "reviewed").when(F.col("overlap"), "overlap").otherwise("pool")
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


TWICE = "rows_ AS (SELECT c_custkey, c_acctbal, 1 AS pos FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, 2 FROM customer WHERE c_custkey % 3 = 0)"


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.withColumn("pos", F.lit(1)).union(c.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_acctbal") + 1, F.lit(2)))


@query("i01_last_wins", f"WITH {TWICE} SELECT c_custkey, c_acctbal, pos FROM rows_ QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pos DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.keep_one(twice(spark, sf_dir), "c_custkey", "pos")


@query("i02_first_wins", f"WITH {TWICE} SELECT c_custkey, c_acctbal, pos FROM rows_ QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pos) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.keep_one(twice(spark, sf_dir), "c_custkey", "pos", last=False)


@query("i04_set_operations", f"WITH {RELEASES} SELECT 'new' AS kind, count(*) AS n FROM (SELECT id FROM cur EXCEPT SELECT id FROM prev) UNION ALL SELECT 'removed', count(*) FROM (SELECT id FROM prev EXCEPT SELECT id FROM cur) UNION ALL SELECT 'shared', count(*) FROM (SELECT id FROM cur INTERSECT SELECT id FROM prev)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = releases(spark, sf_dir)
    both = prev.select("id", F.lit(1).alias("p")).join(cur.select("id", F.lit(1).alias("c")), "id", "full_outer")
    kind = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "removed").otherwise("shared")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("i05_set_equality", f"WITH {RELEASES} SELECT 'only_a' AS side, count(*) AS n FROM (SELECT id, status FROM prev EXCEPT ALL SELECT id, status FROM cur) UNION ALL SELECT 'only_b', count(*) FROM (SELECT id, status FROM cur EXCEPT ALL SELECT id, status FROM prev)")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = releases(spark, sf_dir)
    return snapshots.same_rows(prev.select("id", "status"), cur.select("id", "status"))


LOG = """log AS (SELECT user_id AS key, CAST(ts AS VARCHAR) AS release,
  CASE WHEN event_type = 'signup' THEN 'added' WHEN event_type = 'error' THEN 'removed' ELSE 'changed' END AS kind,
  CAST(event_id % 3 AS VARCHAR) AS before, CAST((event_id + 1) % 3 AS VARCHAR) AS after,
  ts || '#' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS placed FROM events)"""


@query(
    "n01_fold_changes",
    f"""WITH {LOG}, g AS (SELECT key, arg_min(kind, placed) AS fk, arg_max(kind, placed) AS lk, arg_min(before, placed) AS before, arg_max(after, placed) AS after FROM log GROUP BY key),
        k AS (SELECT *, CASE WHEN fk = 'added' AND lk = 'removed' THEN NULL WHEN fk = 'added' THEN 'added' WHEN lk = 'removed' THEN 'removed' WHEN before <> after THEN 'changed' END AS kind FROM g)
        SELECT key, kind, before, after FROM k WHERE kind IS NOT NULL""",
)
def fold_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("changed")
    at = F.struct("ts", "event_id")
    log = e.select(F.col("user_id").alias("key"), at.alias("release"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("before"), ((F.col("event_id") + 1) % 3).cast("string").alias("after"))
    return snapshots.fold_changes(log, "key", "release", "kind", "before", "after").drop("release")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of users: a release is a day."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("changed")
    return e.select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("before"), ((F.col("event_id") + 1) % 3).cast("string").alias("after"))


@query(
    "n02_fold_once",
    f"""WITH {LOG}, l AS (SELECT log.*, CAST(CAST(release AS TIMESTAMP) AS DATE) AS day FROM log), w AS (SELECT * FROM l WHERE day > DATE '2024-01-03'),
        g AS (SELECT key, arg_min(kind, placed) AS fk, arg_max(kind, placed) AS lk, arg_min(before, placed) AS before, arg_max(after, placed) AS after, max(day) AS release FROM w GROUP BY key),
        k AS (SELECT *, CASE WHEN fk = 'added' AND lk = 'removed' THEN NULL WHEN fk = 'added' THEN 'added' WHEN lk = 'removed' THEN 'removed' WHEN before <> after THEN 'changed' END AS kind FROM g)
        SELECT key, kind, before, after, release FROM k WHERE kind IS NOT NULL""",
)
def fold_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days arrive in three rounds, out of order, and each round brings days that came before, and days up to the mark
    that was told; each day after the mark is folded once."""
    log, mark = user_log(spark, sf_dir), F.lit("2024-01-03").cast("date")
    day = F.dayofmonth("day")
    rounds = [day % 3 == 1, (day % 3 == 0) | (day % 2 == 0), day % 5 > 0, F.lit(True)]
    ledger, folds = spark.createDataFrame([], "release date"), []
    for arrives in rounds:
        new = written(snapshots.unfolded(log.where(arrives), "day", ledger, mark))
        folds.append(snapshots.partial_fold(new, "key", "day", "kind", "before", "after", "at"))
        ledger = written(ledger.union(new.select("day").distinct()))
    return snapshots.settled_fold(snapshots.merged_folds(reduce(DataFrame.union, folds)))


@query("n09_metric_drops", "WITH a AS (SELECT avg((value > 50)::INT) AS share_high, count(*)::DOUBLE AS n FROM events WHERE event_id % 2 = 0), b AS (SELECT avg((value > 60)::INT) AS share_high, count(*)::DOUBLE AS n FROM events WHERE event_id % 2 = 1) SELECT 'share_high' AS metric, round(a.share_high, 6) AS before, round(b.share_high, 6) AS after FROM a, b WHERE a.share_high - b.share_high > 0.05 UNION ALL SELECT 'n', a.n, b.n FROM a, b WHERE (a.n - b.n) / a.n > 0.05")
def metric_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = lambda half, cut: e.where(F.col("event_id") % 2 == half).agg(F.avg((F.col("value") > cut).cast("int")).alias("share_high"), F.count("*").alias("n"))
    d = snapshots.drops(m(0, 50), m(1, 60), {"share_high": ("points", 0.05), "n": ("share", 0.05)})
    return d.withColumns({c: F.round(c, 6) for c in ("before", "after")})


@query("p01_key_violations", f"WITH {TWICE}, k AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_custkey::VARCHAR END AS k FROM rows_), g AS (SELECT nullif(trim(k), '') AS k, count(*) AS n FROM k GROUP BY ALL) SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS missing, coalesce(sum(n - 1) FILTER (k IS NOT NULL), 0)::BIGINT AS repeated FROM g")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.col("c_custkey").cast("string"))
    return checks.key_violations(twice(spark, sf_dir).select(k.alias("k")), "k")


@query("p02_disallowed_pairs", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) NOT IN (('A', 'F'), ('R', 'F'), ('N', 'O')) GROUP BY ALL")
def disallowed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("A", "F"), ("R", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return checks.disallowed(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], allowed)


@query("p04_drift", "SELECT a.doc_id, a.n_chars > 1000 AS before, a.n_chars > 1000 AND a.doc_id % 7 <> 0 AS after FROM documents a WHERE (a.n_chars > 1000) <> (a.n_chars > 1000 AND a.doc_id % 7 <> 0)")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), (F.col("n_chars") > 1000).alias("v"))
    out = checks.drift(d, d.withColumn("v", F.col("v") & (F.col("doc_id") % 7 != 0)), ["doc_id", "h"], ["v"])
    return out.select("doc_id", F.col("before.v").alias("before"), F.col("after.v").alias("after"))


@query("p06_rules", "SELECT unnest([{'rule': 'discount in range', 'n': count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.1))}, {'rule': 'price positive', 'n': count(*) FILTER (NOT (l_extendedprice > 0))}, {'rule': 'small quantity', 'n': count(*) FILTER (NOT (l_quantity < 45))}], recursive := true) FROM lineitem")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.violations(table(spark, sf_dir, "lineitem"), {"discount in range": F.col("l_discount").between(0, 0.1), "price positive": F.col("l_extendedprice") > 0, "small quantity": F.col("l_quantity") < 45})


@query("p05_unmatched_ids", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_right")
def unmatched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unmatched(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query("o01_stratified_sample", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s1:' || o_orderkey::VARCHAR), o_orderkey) <= 40")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 40).select("o_orderkey", "o_orderpriority")


@query("o02_quota_sample", "SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('s1:' || o_orderkey::VARCHAR), o_orderkey) <= CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 10 ELSE 0 END")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", {"F": 30, "O": 10}).select("o_orderkey", "o_orderstatus")


@query("o04_round_robin", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s1:' || o_orderkey::VARCHAR), o_orderkey) AS draw FROM orders) SELECT o_orderkey, o_orderpriority FROM r ORDER BY draw, o_orderpriority LIMIT 33")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 33).select("o_orderkey", "o_orderpriority")


@query(
    "f26_weighted_estimate",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s1:' || o_orderkey::VARCHAR), o_orderkey) AS draw FROM orders), d AS (SELECT * FROM s WHERE draw <= 40),
       w AS (SELECT a.o_orderpriority, pop::DOUBLE / drawn AS w FROM (SELECT o_orderpriority, count(*) AS pop FROM orders GROUP BY 1) a JOIN (SELECT o_orderpriority, count(*) AS drawn FROM d GROUP BY 1) b USING (o_orderpriority))
       SELECT o_orderstatus, round(sum(CASE WHEN o_totalprice > 100000 THEN w ELSE 0 END) / sum(w), 6) AS estimate, count(*) AS n FROM d JOIN w USING (o_orderpriority) GROUP BY o_orderstatus""",
)
def weighted_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = sampling.population_weights(sampling.stratified(o, "o_orderpriority", "o_orderkey", 40), o, "o_orderpriority")
    out = sampling.weighted_ratio(s, ["o_orderstatus"], "weight", F.col("o_totalprice") > 100000)
    return out.withColumn("estimate", F.round("estimate", 6))


@query("h07_budget_prefix", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey FROM r WHERE n * 0.02 + ceil(n / 40.0) * 0.5 <= 7.0")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.within_budget(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 0.02, 0.5, 40, 7.0).select("o_orderkey")
