"""Families C (filters), E (aggregates), G (windows), H (order and limit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cohort
from .records import SQL as REC
from .records import closed, event, records
from .registry import query, table

WILSON = """CASE WHEN {n} > 0 THEN round(greatest(0.0, ({k}::DOUBLE / {n} + 1.96 * 1.96 / (2.0 * {n}) - 1.96 * sqrt(({k}::DOUBLE / {n}) * (1 - {k}::DOUBLE / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})), 6) END AS low,
  CASE WHEN {n} > 0 THEN round(least(1.0, ({k}::DOUBLE / {n} + 1.96 * 1.96 / (2.0 * {n}) + 1.96 * sqrt(({k}::DOUBLE / {n}) * (1 - {k}::DOUBLE / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})), 6) END AS high"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("c03_cohort_select", f"WITH {REC} SELECT o_orderkey, segment, nation, n_lines FROM rec WHERE o_orderstatus IN ('F', 'O') AND region = 'EUROPE' AND segment IN ('BUILDING', 'MACHINERY') AND year(odate) BETWEEN 1996 AND 1999")
def cohort_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cohort.select_cohort(records(spark, sf_dir), equals={"region": "EUROPE"}, any_of={"o_orderstatus": ["F", "O"], "segment": ["BUILDING", "MACHINERY"]}, years=("odate", 1996, 1999))
    return found.select("o_orderkey", "segment", "nation", "n_lines")


@query("c03_overlap_exclude", "SELECT p_partkey, p_name FROM part WHERE len(list_intersect(string_split(p_name, ' '), string_split((SELECT min(p_name) FROM part), ' '))) > 0 AND NOT list_contains(string_split(p_name, ' '), 'zzz')")
def overlap_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = part.agg(F.split(F.min("p_name"), " ").alias("wanted"))
    tokens = part.withColumn("tokens", F.split("p_name", " ")).join(F.broadcast(words), F.lit(True))  # one row
    return cohort.select_cohort(tokens.where(F.arrays_overlap("tokens", "wanted")), has_none={"tokens": ["zzz"]}).select("p_partkey", "p_name")


@query("c04_event_predicate", f"WITH {REC} SELECT o_orderkey, (o_orderstatus = 'F' AND returned) OR (o_orderstatus = 'O' AND returned AND o_orderpriority = '1-URGENT') AS is_event FROM rec")
def event_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = ((F.col("o_orderstatus") == "F") & event()) | ((F.col("o_orderstatus") == "O") & event() & (F.col("o_orderpriority") == "1-URGENT"))
    return records(spark, sf_dir).select("o_orderkey", hit.alias("is_event"))


@query("c06_faceted_search", f"WITH {REC} SELECT o_orderkey, nation, segment FROM rec WHERE (contains(lower(nation), 'ma') OR contains(lower(segment), 'ma')) AND o_orderstatus IN ('F', 'P') AND strftime(odate, '%Y-%m-%d') >= '1996-03-01' AND strftime(odate, '%Y-%m-%d') <= '1998-06-30'")
def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("day", F.date_format("odate", "yyyy-MM-dd"))
    return cohort.faceted(rows, "MA", ["nation", "segment"], {"o_orderstatus": ["F", "P"]}, ("day", "1996-03-01", "1998-06-30")).select("o_orderkey", "nation", "segment")


@query("c18_whole_entity_match", "SELECT event_id, event_type FROM events WHERE list_contains(string_split(event_type || '; ' || lower(event_type) || 's', '; '), 'clicks')")
def whole_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("names", text.list_of(F.concat("event_type", F.lit("; "), F.lower("event_type"), F.lit("s"))))
    return e.where(F.array_contains("names", "clicks")).select("event_id", "event_type")


@query("e01_top_values", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return cohort.top_counts(c, "n_name", 10)


@query("e02_facet_counts", f"WITH {REC} SELECT 'segment' AS facet, segment AS value, count(*) AS n FROM rec GROUP BY ALL UNION ALL SELECT 'region', region, count(*) FROM rec GROUP BY ALL UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM rec GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM rec GROUP BY ALL")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.facet_counts(records(spark, sf_dir), ["segment", "region", "o_orderstatus", "o_orderpriority"])


@query(
    "e03_scope_cube",
    """WITH r AS (SELECT l_shipdate, CASE WHEN year(l_shipdate) < 1998 THEN 'early' ELSE 'late' END AS scope, l_linestatus AS grp, l_returnflag AS bucket,
         CASE WHEN l_discount >= 0.05 THEN ['discount', 'all'] ELSE ['all'] END || CASE WHEN l_quantity > 40 THEN ['bulk'] ELSE [] END AS ks FROM lineitem)
       SELECT scope, key, grp, count(*) AS n, count(*) FILTER (bucket = 'A') AS A, count(*) FILTER (bucket = 'N') AS N_, count(*) FILTER (bucket = 'R') AS R
       FROM (SELECT scope, grp, bucket, unnest(ks) AS key FROM r) GROUP BY scope, key, grp""",
)
def scope_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = F.array_compact(F.array(F.when(F.col("l_discount") >= 0.05, F.lit("discount")), F.when(F.col("l_quantity") > 40, F.lit("bulk"))))
    scope = F.when(F.year("l_shipdate") < 1998, "early").otherwise("late")
    out = cohort.cube_counts(li.withColumn("bucket", F.when(F.col("l_returnflag") == "N", "N_").otherwise(F.col("l_returnflag"))), scope, "l_linestatus", keys, "bucket", ["A", "N_", "R"])
    return out


@query("e04_dense_matrix", f"WITH {REC} SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P, count(*) FILTER (o_orderstatus = 'X') AS n_X FROM rec GROUP BY o_orderpriority")
def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.dense_matrix(records(spark, sf_dir), "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])


@query("e06_profile", f"WITH {REC}, c AS (SELECT nation, segment, count(*) AS n FROM rec GROUP BY ALL) SELECT nation, segment, n, row_number() OVER (PARTITION BY nation ORDER BY n DESC, segment) AS position FROM c QUALIFY position <= 3")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.top_counts(records(spark, sf_dir), "segment", 3, within=["nation"]).withColumn("position", F.col("position").cast("long"))


@query("e07_share_table", f"WITH {REC} SELECT nation AS key, count(*) AS total, count(*) FILTER (returned) AS hits, round(count(*) FILTER (returned)::DOUBLE / count(*), 6) AS share FROM rec GROUP BY nation HAVING count(*) >= 100")
def share_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cohort.share_table(records(spark, sf_dir), "nation", event(), 100), "share")


@query(
    "e08_segment_rates",
    f"""WITH {REC}, g AS (SELECT region, segment, count(*) AS n, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS closed, count(*) FILTER (o_orderstatus IN ('F', 'O') AND returned) AS events
        FROM rec WHERE year(odate) BETWEEN 1995 AND 2000 GROUP BY ALL)
        SELECT region, segment, n, closed, events, round(events::DOUBLE / nullif(closed, 0), 6) AS rate, {WILSON.format(k="events", n="closed")} FROM g WHERE closed >= 10""",
)
def segment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = cohort.select_cohort(records(spark, sf_dir), years=("odate", 1995, 2000))
    out = cohort.segment_rates(chosen, ["region", "segment"], closed(), event(), 10)
    return rounded(out, "rate", "low", "high").orderBy(F.desc("rate"), "region", "segment")


@query(
    "e09_concentration",
    f"""WITH {REC}, p AS (SELECT nation, segment, o_orderpriority, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS c, count(*) FILTER (o_orderstatus IN ('F', 'O') AND returned) AS e FROM rec GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY e DESC, c DESC, segment || '|' || o_orderpriority) AS rn FROM p)
        SELECT nation, count(*) FILTER (e > 0) AS programmes, sum(e)::BIGINT AS events, sum(c)::BIGINT AS closed, max(CASE WHEN rn = 1 THEN segment || '|' || o_orderpriority END) AS largest,
          max(CASE WHEN rn = 1 THEN e END) AS largest_events, round((sum(e) - max(CASE WHEN rn = 1 THEN e END))::DOUBLE / nullif(sum(c) - max(CASE WHEN rn = 1 THEN c END), 0), 6) AS rate_without
        FROM r GROUP BY nation""",
)
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cohort.concentration(records(spark, sf_dir), ["nation"], ["segment", "o_orderpriority"], closed(), event()), "rate_without")


@query(
    "e11_dimension_tables",
    f"""WITH {REC}, d AS (SELECT unnest([{{'dim': 'segment', 'value': segment}}, {{'dim': 'region', 'value': region}}, {{'dim': 'year', 'value': year(odate)::VARCHAR}}]) AS x, o_orderstatus, returned FROM rec),
        g AS (SELECT x.dim AS dimension, x.value AS value, count(*) AS n, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS closed, count(*) FILTER (o_orderstatus IN ('F', 'O') AND returned) AS events FROM d GROUP BY ALL)
        SELECT *, round(events::DOUBLE / nullif(closed, 0), 6) AS rate, {WILSON.format(k="events", n="closed")} FROM g WHERE closed >= 10""",
)
def dimension_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in (("segment", F.col("segment")), ("region", F.col("region")), ("year", F.year("odate")))]))
    rows = records(spark, sf_dir).select(dims.alias("d"), "o_orderstatus", "returned").select("d.*", "o_orderstatus", "returned")
    return rounded(cohort.segment_rates(rows, ["dimension", "value"], closed(), event(), 10), "rate", "low", "high")


@query(
    "e13_funnel",
    f"""WITH {REC}, s AS (SELECT o_orderstatus IN ('F', 'O') AS a, n_lines > 0 AS b, year(odate) >= 1997 AS c, returned AS d FROM rec)
        SELECT unnest([{{'position': 0, 'step': 'closed', 'n': count(*) FILTER (a)}}, {{'position': 1, 'step': 'with lines', 'n': count(*) FILTER (a AND b)}}, {{'position': 2, 'step': 'from 1997', 'n': count(*) FILTER (a AND b AND c)}}, {{'position': 3, 'step': 'returned', 'n': count(*) FILTER (a AND b AND c AND d)}}], recursive := true) FROM s""",
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.funnel(records(spark, sf_dir), [("closed", closed()), ("with lines", F.col("n_lines") > 0), ("from 1997", F.year("odate") >= 1997), ("returned", event())])


@query("e14_share_by_key", f"WITH {REC} SELECT o_orderpriority, year(odate) AS yr, count(*) AS n, round(avg((n_lines = 0)::INT), 6) AS unread FROM rec GROUP BY ALL HAVING count(*) >= 30")
def share_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = records(spark, sf_dir).groupBy("o_orderpriority", F.year("odate").alias("yr")).agg(F.count("*").alias("n"), F.avg((F.col("n_lines") == 0).cast("int")).alias("unread"))
    return rounded(g.where("n >= 30"), "unread").withColumn("yr", F.col("yr").cast("long"))


@query("e15_grouping_sets", f"WITH {REC} SELECT region, o_orderstatus, count(*) AS n, round(avg(returned::INT), 6) AS share, grouping(region, o_orderstatus)::BIGINT AS level FROM rec GROUP BY GROUPING SETS ((region), (o_orderstatus), (region, o_orderstatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    g = r.groupingSets([["region"], ["o_orderstatus"], ["region", "o_orderstatus"], []], "region", "o_orderstatus").agg(F.count("*").alias("n"), F.avg(F.col("returned").cast("int")).alias("share"), F.grouping_id().alias("level"))
    return rounded(g, "share")


@query("e16_ratio_order", f"WITH {REC} SELECT nation, count(*) AS total, count(*) FILTER (returned) AS hits FROM rec GROUP BY nation HAVING count(*) >= 200 ORDER BY hits::DOUBLE / total DESC, nation LIMIT 5")
def ratio_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cohort.share_table(records(spark, sf_dir), "nation", event(), 200)
    return s.orderBy(F.desc("share"), "key").limit(5).select(F.col("key").alias("nation"), "total", "hits")


@query("e19_lag_distribution", f"WITH {REC}, l AS (SELECT o_orderstatus, datediff('day', odate, last_ship) / 365.25 AS lag FROM rec WHERE last_ship IS NOT NULL) SELECT o_orderstatus, count(*) AS n, round(median(lag), 6) AS median_years, count(*) FILTER (lag >= 1) AS over_one, count(*) FILTER (lag < 0) AS negative FROM l GROUP BY o_orderstatus")
def lag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).where("last_ship is not null").withColumn("lag", F.datediff("last_ship", "odate") / F.lit(365.25))
    # days are few distinct values, so the exact percentile holds one counter per day, not rows
    g = r.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.percentile("lag", F.lit(0.5)).alias("median_years"), F.count_if(F.col("lag") >= 1).alias("over_one"), F.count_if(F.col("lag") < 0).alias("negative"))
    return rounded(g, "median_years")


@query("e21_bands", f"WITH {REC} SELECT CASE WHEN n_lines = 0 THEN 'missing' WHEN n_lines = 1 THEN 'single' WHEN n_lines <= 4 THEN '2-4' ELSE '5+' END AS band, segment, count(*) AS n, count(*) FILTER (returned) AS hits FROM rec GROUP BY ALL HAVING count(*) >= 30")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_lines")
    band = F.when(n == 0, "missing").when(n == 1, "single").when(n <= 4, "2-4").otherwise("5+")
    return records(spark, sf_dir).groupBy(band.alias("band"), "segment").agg(F.count("*").alias("n"), F.count_if(event()).alias("hits")).where("n >= 30")


@query("e22_guarded_ratio", f"WITH {REC} SELECT nation, count(*) FILTER (o_orderstatus = 'P') AS open, count(*) FILTER (returned) AS hits, round(count(*) FILTER (o_orderstatus = 'P')::DOUBLE / greatest(1, count(*) FILTER (returned)), 6) AS ratio FROM rec GROUP BY nation")
def guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = records(spark, sf_dir).groupBy("nation").agg(F.count_if(F.col("o_orderstatus") == "P").alias("open"), F.count_if(event()).alias("hits"))
    return g.withColumn("ratio", F.round(F.col("open") / F.greatest(F.lit(1), F.col("hits")), 6))


@query(
    "e23_observed_expected",
    f"""WITH {REC}, cells AS (SELECT nation, segment, o_orderpriority, count(*) AS n, count(*) FILTER (returned) AS k FROM rec GROUP BY ALL),
        p AS (SELECT segment, o_orderpriority, sum(k)::DOUBLE / sum(n) AS p FROM cells GROUP BY ALL)
        SELECT nation, sum(n)::BIGINT AS total, sum(k)::BIGINT AS observed, round(sum(n * p), 6) AS expected, round(sum(k)::DOUBLE / nullif(sum(n * p), 0), 6) AS ratio
        FROM cells JOIN p USING (segment, o_orderpriority) GROUP BY nation HAVING sum(n) >= 100""",
)
def observed_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cohort.observed_expected(records(spark, sf_dir), "nation", ["segment", "o_orderpriority"], event(), 100), "expected", "ratio")


@query("e30_top_with_ties", "WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (ORDER BY n DESC) AS rk FROM c) SELECT l_suppkey, n FROM r WHERE rk <= 15")
def top_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.top_with_ties(table(spark, sf_dir, "lineitem"), "l_suppkey", 15)


@query("e32_top_items_per_area", "WITH w AS (SELECT p_brand, unnest(string_split(p_name, ' ')[1:3]) AS word FROM part), c AS (SELECT p_brand, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2) SELECT p_brand, word, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, word) AS position FROM c QUALIFY position <= 10")
def top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select("p_brand", F.explode(F.slice(F.split("p_name", " "), 1, 3)).alias("word"))
    top = cohort.top_counts(w, "word", 10, within=["p_brand"]).where("n >= 2")
    return top.withColumn("position", F.col("position").cast("long"))


@query("e41_text_groups", "WITH h AS (SELECT doc_id, source, substring(sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))), 1, 20) AS h FROM documents), g AS (SELECT h, count(*) AS n, count(DISTINCT source) AS sources FROM h GROUP BY h HAVING count(*) > 1) SELECT doc_id, h, n, sources FROM h JOIN g USING (h)")
def text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of equal texts as a membership table: each document of a group with the group's counts. No list is gathered."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", text.short_hash(text.normalized(F.col("text"))).alias("h"))
    groups = d.groupBy("h", "source").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.count("source").alias("sources")).where("n > 1")
    return d.join(groups, "h").select("doc_id", "h", "n", "sources")


@query("e42_agreeing_groups", "WITH g AS (SELECT event_type, user_id, count(*) AS n, count(DISTINCT value > 50) AS kinds, bool_or(value > 99) AS blocked FROM events GROUP BY ALL) SELECT event_type, count(*) AS groups, count(*) FILTER (kinds = 1 AND NOT blocked) AS agreeing, count(*) FILTER (kinds > 1) AS conflicting FROM g GROUP BY event_type")
def agreeing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an exact distinct count of a two-valued column is min and max of it
    g = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min(F.col("value") > 50).alias("a"), F.max(F.col("value") > 50).alias("b"), F.bool_or(F.col("value") > 99).alias("blocked"))
    same = F.col("a") == F.col("b")
    return g.groupBy("event_type").agg(F.count("*").alias("groups"), F.count_if(same & ~F.col("blocked")).alias("agreeing"), F.count_if(~same).alias("conflicting"))


@query("e44_confusion", "SELECT CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted, quality AS expected, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("predicted"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("expected")), "doc_id").groupBy("predicted", "expected").agg(F.count("*").alias("n"))


@query("e49_area_comparison", f"WITH {REC}, o AS (SELECT avg(returned::INT) AS a, avg((n_lines = 0)::INT) AS b, count(*) AS n FROM rec), g AS (SELECT region, avg(returned::INT) AS a, avg((n_lines = 0)::INT) AS b FROM rec GROUP BY region) SELECT region, round(abs(ln(greatest(g.a / nullif(o.a, 0), 1e-6))), 6) AS returned_gap, round(abs(ln(greatest(g.b / nullif(o.b, 0), 1e-6))), 6) AS empty_gap FROM g, o")
def area_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    sums = [F.avg(F.col("returned").cast("int")).alias("a"), F.avg((F.col("n_lines") == 0).cast("int")).alias("b")]
    overall = r.agg(*sums).withColumnsRenamed({"a": "oa", "b": "ob"})
    gap = lambda x, y: F.round(F.abs(F.log(F.greatest(F.try_divide(x, y), F.lit(1e-6)))), 6)
    return r.groupBy("region").agg(*sums).join(F.broadcast(overall), F.lit(True)).select("region", gap(F.col("a"), F.col("oa")).alias("returned_gap"), gap(F.col("b"), F.col("ob")).alias("empty_gap"))


@query("e50_release_facts", f"WITH {REC} SELECT o_orderstatus, count(*) AS n, count(DISTINCT nation) AS nations, min(year(odate)) AS first_year, max(year(odate)) AS last_year FROM rec GROUP BY ALL")
def release_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = records(spark, sf_dir).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("nation").alias("nations"), F.min(F.year("odate")).alias("first_year"), F.max(F.year("odate")).alias("last_year"))
    return g.withColumns({c: F.col(c).cast("long") for c in ("first_year", "last_year")})


@query("e65_display_name", "WITH v AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS v FROM events), c AS (SELECT user_id, v, count(*) AS n FROM v GROUP BY ALL) SELECT user_id, v, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) = 1")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("v"))
    return cohort.mode(v, ["user_id"], "v")


@query("g05_trailing_days", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 14")
def trailing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.trailing_days(table(spark, sf_dir, "events"), "ts", 14).select("event_id", "event_type")


@query("g06_best_example", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id) = 1")
def best_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    order = [(F.col("event_type") != "purchase").cast("int"), -F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")]
    return cohort.best_example(e, "user_id", order).select("user_id", "event_id", "event_type")


@query("h01_stable_sort_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice")


@query("h05_suggestions", "WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) SELECT term, starts_with(term, 'a') AS is_prefix FROM t WHERE contains(term, 'a') ORDER BY is_prefix DESC, term LIMIT 8")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct().where(F.col("term").contains("a"))
    return t.withColumn("is_prefix", F.col("term").startswith("a")).orderBy(F.desc("is_prefix"), "term").limit(8)
