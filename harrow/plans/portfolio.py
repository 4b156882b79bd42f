"""More of families C, D, E, G, H, I and N: reports over the record frame, pages and batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import classify, cohort, portfolio
from .records import SQL as REC
from .records import closed, event, records
from .registry import query, table

BIO = "(o_orderstatus = 'F' AND returned)"


def bio():
    return (F.col("o_orderstatus") == "F") & event()


@query("c01_normalised_equality", "SELECT o_orderkey FROM orders WHERE lower(trim(' ' || o_orderpriority || ' ')) = '1-urgent'")
def normalised_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.lower(F.trim(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))) == "1-urgent").select("o_orderkey")


@query("c05_multi_label_areas", "SELECT c_custkey, trim(unnest(string_split(replace(c_mktsegment || '; other, ' || c_nationkey, ';', ','), ','))) AS area FROM customer")
def multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = F.split(F.concat("c_mktsegment", F.lit("; other, "), F.col("c_nationkey").cast("string")), "[;,]")
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(areas).alias("area")).withColumn("area", F.trim("area"))


@query("c07_resolved_signal", f"WITH {REC} SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN {BIO} ELSE o_totalprice > 300000 END AS signal FROM rec")
def resolved_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", bio()).otherwise(F.col("o_totalprice") > 300000)
    return records(spark, sf_dir).select("o_orderkey", signal.alias("signal"))


@query("c10_indexable", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderpriority IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey").where("c_acctbal > 0 and o_orderpriority is not null")
    return o.join(c.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey")


@query("c15_unreadable", f"WITH {REC} SELECT nation, count(*) AS n FROM rec WHERE o_orderstatus = 'F' AND last_ship IS NULL GROUP BY nation")
def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("o_orderstatus = 'F' and last_ship is null").groupBy("nation").agg(F.count("*").alias("n"))


@query("c21_covered_reason", "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'blue']) OR p_type LIKE 'PROMO%' AS covered FROM part")
def covered_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = cohort.overlaps(F.split("p_name", " "), ["red", "blue"]) | F.startswith("p_type", F.lit("PROMO"))
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("covered"))


@query("d12_ranked_match", "WITH s AS (SELECT p_partkey, p_brand, p_size FROM part), t AS (SELECT p_brand, p_size FROM part WHERE p_partkey = 1) SELECT p_partkey, CASE WHEN s.p_brand = t.p_brand AND s.p_size = t.p_size THEN 1 WHEN s.p_brand = t.p_brand THEN 2 WHEN s.p_size = t.p_size THEN 3 ELSE 4 END AS relation FROM s, t")
def ranked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    one = part.where("p_partkey = 1").select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"))
    both = part.join(F.broadcast(one), F.lit(True))  # one subject
    same_b, same_s = F.col("p_brand") == F.col("b"), F.col("p_size") == F.col("s")
    return both.select("p_partkey", F.when(same_b & same_s, 1).when(same_b, 2).when(same_s, 3).otherwise(4).alias("relation"))


@query("d19_class_coverage", "WITH cl AS (SELECT DISTINCT p_brand AS class, string_split(p_name, ' ')[1] AS item FROM part), r AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS item, p_size > 25 AS hit FROM part), j AS (SELECT class, p_partkey, bool_or(hit) AS hit FROM r JOIN cl USING (item) GROUP BY ALL) SELECT class, count(*) AS n, count(*) FILTER (hit) AS hits FROM j GROUP BY class")
def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    classes = part.select(F.col("p_brand").alias("class"), F.get(F.split("p_name", " "), 0).alias("item")).distinct()
    return portfolio.coverage(part, classes, "p_partkey", F.split("p_name", " "), F.col("p_size") > 25)


@query("d21_verdict_by_outcome", "SELECT quality, toxic, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def verdict_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


@query("d25_slug_collisions", "WITH s AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, count(DISTINCT p_name) AS names, count(*) AS n FROM part GROUP BY 1) SELECT slug, n FROM s WHERE n > 1")
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(text.slug(F.col("p_name")).alias("slug")).agg(F.count("*").alias("n")).where("n > 1")


@query("e10_programmes", f"WITH {REC} SELECT segment || '|' || coalesce(nullif(CASE WHEN n_lines > 0 THEN nation ELSE '' END, ''), 'unresolved:' || o_orderkey) AS programme, count(*) AS n FROM rec GROUP BY 1")
def programmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.nullif(F.when(F.col("n_lines") > 0, F.col("nation")).otherwise(""), F.lit(""))
    key = F.concat("segment", F.lit("|"), F.coalesce(known, F.concat(F.lit("unresolved:"), F.col("o_orderkey").cast("string"))))
    return records(spark, sf_dir).groupBy(key.alias("programme")).agg(F.count("*").alias("n"))


@query("e17_membership_by_hit", f"WITH w AS (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS member, p_size > 25 AS large, p_retailprice > 1500 AS dear FROM part) SELECT member, count(*) AS total, count(*) FILTER (large) AS large, count(*) FILTER (dear) AS dear FROM w GROUP BY member")
def membership_by_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.membership_counts(table(spark, sf_dir, "part"), F.split("p_type", " "), {"large": F.col("p_size") > 25, "dear": F.col("p_retailprice") > 1500})


@query("e18_tops_within", f"WITH {REC}, c AS (SELECT segment, nation, count(*) AS n FROM rec WHERE {BIO} GROUP BY ALL) SELECT segment, nation, n FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, nation) <= 3")
def tops_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.top_counts(records(spark, sf_dir).where(bio()), "nation", 3, within=["segment"]).select("segment", "nation", "n")


@query("e20_encoded_and_members", "SELECT array_to_string(list_sort(string_split(p_type, ' ')), '|') AS encoded, count(*) AS n FROM part GROUP BY 1")
def encoded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.array_join(F.sort_array(F.split("p_type", " ")), "|").alias("encoded")).agg(F.count("*").alias("n"))


@query("e25_plain_groups", f"WITH {REC} SELECT CASE WHEN {BIO} THEN 'failed' WHEN o_orderstatus = 'F' THEN 'ended' WHEN o_orderstatus = 'P' THEN 'open' ELSE 'other' END AS grp, count(*) AS n FROM rec GROUP BY 1")
def plain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = classify.decide([(bio(), F.lit("failed")), (F.col("o_orderstatus") == "F", F.lit("ended")), (F.col("o_orderstatus") == "P", F.lit("open"))], F.lit("other"))
    return records(spark, sf_dir).groupBy(group.alias("grp")).agg(F.count("*").alias("n"))


@query("e27_dictionary_encoding", f"WITH {REC} SELECT o_orderkey, (dense_rank() OVER (ORDER BY nation) - 1)::BIGINT AS code FROM rec")
def dictionary_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes come from the distinct values (few), ranked and joined back - not from a window over all rows."""
    from pyspark.sql import Window

    r = records(spark, sf_dir)
    codes = r.select("nation").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("nation")) - 1).cast("long"))
    return r.join(codes, "nation").select("o_orderkey", "code")


@query("e28_unit_profile", f"WITH {REC} SELECT nation, count(*) AS total, count(*) FILTER ({BIO}) AS failed, count(*) FILTER (o_orderstatus = 'P') AS open, round(count(*) FILTER ({BIO}) / count(*), 6) AS share, max(odate) AS latest FROM rec GROUP BY nation")
def unit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    p = portfolio.profile(r, "nation", {"failed": bio(), "open": F.col("o_orderstatus") == "P"})
    return p.withColumn("share", F.round("share", 6)).join(r.groupBy("nation").agg(F.max("odate").alias("latest")), "nation")


@query("e29_hubs", "WITH h AS (SELECT 'brand' AS kind, p_brand AS label, 3 AS least FROM part UNION ALL SELECT 'type', p_type, 5 FROM part), c AS (SELECT kind, label, count(*) AS n FROM h GROUP BY kind, label, least HAVING count(*) >= least), s AS (SELECT *, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM c) SELECT kind, label, slug, n FROM s QUALIFY row_number() OVER (PARTITION BY kind, slug ORDER BY n DESC, label) = 1")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.hubs(table(spark, sf_dir, "part"), {"brand": (F.col("p_brand"), 3), "type": (F.col("p_type"), 5)})


@query("e31_share_ranking", f"WITH {REC}, g AS (SELECT nation, count(*) AS total, count(*) FILTER ({BIO}) AS hits FROM rec GROUP BY nation HAVING total >= 5 AND hits > 0) SELECT nation, total, hits, row_number() OVER (ORDER BY hits::DOUBLE / total DESC, hits DESC, nation)::BIGINT AS place FROM g")
def share_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.share_ranking(records(spark, sf_dir), "nation", bio(), 5)


@query("e34_one_per_asset", "WITH a AS (SELECT p_partkey, unnest(CASE WHEN p_size % 5 = 0 THEN ['unresolved:' || p_partkey] ELSE list_distinct(string_split(p_name, ' ')) END) AS asset, p_brand FROM part) SELECT asset, count(DISTINCT p_partkey) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS shared FROM a GROUP BY asset")
def one_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = F.when(F.col("p_size") % 5 != 0, F.split("p_name", " "))
    out = portfolio.one_per_asset(table(spark, sf_dir, "part"), "p_partkey", assets, ["p_brand"])
    return out.select("asset", "n", F.array_join("p_brand", ",").alias("brands"), portfolio.shared_value(F.col("p_brand")).alias("shared"))


@query("e37_disclosure_gap", f"WITH {REC}, d AS (SELECT segment, n_lines > 3 AS has, (2001 - year(last_ship)) * 12 + 1 - month(last_ship) > 13 AS due FROM rec) SELECT segment, count(*) FILTER (due) AS due, count(*) FILTER (due AND NOT has) AS silent FROM d GROUP BY segment")
def disclosure_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.disclosure_gap(records(spark, sf_dir), ["segment"], F.col("last_ship"), F.col("n_lines") > 3, F.lit("2001-01-01").cast("date"))


@query("e41_label_histograms", "WITH p AS (SELECT md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '))) AS g, coalesce(lang, '') AS label, count(*) AS n FROM documents GROUP BY ALL) SELECT g, sum(n)::BIGINT AS n_rows, string_agg(label || '=' || n, ';' ORDER BY label || '=' || n) AS histogram, count(*) = 1 AS agrees FROM p GROUP BY g")
def label_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.agreement_groups(table(spark, sf_dir, "documents"), F.md5(text.normalized(F.col("text"))), "lang")


@query("e43_repeated_signals", f"WITH {REC} SELECT o_custkey, count(*) AS n FROM rec WHERE {BIO} GROUP BY o_custkey HAVING count(*) >= 2")
def repeated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(bio()).groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 2")


@query("e45_any_all_agreement", f"WITH {REC}, k AS (SELECT o_custkey, bool_or(returned) AS a, bool_and(returned) AS b FROM rec GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (a) AS any_hit, count(*) FILTER (b) AS all_hit FROM k")
def any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.any_all(records(spark, sf_dir), "o_custkey", event())


@query("e46_start_cohorts", f"WITH {REC} SELECT year(odate)::INTEGER AS start_year, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS closed, round(count(*) FILTER (o_orderstatus IN ('F', 'O') AND returned)::DOUBLE / count(*) FILTER (o_orderstatus IN ('F', 'O')), 6) AS rate FROM rec GROUP BY 1 HAVING closed >= 5")
def start_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = records(spark, sf_dir).groupBy(F.year("odate").alias("start_year")).agg(F.count_if(closed()).alias("closed"), F.count_if(closed() & event()).alias("k")).where("closed >= 5")
    return g.select("start_year", "closed", F.round(stats.rate(F.col("k"), F.col("closed")), 6).alias("rate"))


@query("e53_missed_by_sponsor", f"WITH {REC} SELECT segment, count(*) FILTER (returned) AS missed, count(DISTINCT o_custkey) FILTER (returned) AS sponsors FROM rec WHERE o_orderstatus = 'O' GROUP BY segment")
def missed_by_sponsor(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = records(spark, sf_dir).where("o_orderstatus = 'O'")
    return done.groupBy("segment").agg(F.count_if("returned").alias("missed"), F.count_distinct(F.when(event(), F.col("o_custkey"))).alias("sponsors"))


@query("e55_unknown_members", "WITH m AS (SELECT unnest(CASE WHEN p_size < 10 THEN ['UNKNOWN'] ELSE list_distinct(string_split(p_type, ' ')) END) AS member FROM part) SELECT member, count(*) AS total FROM m GROUP BY member")
def unknown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.membership_counts(table(spark, sf_dir, "part"), F.when(F.col("p_size") >= 10, F.split("p_type", " ")), {})


@query("e57_fixed_order", "WITH o AS (SELECT * FROM (VALUES ('1-URGENT', 0), ('none such', 1), ('5-LOW', 2)) v(member, place)) SELECT member, place, count(o_orderkey) AS total, count(o_orderkey) FILTER (o_orderstatus = 'F') AS failed FROM o LEFT JOIN orders ON o_orderpriority = member GROUP BY ALL")
def fixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.membership_counts(table(spark, sf_dir, "orders"), F.array("o_orderpriority"), {"failed": F.col("o_orderstatus") == "F"}, order=["1-URGENT", "none such", "5-LOW"])


@query("e61_distinct_summary", f"WITH {REC} SELECT count(*) AS total, count(DISTINCT segment) AS areas, count(DISTINCT nation) AS sponsors FROM rec WHERE {BIO}")
def distinct_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(bio()).agg(F.count("*").alias("total"), F.count_distinct("segment").alias("areas"), F.count_distinct("nation").alias("sponsors"))


@query("g07_preference_order", f"WITH {REC} SELECT nation, o_orderkey FROM rec QUALIFY row_number() OVER (PARTITION BY nation ORDER BY {BIO} DESC, o_orderpriority, odate DESC, o_orderkey) <= 2")
def preference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("nation").orderBy(F.desc(bio()), "o_orderpriority", F.desc("odate"), "o_orderkey")
    return records(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 2").select("nation", "o_orderkey")


@query("g11_latest_per_category", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("h02_page_of_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def page_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 25).select("o_orderkey", "o_totalprice")


@query("h06_prefix_then_substring", "WITH n AS (SELECT DISTINCT c_name FROM customer WHERE contains(lower(c_name), '12')) SELECT c_name FROM n ORDER BY (NOT starts_with(lower(c_name), '12'))::INT, c_name LIMIT 20")
def prefix_then_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.suggestions(table(spark, sf_dir, "customer"), "c_name", "12", 20)


@query("h12_recent", f"WITH {REC} SELECT o_orderkey FROM rec WHERE {BIO} ORDER BY odate DESC, o_orderkey LIMIT 15")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(bio()).orderBy(F.desc("odate"), "o_orderkey").limit(15).select("o_orderkey")


@query("i06_fresh_batch", "WITH one AS (SELECT text, min((doc_id, lang)) AS r FROM documents GROUP BY text), f AS (SELECT text, r[1] AS doc_id, r[2] AS lang FROM one WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)) SELECT doc_id, lang FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s1:' || doc_id::VARCHAR), doc_id) <= 10")
def fresh_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    taken = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return portfolio.fresh_batch(d, taken, "text", "doc_id", "lang", 10).select("doc_id", "lang")


@query("i08_distinct_sets", "SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), chr(1)) ORDER BY p_retailprice DESC, p_partkey) = 1")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.distinct_sets(table(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " "), [F.desc("p_retailprice"), F.asc("p_partkey")])


@query("n04_subscription_match", "SELECT event_id, reader FROM events JOIN (VALUES ('signup', 'a'), ('error', 'b'), ('error', 'c')) s(term, reader) ON event_type = term")
def subscription_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.changes import matches

    subs = spark.createDataFrame([("signup", "a"), ("error", "b"), ("error", "c")], "term string, reader string")
    return matches(table(spark, sf_dir, "events"), subs, "event_type", "term").select("event_id", "reader")


@query("n06_unread_selection", "SELECT d.doc_id FROM documents d WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0)")
def unread_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import new_rows

    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return new_rows(d, d.where("doc_id % 4 = 0"), "h").select("doc_id")


@query("p03_gates", "SELECT gate, value >= least AS passed FROM (SELECT unnest([{'gate': 'quality share', 'value': avg(quality)::DOUBLE, 'least': 0.3}, {'gate': 'labelled', 'value': count(*)::DOUBLE, 'least': 10.0}], recursive := true) FROM labels)")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.checks import gates as passed

    return passed(table(spark, sf_dir, "labels"), {"quality share": (F.avg("quality"), 0.3), "labelled": (F.count("*"), 10)})


@query("p07_denied_evidence")
def denied_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts classified as a safety failure though every clause that names safety denies it."""
    return table(spark, sf_dir, "documents").agg(F.count_if(denied_safety(F.col("text"))).alias("n"))


def denied_safety(reason: Column) -> Column:
    """The test for denial is a pattern of its own, with no window: a negation stands somewhere before the
    first safety word of each clause that has one."""
    words = "|".join(re.escape(w) for w in (*classify.SAFETY_WORDS, *classify.SAFETY))
    clauses = F.filter(F.split(text.normalized(reason), "[.;:]"), lambda c: c.rlike(rf"(?:{words})"))
    denied = F.forall(clauses, lambda c: c.rlike(rf"^(?:(?!{words}).)*?\b(?:no|not|without|never|neither|nor|unrelated to|rather than)\b"))
    return F.coalesce((classify.classify_reason(reason)["reason"] == "SAFETY") & (F.size(clauses) > 0) & denied, F.lit(False))
