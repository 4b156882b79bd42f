"""Reports of families D, E, H, I, L, N, O and P over the record frame, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, portfolio, reporting
from .records import SQL as REC
from .records import closed, event, records
from .registry import query, table
from .statistics import TAIL, rounded

BIO = "(o_orderstatus = 'F' AND returned)"


def bio():
    return (F.col("o_orderstatus") == "F") & event()


# --- segment families with a rule of publication ----------------------------------------------------

FAMILY = f"""{TAIL}, u AS (SELECT nation, count(DISTINCT o_custkey) FILTER (o_orderstatus IN ('F', 'O') AND returned) AS units FROM rec GROUP BY nation),
  r AS (SELECT nation, p, row_number() OVER (ORDER BY p, nation) AS r, count(*) OVER () AS m FROM tail),
  q AS (SELECT nation, least(1.0, min(p * m / r) OVER (ORDER BY r DESC) * (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) FROM r) + 1) t(i))) AS q_by FROM r),
  w AS (SELECT nation, n, k, units, k::DOUBLE / n AS rate, greatest(0.0, (k::DOUBLE / n + 1.9208 / n - 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) AS low, p0 FROM seg JOIN u USING (nation), pool),
  f AS (SELECT nation, n, k, rate, low, p0, q_by, (n >= 50 AND k >= 10) OR (k >= 2 AND units >= 2 AND low > p0) AS publish FROM w JOIN q USING (nation))"""


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = closed() & event()
    seg = records(spark, sf_dir).groupBy("nation").agg(F.count_if(closed()).alias("n"), F.count_if(stop).alias("k"), F.count_distinct(F.when(stop, F.col("o_custkey"))).alias("units"))
    return reporting.published(seg, "nation", "n", "k", "units", 50, 10, (2, 2))


@query("e12_segment_family", f"{FAMILY} SELECT nation, n, k, round(rate, 6) AS rate, round(low, 6) AS low, round(p0, 6) AS baseline, round(q_by, 5) AS q_by FROM f")
def segment_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(family(spark, sf_dir), "rate", "low", "baseline")
    return out.select("nation", "n", "k", "rate", "low", "baseline", F.round("q_by", 5).alias("q_by"))


@query("e47_publish_rule", f"{FAMILY} SELECT nation, publish FROM f")
def publish_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family(spark, sf_dir).select("nation", "publish")


@query("o03_featured_segment", f"{FAMILY} SELECT nation, round(rate, 6) AS rate FROM f WHERE n >= 10 AND k >= 2 AND low > p0 ORDER BY rate DESC, nation LIMIT 1")
def featured_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = records(spark, sf_dir).groupBy("nation").agg(F.count_if(closed()).alias("n"), F.count_if(closed() & event()).alias("k"))
    return rounded(reporting.featured(seg, "nation", "n", "k", 10, 2).select("nation", "rate"), "rate")


# --- counts and rankings ------------------------------------------------------------------------------

TOTALS = f"count(*) AS total, count(*) FILTER ({BIO}) AS bio, count(*) FILTER (o_orderstatus = 'O') AS open"


def totals() -> list:
    return [F.count("*").alias("total"), F.count_if(bio()).alias("bio"), F.count_if(F.col("o_orderstatus") == "O").alias("open")]


@query("e05_label_totals", f"WITH {REC} SELECT nation AS label, count(*) AS total, count(*) FILTER ({BIO}) AS bio FROM rec GROUP BY nation ORDER BY total DESC, label LIMIT 5")
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.top_counts(records(spark, sf_dir), F.col("nation"), {"bio": bio()}, 5)


@query("e40_top_with_minimum", f"WITH {REC} SELECT o_custkey AS label, count(*) AS total FROM rec WHERE {BIO} GROUP BY 1 HAVING count(*) >= 3 ORDER BY total DESC, label LIMIT 14")
def top_with_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.top_counts(records(spark, sf_dir).where(bio()), F.col("o_custkey"), {}, 14, least=3)


@query("e26_group_counts", f"WITH {REC} SELECT region, o_orderstatus, count(*) AS n FROM rec GROUP BY ALL")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("region", "o_orderstatus").agg(F.count("*").alias("n"))


@query("e24_all_slices", f"WITH {REC} SELECT 'segment' AS slice, segment AS label, {TOTALS} FROM rec GROUP BY segment UNION ALL SELECT 'region', region, {TOTALS} FROM rec GROUP BY region UNION ALL SELECT 'priority', o_orderpriority, {TOTALS} FROM rec GROUP BY o_orderpriority UNION ALL SELECT 'all', 'all', {TOTALS} FROM rec")
def all_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slices from one pass: each record is laid out once per slice and combined before the shuffle."""
    slices = F.array(*[F.struct(F.lit(n).alias("slice"), c.alias("label")) for n, c in (("segment", F.col("segment")), ("region", F.col("region")), ("priority", F.col("o_orderpriority")), ("all", F.lit("all")))])
    return records(spark, sf_dir).select("*", F.explode(slices).alias("s")).groupBy("s.slice", "s.label").agg(*totals())


@query("e54_dimension_rows", f"WITH {REC} SELECT o_orderpriority AS label, count(*) AS total, count(*) FILTER ({BIO}) AS bio, count(DISTINCT nation) AS nations, round(count(*) FILTER ({BIO})::DOUBLE / count(*), 6) AS share FROM rec GROUP BY 1")
def dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("total"), F.count_if(bio()).alias("bio"), F.count_distinct("nation").alias("nations"))
    return out.withColumn("share", F.round(F.col("bio") / F.col("total"), 6))


@query("e56_area_rows", f"WITH {REC} SELECT row_number() OVER (ORDER BY count(*) DESC, region) AS place, region, count(*) AS n FROM rec GROUP BY region")
def area_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = records(spark, sf_dir).groupBy("region").agg(F.count("*").alias("n"))  # one row per region
    return n.select(F.row_number().over(Window.orderBy(F.desc("n"), "region")).cast("long").alias("place"), "region", "n")


@query("e58_phase_items", f"WITH {REC}, c AS (SELECT o_orderpriority, nation, count(*) AS n FROM rec WHERE {BIO} GROUP BY ALL) SELECT o_orderpriority, nation, n FROM c QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, nation) <= 3")
def phase_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_items(spark, sf_dir, "o_orderpriority")


@query("e59_bucket_items", f"WITH {REC}, c AS (SELECT segment, nation, count(*) AS n FROM rec WHERE {BIO} GROUP BY ALL) SELECT segment, nation, n FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, nation) <= 3")
def bucket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_items(spark, sf_dir, "segment")


def _top_items(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    from pyspark.sql import Window

    n = records(spark, sf_dir).where(bio()).groupBy(by, "nation").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "nation"))
    return n.withColumn("r", place).where("r <= 3").drop("r")


@query("e60_phase_totals", f"WITH {REC} SELECT {TOTALS} FROM rec WHERE o_orderpriority = '1-URGENT'")
def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("o_orderpriority = '1-URGENT'").agg(*totals())


@query("e62_area_totals", f"WITH {REC} SELECT {TOTALS} FROM rec WHERE region = 'ASIA'")
def area_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("region = 'ASIA'").agg(*totals())


@query("e63_ranked_units", f"WITH {REC}, c AS (SELECT o_custkey, count(*) AS n FROM rec GROUP BY 1) SELECT count(*) AS units, count(*) FILTER (n >= 5) AS with_five, max(n) AS most FROM c")
def ranked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = records(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("units"), F.count_if(F.col("n") >= 5).alias("with_five"), F.max("n").alias("most"))


@query("e64_positive_counts", f"WITH {REC} SELECT nation AS label, count(*) AS total FROM rec WHERE returned AND nation NOT IN ('NATION_3', 'CHINA') GROUP BY 1 ORDER BY total DESC, label LIMIT 10")
def positive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.top_counts(records(spark, sf_dir).where(event() & ~F.col("nation").isin("NATION_3", "CHINA")), F.col("nation"), {}, 10)


@query("e36_attribution_counts", f"WITH {REC} SELECT CASE WHEN returned THEN 'OWN' WHEN n_lines > 4 THEN 'CASCADE' ELSE 'UNCLEAR' END AS verdict, o_orderstatus AS basis, count(*) AS n FROM rec GROUP BY ALL")
def attribution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(event(), "OWN").when(F.col("n_lines") > 4, "CASCADE").otherwise("UNCLEAR")
    return records(spark, sf_dir).groupBy(verdict.alias("verdict"), F.col("o_orderstatus").alias("basis")).agg(F.count("*").alias("n"))


@query("e48_recovered_reasons", f"WITH {REC} SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'BIOLOGICAL' ELSE 'OTHER' END AS outcome, count(*) AS n, count(DISTINCT o_custkey) AS units FROM rec WHERE o_orderstatus = 'F' AND NOT returned AND n_lines > 0 GROUP BY 1")
def recovered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).where((F.col("o_orderstatus") == "F") & ~event() & (F.col("n_lines") > 0))
    outcome = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "BIOLOGICAL").otherwise("OTHER")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("units"))


@query("e51_reconciliation", f"WITH {REC} SELECT 0 AS place, 'stops' AS step, count(*) FILTER ({BIO}) AS n FROM rec UNION ALL SELECT 1, 'in region', count(*) FILTER ({BIO} AND region = 'ASIA') FROM rec UNION ALL SELECT 2, 'in window', count(*) FILTER ({BIO} AND region = 'ASIA' AND year(odate) BETWEEN 1995 AND 1998) FROM rec")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.flow(records(spark, sf_dir), [("stops", bio()), ("in region", F.col("region") == "ASIA"), ("in window", F.year("odate").between(1995, 1998))])


@query("e52_dispositions", "SELECT CASE WHEN quality IS NULL THEN 'open' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS disposition, source, count(*) AS n, count(DISTINCT md5(text)) AS groups FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("g")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    what = F.when(F.col("quality").isNull(), "open").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return d.groupBy(what.alias("disposition"), "source").agg(F.count("*").alias("n"), F.count_distinct("g").alias("groups"))


@query("e33_name_pages", "WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS raw, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, p_type FROM part), v AS (SELECT slug, raw, count(*) AS n FROM d GROUP BY ALL), b AS (SELECT slug, raw AS name FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, raw) AS r FROM v) WHERE r = 1) SELECT d.slug, name, count(*) AS total, sum(DISTINCT length(p_type))::BIGINT AS type_chars FROM d JOIN b ON d.slug = b.slug GROUP BY ALL HAVING count(*) >= 2")
def name_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    d = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), text.slug(F.col("p_name")).alias("slug"), "p_type")
    pages = d.groupBy("slug").agg(F.count("*").alias("total"), F.sum_distinct(F.length("p_type").cast("long")).alias("type_chars")).where("total >= 2")
    return pages.join(reporting.display_name(d, "slug", "raw"), "slug")


@query("e35_shared_kind", "SELECT p_name, count(DISTINCT p_brand) AS n, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS kind, count(DISTINCT p_brand) || ' brands' || CASE WHEN count(DISTINCT p_type) = 1 THEN ', all ' || lower(min(p_type)) ELSE '' END AS sentence FROM part GROUP BY p_name")
def shared_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n"), F.collect_set("p_type").alias("kinds"))
    kind = portfolio.shared_value(F.col("kinds"))
    return rows.select("p_name", "n", kind.alias("kind"), F.concat(F.col("n").cast("string"), F.lit(" brands"), F.when(kind.isNotNull(), F.concat(F.lit(", all "), F.lower(kind))).otherwise("")).alias("sentence"))


@query("e38_class_area", "WITH c AS (SELECT DISTINCT p_brand AS class, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey), " + REC + f" SELECT class, region, {TOTALS}, coalesce(string_agg(DISTINCT CASE WHEN {BIO} THEN segment END, ',' ORDER BY CASE WHEN {BIO} THEN segment END), '') AS failed FROM c JOIN rec ON l_orderkey = o_orderkey GROUP BY ALL")
def class_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("class"))
    c = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(part, "l_partkey").select("class", "o_orderkey").distinct()
    rows = c.join(records(spark, sf_dir), "o_orderkey").groupBy("class", "region")
    return rows.agg(*totals(), F.array_join(F.sort_array(F.collect_set(F.when(bio(), F.col("segment")))), ",").alias("failed"))


@query("e39_watch_terms")
def watch_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as terms, their brands as what they select; near-copies of a kept term fall."""
    members = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("term"), F.concat("p_brand", F.col("p_size").cast("string")).alias("item"))
    return reporting.suppress_overlaps(members, "term", "item")


# --- strict joins, decisions, related records -----------------------------------------------------------


@query("d05_snapshot_or_inline", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END, CASE WHEN n_chars < 200 THEN 'bad' ELSE 'good' END) AS label, CASE WHEN quality IS NULL THEN 'inline' ELSE 'snapshot' END AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def snapshot_or_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("known"))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(marks, "doc_id", "left")
    inline = classify.decide([(F.col("n_chars") < 200, F.lit("bad"))], F.lit("good"))
    return d.select("doc_id", F.coalesce("known", inline).alias("label"), F.when(F.col("known").isNull(), "inline").otherwise("snapshot").alias("origin"))


@query("d07_group_of_text", "WITH g AS (SELECT md5(text) AS h, min(doc_id) AS g, count(*) AS n FROM documents GROUP BY 1) SELECT l.doc_id, g, n FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN g ON md5(text) = h")
def group_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    groups = d.groupBy("h").agg(F.min("doc_id").alias("g"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id")
    return reporting.strict_join(rows, groups, "h").select("doc_id", "g", "n")


@query("d22_same_ids", "SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders")
def same_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return reporting.strict_join(o.select("o_orderkey", F.col("o_orderstatus").alias("a")), o.select("o_orderkey", F.col("o_orderpriority").alias("b")), "o_orderkey", both=True)


@query("d23_related_records", "WITH w AS (SELECT p_partkey, lead(p_partkey, 1) OVER w AS f1, lag(p_partkey, 1) OVER w AS b1, lead(p_partkey, 2) OVER w AS f2, lag(p_partkey, 2) OVER w AS b2 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)) SELECT p_partkey, array_to_string(list_filter([f1, b1, f2, b2], lambda x: x IS NOT NULL)[1:2], ',') AS neighbours FROM w")
def related_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reporting.related(table(spark, sf_dir, "part"), "p_partkey", "p_brand", [F.col("p_retailprice"), F.col("p_partkey")], 2)
    return out.select("p_partkey", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("d24_decisions_by_text", "WITH a AS (SELECT md5(text) AS h, max(quality) AS q FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1) SELECT d.doc_id, q AS decision FROM documents d JOIN a ON md5(text) = h")
def decisions_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on some records hold for all records with the same text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    decided = table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id").groupBy("h").agg(F.max("quality").alias("decision"))
    return d.join(decided, "h").select("doc_id", "decision")


@query("d27_relation_counts", "WITH s AS (SELECT p_brand, p_size FROM part WHERE p_partkey = 1), r AS (SELECT p_type, CASE WHEN p.p_brand = s.p_brand AND p.p_size = s.p_size THEN 'both' WHEN p.p_brand = s.p_brand THEN 'brand' WHEN p.p_size = s.p_size THEN 'size' END AS relation FROM part p, s) SELECT p_type, count(*) FILTER (relation = 'both') AS both, count(*) FILTER (relation = 'brand') AS brand, count(*) FILTER (relation = 'size') AS size FROM r GROUP BY p_type HAVING count(relation) > 0")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    one = F.broadcast(part.where("p_partkey = 1").select(F.col("p_brand").alias("b"), F.col("p_size").alias("s")))  # one subject
    same_brand, same_size = F.col("p_brand") == F.col("b"), F.col("p_size") == F.col("s")
    rows = part.join(one, same_brand | same_size)
    return rows.groupBy("p_type").agg(F.count_if(same_brand & same_size).alias("both"), F.count_if(same_brand & ~same_size).alias("brand"), F.count_if(~same_brand & same_size).alias("size"))


@query("d28_cohorts_of_target", "WITH m AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS item FROM part), t AS (SELECT item FROM m WHERE p_brand = 'Brand#13') SELECT p_brand, count(*) AS shared FROM m JOIN t USING (item) WHERE p_brand <> 'Brand#13' GROUP BY p_brand ORDER BY shared DESC, p_brand LIMIT 5")
def cohorts_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("item")).distinct()
    shared = m.where("p_brand <> 'Brand#13'").join(m.where("p_brand = 'Brand#13'").select("item"), "item")
    return shared.groupBy("p_brand").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "p_brand").limit(5)


@query("d30_proposals", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'PROPOSED' ELSE c_mktsegment END AS segment FROM customer")
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    made = c.where("c_custkey % 5 = 3").select("c_custkey", F.lit("PROPOSED").alias("value"), (F.col("c_custkey") % 10 != 3).alias("retired"))
    return reporting.apply_proposals(c, made, "c_custkey", "segment")


# --- orders, pages, links, model verdicts -----------------------------------------------------------------


@query("h03_recent_first", f"WITH {REC} SELECT o_orderkey FROM rec ORDER BY last_ship DESC NULLS LAST, o_orderkey LIMIT 50")
def recent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.page(records(spark, sf_dir), [F.desc_nulls_last("last_ship"), F.col("o_orderkey")], 1, 50).select("o_orderkey")


@query("h04_date_desc_100", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def date_desc_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 1, 100).select("o_orderkey")


@query("h08_decoded_page", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT') ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def decoded_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that a query string asks for: facets, page and page size are parsed by the engine's own functions."""
    asked = "https://x.example/explore?status=F,O&priority=1-URGENT&page=3&pageSize=20"
    arg = lambda k: F.parse_url(F.lit(asked), F.lit("QUERY"), F.lit(k))
    got = spark.range(1).select(F.split(arg("status"), ",").alias("s"), F.split(arg("priority"), ",").alias("p"), arg("page").cast("int").alias("n"), arg("pageSize").cast("int").alias("size")).first()
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(got["s"]) & F.col("o_orderpriority").isin(got["p"]))
    return portfolio.page(rows, [F.col("o_orderkey")], got["n"], got["size"]).select("o_orderkey")


@query("h09_review_queue", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return portfolio.page(waiting, [F.desc("n_chars"), F.col("doc_id")], 2, 25).select("doc_id", "source")


@query("h10_best_example", f"WITH {REC} SELECT segment, count(*) AS n, arg_min(o_orderkey, ((NOT returned)::INT, -n_lines, o_orderkey)) AS example FROM rec GROUP BY segment")
def best_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    preference = F.struct((~event()).cast("int").alias("a"), (-F.col("n_lines")).alias("b"), "o_orderkey")
    return records(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"), F.min(preference)["o_orderkey"].alias("example"))


@query("h11_comparison_order", "WITH s AS (SELECT p_brand, p_size, p_type FROM part WHERE p_partkey = 2) SELECT p_partkey FROM part p, s ORDER BY (p.p_brand = s.p_brand AND p.p_size = s.p_size) DESC, (p.p_brand = s.p_brand AND p.p_type = s.p_type) DESC, (p.p_brand = s.p_brand) DESC, p_retailprice DESC, p_partkey LIMIT 30")
def comparison_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    one = F.broadcast(part.where("p_partkey = 2").select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"), F.col("p_type").alias("t")))
    brand = F.col("p_brand") == F.col("b")
    order = [F.desc(brand & (F.col("p_size") == F.col("s"))), F.desc(brand & (F.col("p_type") == F.col("t"))), F.desc(brand), F.desc("p_retailprice"), F.col("p_partkey")]
    return portfolio.page(part.join(one, F.lit(True)), order, 1, 30).select("p_partkey")  # one subject


@query("i07_unit_flags", f"WITH {REC} SELECT nation, count(*) AS n, count(*) FILTER ({BIO}) >= 3 AS indexable FROM rec GROUP BY nation HAVING count(*) >= 10")
def unit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = records(spark, sf_dir).groupBy("nation").agg(F.count("*").alias("n"), (F.count_if(bio()) >= 3).alias("indexable"))
    return n.where("n >= 10")


@query("i03_mapped_list", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x) || ':' || length(x)), ',') AS mapped FROM part")
def mapped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = F.transform(F.split("p_name", " "), lambda x: F.concat(F.upper(x), F.lit(":"), F.length(x).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(mapped, ",").alias("mapped"))


@query("n03_due_subscribers", "SELECT user_id FROM events GROUP BY user_id HAVING date_diff('day', max(ts)::DATE, DATE '2024-02-10') >= 12")
def due_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("date").alias("last"))
    return last.where(F.datediff(F.lit("2024-02-10").cast("date"), F.col("last")) >= 12).select("user_id")


@query("n07_model_verdicts", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'A' WHEN n_chars > 1000 THEN 'A' WHEN n_chars > 300 THEN 'B' ELSE 'U' END AS rule, CASE WHEN doc_id % 4 = 0 THEN 'A' ELSE 'B' END AS model, CASE WHEN doc_id % 11 = 0 THEN 'H' END AS human FROM documents) SELECT doc_id, coalesce(human, CASE WHEN rule = 'U' THEN model WHEN rule <> model THEN 'U' ELSE rule END) AS verdict FROM d")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's verdict stands; an unclear rule takes the model's; where both claim and differ it is unclear."""
    k = F.col("doc_id")
    rule = F.when((k % 9 == 0) | (F.col("n_chars") > 1000), "A").when(F.col("n_chars") > 300, "B").otherwise("U")
    model, human = F.when(k % 4 == 0, "A").otherwise("B"), F.when(k % 11 == 0, "H")
    verdict = F.coalesce(human, classify.decide([(rule == "U", model), (rule != model, F.lit("U"))], rule))
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


@query("n08_fill_placeholders", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'F' THEN 'recovered' WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE o_orderpriority END AS reason FROM orders")
def fill_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only placeholders are filled, and only with what is known with high confidence."""
    given = F.when(F.col("o_orderkey") % 4 == 0, "N/A").otherwise(F.col("o_orderpriority"))
    sure = F.when(F.col("o_orderstatus") == "F", "recovered")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(classify.is_placeholder(given), F.coalesce(sure, given)).otherwise(given).alias("reason"))


@query("l10_molecule_index", "WITH s AS (SELECT lower(p_name) AS name, p_partkey FROM part WHERE p_size % 2 = 0) SELECT name, min(p_partkey) AS id, count(*) > 1 AS ambiguous FROM s GROUP BY name")
def molecule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of usable molecules; an ambiguous name goes to the smallest id."""
    s = table(spark, sf_dir, "part").where("p_size % 2 = 0").groupBy(F.lower("p_name").alias("name"))
    return s.agg(F.min("p_partkey").alias("id"), (F.count("*") > 1).alias("ambiguous"))


DEFINITIONS = [("antibody-drug conjugate", "ADC"), ("bispecific", "Bispecific antibody"), ("vaccine", "Vaccine"), (r"\bt cells?\b|chimeric", "Cell therapy"), ("antibody", "Antibody"), ("inhibitor|agonist", "Small molecule")]
TEXTS = ["An antibody-drug conjugate against X", "A bispecific antibody", "Autologous T cells with a chimeric receptor", "A monoclonal antibody", "An orally bioavailable inhibitor", "A herbal tea"]


@query("l03_definition_modality", "SELECT p_partkey, (['ADC', 'Bispecific antibody', 'Cell therapy', 'Antibody', 'Small molecule', 'UNKNOWN'])[p_partkey % 6 + 1] AS modality FROM part")
def definition_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lower(F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", classify.decide([(d.rlike(p), F.lit(m)) for p, m in DEFINITIONS], F.lit("UNKNOWN")).alias("modality"))


@query("l11_subject_lookup", "WITH m AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part WHERE p_size % 2 = 0 GROUP BY 1), q AS (SELECT p_partkey, lower(p_name) AS q, lower(p_brand) AS t FROM part) SELECT q.p_partkey, CASE WHEN m.id IS NOT NULL THEN 'molecule' WHEN q.p_partkey % 2 = 0 THEN 'target' ELSE 'none' END AS kind, m.id FROM q LEFT JOIN m ON q = name")
def subject_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject is a molecule if its name is known, else a target if that is."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    found = part.join(molecule_index(spark, sf_dir).select("name", "id"), "name", "left")
    kind = classify.decide([(F.col("id").isNotNull(), F.lit("molecule")), (F.col("p_partkey") % 2 == 0, F.lit("target"))], F.lit("none"))
    return found.select("p_partkey", kind.alias("kind"), "id")
