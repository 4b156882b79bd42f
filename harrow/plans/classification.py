"""Family K (text classification) on documents and conversations with small lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify
from .registry import query, table

AREAS = {"law": ["licen", "copyright", "permission"], "mail": ["mail", "@", "phone"], "code": ["function", "token", "key"]}
AREA_SQL = " ".join(f"UNION ALL SELECT doc_id, '{a}' AS area, {' + '.join(f'''contains(lower(text), '{w}')::INT''' for w in words)} AS n FROM documents" for a, words in AREAS.items())[10:]


@query("k01_keyword", "SELECT doc_id, contains(lower(text), 'license') AS hit, regexp_matches(lower(text), '\\bthe\\b') AS word FROM documents")
def keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_hit(t, "license").alias("hit"), text.keyword_hit(t, "the", whole_word=True).alias("word"))


@query("k02_areas", f"WITH s AS ({AREA_SQL}), m AS (SELECT * FROM s WHERE n > 0) SELECT d.doc_id, coalesce(p, 'Other') AS primary_area, coalesce(areas, '') AS areas FROM documents d LEFT JOIN (SELECT doc_id, arg_min(area, (-n, (area <> 'mail')::INT, area)) AS p, string_agg(area, ';' ORDER BY area) AS areas FROM m GROUP BY doc_id) x ON d.doc_id = x.doc_id")
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = classify.area_scores(F.lower("text"), AREAS, preferred="mail")
    return table(spark, sf_dir, "documents").select("doc_id", a.alias("a")).select("doc_id", F.col("a.primary").alias("primary_area"), F.array_join("a.matched", ";").alias("areas"))


@query("k05_dimension_scores")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", classify.score(t, {"license": 2, "token": 3, "reserved": 1}, classify.denies(t, ("license",))).alias("score"))


@query("k08_classify_reason")
def classify_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.classify_reason(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", "c.*")


@query("k09_snippet")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.stop_snippet(F.col("text"), ("license", "reserved"), 120).alias("snippet"))


@query("k10_fallback")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = classify.with_fallback(F.lit("Reason not provided."), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", f.alias("f")).select("conv_id", "turn", "f.c.label", "f.source")


@query("k11_precedence", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, CASE WHEN o_orderkey % 3 > 0 THEN upper(regexp_replace(o_orderpriority, '[\\s/-]+', '_', 'g')) END, 'UNKNOWN') AS label, CASE WHEN o_orderstatus <> 'P' THEN 'final' WHEN o_orderkey % 3 > 0 THEN 'second' ELSE 'none' END AS source FROM orders")
def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = F.when(F.col("o_orderstatus") == "P", "unresolved").otherwise(F.col("o_orderstatus"))
    r = classify.resolve(final, F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r["label"].alias("label"), r["source"].alias("source"))


@query("k12_buckets", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'OTHER/UNKNOWN' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FAST' WHEN o_orderpriority = '5-LOW' THEN 'SLOW' ELSE 'OTHER/UNKNOWN' END AS bucket FROM orders) GROUP BY bucket")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = classify.bucket(F.col("o_orderpriority"), {"1-URGENT": "FAST", "2-HIGH": "FAST", "5-LOW": "SLOW"}, F.col("o_orderkey") % 5 == 0)
    return table(spark, sf_dir, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("k14_decision_list", "SELECT doc_id, CASE WHEN contains(lower(text), 'copyright') THEN 'rights' WHEN contains(lower(text), 'license') THEN 'licence' WHEN n_chars < 100 THEN 'short' ELSE 'plain' END AS code FROM documents")
def decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    code = classify.decide([(t.rlike("copyright"), F.lit("rights")), (t.rlike("license"), F.lit("licence")), (F.col("n_chars") < 100, F.lit("short"))], F.lit("plain"))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))


@query("k17_affirmed", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, 'not [a-z]+', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS h FROM documents")
def affirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(classify.affirmed(F.col("text"), ["not [a-z]+"])).alias("h"))


@query("k19_stop_sentences")
def stop_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.stop_sentences(F.col("text"), r"license|reserved", r"\b(?:not|will)\b")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("sentence"))


@query("k22_signal_regex", "SELECT count(*) FILTER (regexp_matches(lower(text), 'license|copyright')) AS endpoint, count(*) FILTER (regexp_matches(lower(text), 'mail|phone')) AS enrolment FROM documents")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, sf_dir, "documents").agg(F.count_if(t.rlike("license|copyright")).alias("endpoint"), F.count_if(t.rlike("mail|phone")).alias("enrolment"))


@query("k29_reason_set", "SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_append(string_split(p_name, ' '), string_split(p_type, ' ')[1])), lambda x: x NOT IN ('PROMO', 'ECONOMY'))), ',') AS reasons FROM part")
def reason_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = classify.reason_set(F.get(F.split("p_type", " "), 0), F.split("p_name", " "), ["PROMO", "ECONOMY"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(r, ",").alias("reasons"))


@query("k30_parsed_answers", "SELECT event_id, event_id::VARCHAR AS id, event_type AS verdict FROM events WHERE event_id % 4 > 0 AND event_id % 5 > 0")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model answered about each event: of an array the entries about the id that was asked, none of a text that is no
    array or breaks off."""
    k = F.col("event_id")
    entry = lambda i, v: F.struct(i.cast("string").alias("id"), v.alias("verdict"))
    whole = F.to_json(F.array(entry(k, F.col("event_type")), entry(k + 1, F.lit("other")), entry(F.lit(None), F.lit("none"))))
    raw = F.when(k % 4 == 0, "not json").when(k % 5 == 0, F.substring(whole, F.lit(1), F.length(whole) - 4)).otherwise(whole)
    found = classify.parse_answers(raw, "id string, verdict string", F.array(k.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(found).alias("a")).select("event_id", "a.id", "a.verdict")

