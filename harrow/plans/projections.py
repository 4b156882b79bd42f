"""Families B (projections, flattening) and J (scalar functions), and M (posted results) on nested
rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import flatten, results
from .registry import query, table

# --- nested studies: an order with its lines and its customer --------------------------------


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order -> struct of arrays, as a nested record would be read."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("term"), F.col("l_linestatus").alias("id"), F.col("l_suppkey").alias("site"))).alias("meshes"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    section = F.struct(F.struct(F.col("o_orderkey").alias("nctId")).alias("identification"), F.struct("meshes").alias("conditions"), F.struct(F.col("o_orderdate").cast("string").alias("start"), F.col("o_orderpriority").alias("phase")).alias("design"))
    return o.select(section.alias("study"))


@query("b01_nested_path", "SELECT o_orderkey AS id, o_orderpriority AS phase FROM orders")
def nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies(spark, sf_dir).select(F.col("study.identification.nctId").alias("id"), F.col("study.design.phase").alias("phase"))


@query("b03_terms", "SELECT o_orderkey AS id, coalesce(array_to_string(list_sort(list(l_returnflag) FILTER (l_returnflag <> 'N')), '; '), '') AS terms FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flatten.terms(F.col("study.conditions.meshes"), "term", lambda t: t != "N")
    return studies(spark, sf_dir).select(F.col("study.identification.nctId").alias("id"), F.array_join(F.array_sort(found), "; ").alias("terms"))


@query("b04_distinct_sites", "SELECT o_orderkey AS id, coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey)), ','), '') AS sites, count(DISTINCT l_suppkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def distinct_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = flatten.distinct_sorted(F.col("study.conditions.meshes.site"))
    return studies(spark, sf_dir).select(F.col("study.identification.nctId").alias("id"), F.array_join(sites.cast("array<string>"), ",").alias("sites"), F.size(sites).cast("long").alias("n"))


@query("b06_compact_row", "SELECT o_orderkey, upper(trim(regexp_replace(replace(o_orderpriority, '-', ' - '), '\\s+', ' ', 'g'))) AS code FROM orders")
def compact_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace("o_orderpriority", F.lit("-"), F.lit(" - "))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.upper(text.collapse(spaced)).alias("code"))


@query("b07_coalesced_names", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END), ''), source) AS label, string_split(coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END), ''), source), '_')[1] AS label_first FROM documents")
def coalesced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = flatten.first_filled(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), text.first_of(label, "_").alias("label_first"))


@query("b09_calendar_months", "SELECT l_orderkey, l_linenumber, CASE WHEN (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) >= 0 THEN ((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate))::INTEGER END AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", text.calendar_months(F.col("o_orderdate"), F.col("l_shipdate")).alias("months"))


PARTIAL = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'soon' END"


def partial(c: Column) -> Column:
    k = F.col("o_orderkey") % 4
    return F.when(k == 0, F.date_format(c, "yyyy-MM-dd")).when(k == 1, F.date_format(c, "yyyy-MM")).when(k == 2, F.date_format(c, "yyyy")).otherwise("soon")


@query("b10_first_year", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE year(o_orderdate) END::INTEGER AS year FROM orders")
def first_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", flatten.first_year(F.lit(None).cast("string"), partial(F.col("o_orderdate"))).alias("year"))


@query("j15_partial_date", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN date_trunc('year', o_orderdate)::DATE END AS d FROM orders")
def partial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.partial_date(partial(F.col("o_orderdate"))).alias("d"))


@query("b12_phase_flags", "SELECT p_partkey, contains(p_type, 'COPPER') AS copper, contains(p_type, 'STEEL') AS steel FROM part")
def phase_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = flatten.flags(F.split("p_type", " "), {"copper": ["COPPER"], "steel": ["STEEL"]})
    return table(spark, sf_dir, "part").select("p_partkey", *flags)


@query("b13_parsed_list", "SELECT p_partkey, array_to_string(list_sort(list_transform(string_split(p_name, ' '), lambda x: upper(trim(x)))), '|') AS items FROM part")
def parsed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.list_of(F.col("p_name"), " ", upper=True)), "|").alias("items"))


@query("b14_representative", "SELECT p_partkey, CASE WHEN contains(p_type, 'COPPER') THEN 'COPPER' WHEN contains(p_type, 'STEEL') THEN 'STEEL' WHEN contains(p_type, 'TIN') THEN 'TIN' END AS lowest FROM part")
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", flatten.lowest_of(F.split("p_type", " "), ["COPPER", "STEEL", "TIN"]).alias("lowest"))


@query("b16_role_filtered_lists", "WITH r AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R')) AS a FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, coalesce(array_to_string(a[1:6], ','), '') AS parts FROM r")
def role_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("role"), F.array(F.col("l_partkey").cast("long")).alias("names"))).alias("interventions"))
    return items.select("l_orderkey", F.array_join(flatten.role_names(F.col("interventions"), "R", 6).cast("array<string>"), ",").alias("parts"))


@query("b19_bands", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'single' WHEN n < 5 THEN '2-4' ELSE '5+' END AS band FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").select("o_orderkey", flatten.count_band(F.col("n")).alias("band"))


@query("b22_annotated_rows", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL OR quality = 1 THEN 'CORRECT' ELSE 'WRONG' END AS audit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def annotated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "CORRECT").otherwise("WRONG").alias("audit"))
    return docs.join(marks, "doc_id", "left").select("doc_id", F.coalesce("audit", F.lit("CORRECT")).alias("audit"))


# --- scalar functions ------------------------------------------------------------------------------


@query("j01_normalized_hash", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' '))) AS h FROM documents")
def normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("h"))


@query("j03_short_hashes", "SELECT doc_id, substring(sha256(text), 1, 20) AS h256 FROM documents")
def short_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.short_hash(F.col("text")).alias("h256"))


@query("j05_keys_and_codes", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, upper(regexp_replace(trim(p_name), '[\\s/-]+', '_', 'g')) AS code, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def keys_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.key_of(F.col("p_name")).alias("key"), text.code_of(F.col("p_name")).alias("code"), text.slug(F.col("p_type")).alias("slug"))


P = "CASE l_linenumber % 4 WHEN 0 THEN 'P = ' || CAST(l_discount AS DECIMAL(4, 2)) WHEN 1 THEN '<' || CAST(l_discount AS DECIMAL(4, 2)) WHEN 2 THEN 'NS' ELSE '> ' || replace(CAST(CAST(l_discount AS DECIMAL(4, 2)) AS VARCHAR), '.', ',') END"


def raw_p(k: Column, v: Column) -> Column:
    d = v.cast("decimal(4,2)").cast("string")
    return F.when(k % 4 == 0, F.concat(F.lit("P = "), d)).when(k % 4 == 1, F.concat(F.lit("<"), d)).when(k % 4 == 2, "NS").otherwise(F.concat(F.lit("> "), F.replace(d, F.lit("."), F.lit(","))))


@query("j17_p_values", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 2 THEN 0.05 ELSE round(l_discount, 2) END::DOUBLE AS value, CASE l_linenumber % 4 WHEN 0 THEN '=' WHEN 1 THEN '<' ELSE '>' END AS op FROM lineitem")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.with_p_value(table(spark, sf_dir, "lineitem"), raw_p(F.col("l_linenumber"), F.col("l_discount")))
    return rows.select("l_orderkey", "l_linenumber", F.round("p.value", 4).alias("value"), F.col("p.op").alias("op"))


@query("j18_fractions", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 100 BETWEEN 0.0005 AND 0.3 THEN round(l_quantity / 100, 4) END AS f FROM lineitem")
def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(text.fraction(raw), 4).alias("f"))


@query("j20_sentence_counts")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by look-behind, which the SQL engine does not have; a unit test holds it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"), text.first_sentence(F.col("text")).alias("first"))


@query("j23_clipped", "SELECT c_custkey, CASE WHEN length(s) > 30 THEN rtrim(substring(s, 1, 29)) || '…' ELSE s END AS short FROM (SELECT c_custkey, c_name || ' of segment ' || c_mktsegment AS s FROM customer)")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.clipped(F.concat("c_name", F.lit(" of segment "), "c_mktsegment"), 30).alias("short"))


@query("j24_singular_ones", "SELECT p_partkey, regexp_replace(p_size || ' items', '^1 items$', '1 item') AS s FROM part")
def singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.singular_ones(F.concat(F.col("p_size").cast("string"), F.lit(" items")), ["item"]).alias("s"))


@query("j26_dates", "SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS d FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d MMM yyyy").alias("d"))


@query("j28_visible_text")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("text"))


@query("j32_after_marker", "SELECT doc_id, CASE WHEN contains(text, ' the ') THEN regexp_extract(text, '(?s)^.* the (.*)$', 1) END AS rest FROM documents")
def after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.after_last(F.col("text"), " the ").alias("rest"))


@query("a25_shards", "SELECT page_id, (page_id % 256)::INTEGER AS shard, (list_reduce(list_prepend(2166136261, list_transform(string_split(upper(trim(url)), ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 256)::INTEGER AS named_shard FROM pages")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.concat(F.lit(" nct"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    return table(spark, sf_dir, "pages").select("page_id", text.shard_of(numbered).alias("shard"), text.shard_of(F.col("url")).alias("named_shard"))


# --- posted results: an order is a study, its lines are analyses ------------------------------------


def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(
        F.when(F.col("l_returnflag") == "A", "NON_INFERIORITY").otherwise("SUPERIORITY").alias("nonInferiorityType"),
        raw_p(F.col("l_linenumber"), F.col("l_discount")).alias("pValue"),
        F.when(F.col("l_linestatus") == "F", "significance level 5%").when(F.col("l_tax") > 0.04, "one-sided test").alias("pValueComment"),
    )
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array(F.struct(F.lit("primary").alias("type"), F.collect_list(line).alias("analyses"))).alias("outcomes"))


@query(
    "m06_read_analyses",
    """WITH a AS (SELECT l_orderkey, l_returnflag = 'A' AS ni, CASE WHEN l_linenumber % 4 = 2 THEN 0.05 ELSE round(l_discount, 2) END AS v, CASE l_linenumber % 4 WHEN 0 THEN '=' WHEN 1 THEN '<' ELSE '>' END AS op,
        CASE WHEN l_linestatus = 'F' THEN 0.05 WHEN l_tax > 0.04 THEN 0.025 END AS bar FROM lineitem),
      s AS (SELECT *, CASE WHEN op = '=' THEN v <= bar WHEN op = '<' AND v <= bar THEN true WHEN op = '>' AND v >= bar THEN false END AS at_bar,
        CASE WHEN op = '=' THEN v <= 0.01 WHEN op = '<' AND v <= 0.01 THEN true WHEN op = '>' AND v >= 0.01 THEN false END AS strict,
        CASE WHEN op = '=' THEN v <= 0.05 WHEN op = '<' AND v <= 0.05 THEN true WHEN op = '>' AND v >= 0.05 THEN false END AS loose FROM a),
      m AS (SELECT *, CASE WHEN ni THEN NULL WHEN bar IS NOT NULL THEN at_bar WHEN strict AND loose THEN true WHEN NOT strict AND NOT loose THEN false END AS met FROM s)
    SELECT l_orderkey, CASE WHEN bool_or(ni) THEN 'UNREADABLE' WHEN coalesce(bool_or(met), false) AND coalesce(bool_or(NOT met), false) THEN 'MIXED' WHEN coalesce(bool_or(met), false) THEN 'MET' WHEN coalesce(bool_or(NOT met), false) THEN 'MISSED' ELSE 'UNREADABLE' END AS verdict,
      count(met) AS n_considered, count(*) FILTER (NOT ni AND met IS NULL) AS n_undecided, count(*) FILTER (ni) AS n_non_inferiority FROM m GROUP BY l_orderkey""",
)
def read_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.read_analyses(posted(spark, sf_dir), "l_orderkey").select("l_orderkey", "verdict", "n_considered", "n_undecided", "n_non_inferiority")


@query("m01_significant", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(l_discount, 2) <= 0.05 WHEN 1 THEN CASE WHEN round(l_discount, 2) <= 0.05 THEN true END ELSE CASE WHEN l_linenumber % 4 = 2 OR round(l_discount, 2) >= 0.05 THEN false END END AS significant FROM lineitem")
def significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.with_p_value(table(spark, sf_dir, "lineitem"), raw_p(F.col("l_linenumber"), F.col("l_discount")))
    return rows.select("l_orderkey", "l_linenumber", results.significant(F.col("p.value"), F.col("p.op"), F.lit(0.05)).alias("significant"))


@query("m09_first_statement", "SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 0 ELSE NULL END::INTEGER AS place FROM conversations")
def first_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.first_statement([F.col("text"), F.col("role")], r"\?")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found["place"].alias("place"))
