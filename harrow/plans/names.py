"""Family J on names as a registry spells them: interventions and organisations made from parts and
customers, stop reasons from a fixed list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from .registry import query, table

#: An intervention's name by the part's number: dose, code, combination, salt, placebo, list.
DRUGS = """drugs AS (SELECT p_partkey, CASE p_partkey % 6
    WHEN 0 THEN w[1] || ' 50 mg Tablets' WHEN 1 THEN w[1] || ' (AB-' || (1000 + p_partkey) || ') injection' WHEN 2 THEN w[1] || ' + ' || w[2]
    WHEN 3 THEN upper(w[1]) || '® Hydrochloride 2.5 mg/ml' WHEN 4 THEN 'Placebo' ELSE w[1] || ', ' || upper(w[1]) || ' and ' || w[2] END AS name
  FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))"""


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (F.get(F.split("p_name", " "), i) for i in (0, 1))
    forms = [
        F.concat(first, F.lit(" 50 mg Tablets")), F.concat(first, F.lit(" (AB-"), (1000 + F.col("p_partkey")).cast("string"), F.lit(") injection")), F.concat(first, F.lit(" + "), second),
        F.concat(F.upper(first), F.lit("® Hydrochloride 2.5 mg/ml")), F.lit("Placebo"), F.concat(first, F.lit(", "), F.upper(first), F.lit(" and "), second),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int")).alias("name"))


FORMS = "injection|tablet|tablets|capsule|capsules|oral|intravenous|iv|infusion|solution|cream|gel|low dose|high dose|hydrochloride|hcl|mesylate|maleate|tosylate|sodium|citrate|acetate"


@query("j02_review_key", r"SELECT conv_id, turn, trim(regexp_replace(lower(replace('&lt;' || text || '&amp;', '&lt;', '<')), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT conv_id, turn, strip_accents(text) AS text FROM conversations)".replace("|| '&amp;'", "|| '&'"))
def review_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", names.review_key(F.concat(F.lit("&lt;"), "text", F.lit("&amp;"))).alias("key"))


@query("j04_sha1_prefix", "SELECT doc_id, substring(sha1(source || lang), 1, 12) AS h FROM documents")
def sha1_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.short_hash(F.concat("source", "lang"), "sha1", 12).alias("h"))


ORGANISATIONS = ["{} Inc.", "{} GmbH & Co. KG", "Société {} (Holding) S.p.A.", "{}, Incorporated", "{} KGaA", "{} Pty. Ltd.", "{} A/S", "{} Research Institute"]
ENDINGS = "inc|llc|ltd|limited|corp|corporation|co|company|gmbh|ag|sa|plc|bv|nv|ab|as|spa|srl|kg|incorporated|se|kgaa|oy|kk|pty|lp|llp"


def _strip(sql: str, times: int) -> str:
    for _ in range(times):
        sql = f"regexp_replace({sql}, ' ({ENDINGS})$', '')"
    return sql


@query(
    "j06_organisation_key",
    f"""WITH o AS (SELECT c_custkey, replace((ARRAY[{', '.join(f"'{x}'" for x in ORGANISATIONS)}])[c_custkey % 8 + 1], '{{}}', c_name) AS name FROM customer),
        p AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(name, 'é', 'e')), '\\([^)]*\\)', ' ', 'g'), '[.,'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM o)
        SELECT c_custkey, {_strip('k', 3)} AS key FROM p""",
)
def organisation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, ORGANISATIONS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.organisation_key(F.replace(form, F.lit("{}"), F.col("c_name"))).alias("key"))


@query("j07_codes", "SELECT DISTINCT o_orderpriority, upper(regexp_replace(trim('  ' || o_orderpriority || '/' || o_orderstatus || ' '), '[\\s/-]+', '_', 'g')) AS code FROM orders")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "o_orderpriority", F.lit("/"), "o_orderstatus", F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderpriority", text.code_of(raw).alias("code")).distinct()


@query("j08_slug", "SELECT p_partkey, trim(regexp_replace(lower('(' || p_type || ') ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat(F.lit("("), "p_type", F.lit(") "), "p_name", F.lit("!"))).alias("slug"))


@query(
    "j09_drug_key",
    f"""WITH {DRUGS}, a AS (SELECT p_partkey, regexp_replace(lower(name), '\\([^)]*\\)|\\[[^\\]]*\\]|[®™]', ' ', 'g') AS t FROM drugs),
        b AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '\\b[0-9]+(\\.[0-9]+)?\\s*(mg|mcg|ml|g|iu|%)(/[a-z0-9]+)?', ' ', 'g'), '\\b({FORMS})\\b', ' ', 'g') AS t FROM a),
        c AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '^[\\s,.;:-]+|[\\s,.;:-]+$', '', 'g') AS t FROM b)
        SELECT p_partkey, CASE WHEN length(t) >= 3 AND NOT regexp_matches(t, '[+/,;&]| (and|plus|with|or|versus|vs) ') AND t <> 'placebo' THEN t END AS key FROM c""",
)
def drug_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drugs(spark, sf_dir).select("p_partkey", names.drug_key(F.col("name")).alias("key"))


@query(
    "j10_clean_drug",
    f"""WITH {DRUGS}, a AS (SELECT p_partkey, regexp_replace(regexp_replace(replace(name, '®', ''), '\\([^)]*\\)', ' ', 'g'), '(?i)\\b({FORMS}|dose level [0-9]+)\\b', ' ', 'g') AS t FROM drugs)
        SELECT p_partkey, regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '^[ ,;-]+|[ ,;-]+$', '', 'g') AS name FROM a""",
)
def clean_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drugs(spark, sf_dir).select("p_partkey", names.clean_drug(F.col("name")).alias("name"))


@query(
    "j11_candidates",
    f"""WITH {DRUGS}, q AS (SELECT p_partkey, i, trim(string_split_regex(name, '(?i)[;,/+]|\\s+(plus|and|with)\\s+')[i]) AS piece FROM (SELECT *, unnest(range(1, len(string_split_regex(name, '(?i)[;,/+]|\\s+(plus|and|with)\\s+')) + 1)) AS i FROM drugs)),
        s AS (SELECT p_partkey, i * 3 AS pos, piece AS c FROM q UNION ALL SELECT p_partkey, i * 3 + 1, trim(regexp_extract(piece, '\\(([^)]+)\\)', 1)) FROM q UNION ALL SELECT p_partkey, i * 3 + 2, trim(regexp_replace(piece, '\\([^)]*\\)', ' ', 'g')) FROM q),
        f AS (SELECT p_partkey, lower(c) AS k, min(pos) AS pos, arg_min(c, pos) AS c FROM s WHERE length(c) >= 3 GROUP BY ALL)
        SELECT p_partkey, string_agg(c, '|' ORDER BY pos) AS candidates FROM f GROUP BY p_partkey""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drugs(spark, sf_dir).select("p_partkey", F.array_join(names.candidates(F.array("name")), "|").alias("candidates"))


@query("j12_components", f"WITH {DRUGS}, c AS (SELECT p_partkey, name, list_transform(string_split_regex(name, '(?i)\\s*\\+\\s*|\\s+(plus|and|with)\\s+'), lambda x: trim(x)) AS parts FROM drugs) SELECT p_partkey, CASE WHEN len(parts) > 1 AND list_min(list_transform(parts, lambda x: length(x))) >= 3 THEN array_to_string(parts, '|') ELSE name END AS parts FROM c")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drugs(spark, sf_dir).select("p_partkey", F.array_join(names.components(F.col("name")), "|").alias("parts"))


@query("j13_research_codes", f"WITH {DRUGS} SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(name || ' PHASE 22, see xy 77', '\\b([A-Za-z]{{2,5}}[- ]?[0-9]{{2,7}})\\b', 1), lambda m: upper(replace(m, ' ', '-'))), lambda m: NOT regexp_matches(m, '^(NCT|PHASE|COVID)')))), ',') AS codes FROM drugs")
def research_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drugs(spark, sf_dir).select("p_partkey", F.array_join(names.research_codes(F.concat("name", F.lit(" PHASE 22, see xy 77"))), ",").alias("codes"))


KNOWN, ALIASES = ["RED", "BLUE", "GREEN", "STEEL"], {"METAL": r"copper|brass|\btin\b", "BLUE": r"\bnavy\b"}


@query("j14_genes", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split_regex(upper(t), '[^A-Z0-9-]+'), lambda x: x IN ('RED', 'BLUE', 'GREEN', 'STEEL')), CASE WHEN regexp_matches(lower(t), 'copper|brass|\\btin\\b') THEN ['METAL'] ELSE [] END, CASE WHEN regexp_matches(lower(t), '\\bnavy\\b') THEN ['BLUE'] ELSE [] END))), ',') AS genes FROM (SELECT p_partkey, p_name || '; ' || p_type AS t FROM part)")
def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.genes(F.concat_ws("; ", "p_name", "p_type"), KNOWN, ALIASES), ",").alias("genes"))


MONTH = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%dT00:00') END"


@query("j30_prefix_dates", f"SELECT o_orderkey, try_strptime(CASE length({MONTH}) WHEN 4 THEN {MONTH} || '-01-01' WHEN 7 THEN {MONTH} || '-01' ELSE substring({MONTH}, 1, 10) END, '%Y-%m-%d')::DATE AS day FROM orders")
def prefix_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy")).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.partial_date(raw).alias("day"))


@query("j16_month_distance", "SELECT o_orderkey, CASE WHEN m >= 0 THEN m::INTEGER END AS months FROM (SELECT o_orderkey, (2000 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) AS m FROM orders)")
def month_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.calendar_months(F.col("o_orderdate"), F.lit("2000-06-15").cast("date")).alias("months"))


@query("j19_unescaped", r"SELECT p_partkey, trim(regexp_replace(regexp_replace('\[HR\]  ' || replace(p_name, ' ', ' \< ') || ' \#1', '\\([\[\]<>*_()#~`])', '\1', 'g'), '\s+', ' ', 'g')) AS t FROM part")
def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\\[HR\\]  "), F.replace("p_name", F.lit(" "), F.lit(" \\< ")), F.lit(" \\#1"))
    return table(spark, sf_dir, "part").select("p_partkey", names.unescaped(raw).alias("t"))


@query("j25_query_string", "SELECT o_orderkey, '?phase=' || replace(replace(o_orderpriority, ' ', '+'), '-', '-') || CASE WHEN o_orderstatus = 'F' THEN '%2CF' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '&q=a+b%26c' ELSE '' END AS qs FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '?q=a+b%26c' ELSE '' END FROM orders WHERE o_orderkey % 5 = 0")
def query_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = F.when(F.col("o_orderkey") % 5 > 0, F.array_compact(F.array("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "F"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.query_string({"phase": phases}, {"q": F.when(F.col("o_orderkey") % 2 == 0, "a b&c").otherwise("")}).alias("qs"))


@query("j27_phase_label", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Phase 1/2' WHEN 2 THEN 'Phase 3' ELSE 'Phase 1' END AS label FROM orders")
def phase_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array(F.array(F.lit("NA")), F.array(F.lit("PHASE2"), F.lit("EARLY_PHASE1"), F.lit("PHASE2")), F.array(F.lit("PHASE3")), F.array(F.lit("EARLY_PHASE1"), F.lit("PHASE1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.phase_label(F.element_at(lists, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("label"))


@query("j31_url_paths", "SELECT p_partkey, '/drug/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS path FROM part")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/drug/"), text.slug(F.col("p_name"))).alias("path"))


MODALITIES = {r"\bantibody[- ]drug conjugates?\b": "adc", r"\bbox(?:es)?\b": "box", r"\bplated\b": "plating"}


@query("j33_split_modality", "WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Plated' ELSE p_type || ' Boxes' END AS q FROM part) SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN q ELSE trim(regexp_replace(regexp_replace(q, '(?i)\\bbox(es)?\\b', ' ', 'g'), '\\s+', ' ', 'g')) END AS rest, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'box' END AS modality FROM q")
def split_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("p_partkey") % 7 == 0, "Plated").otherwise(F.concat("p_type", F.lit(" Boxes")))
    m = names.split_modality(q, MODALITIES)
    return table(spark, sf_dir, "part").select("p_partkey", m["rest"].alias("rest"), m["modality"].alias("modality"))


@query("j34_ellipsis", r"SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substring(t, 1, 79)) || '…' ELSE t END AS t FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t FROM documents)")
def ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clipped(F.col("text"), 80).alias("t"))


def _sentence(c: Column) -> Column:
    return text.first_sentence(F.regexp_replace(c, r"^\[[a-z ]+\]\s*", ""))


@query("j29_first_sentence", r"SELECT conv_id, turn, substring(trim(regexp_extract(trim(text), '^((?s:.)*?[.!?])(\s|$)', 1)), 1, 700) AS s FROM conversations WHERE regexp_matches(trim(text), '[.!?](\s|$)')")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.trim("text").rlike(r"[.!?](?:\s|$)"))
    return c.select("conv_id", "turn", _sentence(F.concat(F.lit("[source tag] "), F.trim("text"))).alias("s"))


@query("l01_variants", f"WITH {DRUGS}, v AS (SELECT p_partkey, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS b FROM drugs), c AS (SELECT p_partkey, unnest([b, trim(regexp_replace(regexp_replace(b, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')), regexp_extract(b, '\\(([^)]*)\\)', 1), regexp_replace(b, '[ -]', '', 'g')]) AS v, unnest([1, 2, 3, 4]) AS i FROM v), d AS (SELECT p_partkey, v, min(i) AS i FROM c WHERE length(v) >= 3 GROUP BY ALL) SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS variants FROM d GROUP BY p_partkey")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drugs(spark, sf_dir).select("p_partkey", F.array_join(text.name_variants(F.col("name")), "|").alias("variants"))
