"""Families B, C and K on stop reasons and labels as a registry has them. Each order is a record: its number
picks a stop reason from a fixed list, its status and priority stand for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, labels
from .registry import query, table

#: Stop reasons.
REASONS = [
    "lack of efficacy at the interim analysis", "slow accrual; the decision was not related to any safety concern", "sponsor decision, no safety issues were seen",
    "toxicity, and two deaths", "the risk profile exceeds the benefits", "n/a", "placed on clinical hold after an inspection", "not related to any regulatory request; business reasons",
    "due to results of another study of the same drug", "funding was withdrawn", "terminated because benefits did not outweigh the risks", "adverse events were not the cause, but safety was",
    "unfavorable benefit-risk, shared with the fda", "low recruitment", "futility", "stopped as the parent program was closed; no efficacy was shown here",
]
LIST = "[" + ", ".join(f"'{r}'" for r in REASONS) + "]"
REC = f"r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey, ({LIST})[o_orderkey % 16 + 1] AS reason FROM orders)"
#: Outcome, primary and secondary reasons of a record.
LABELLED = f"""{REC}, l AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'BIOLOGICAL' WHEN 1 THEN 'MIXED' WHEN 2 THEN 'UNRESOLVED_REVIEW' WHEN 3 THEN NULL ELSE 'OPERATIONAL' END AS outcome,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SAFETY' ELSE 'ACCRUAL' END AS prim, CASE o_orderkey % 7 WHEN 0 THEN ['EFFICACY'] WHEN 1 THEN ['FUNDING', 'SAFETY'] WHEN 2 THEN NULL ELSE [] END AS second FROM r)"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("o_orderkey") % len(REASONS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey", picked.alias("reason"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = F.when(k % 5 == 0, "BIOLOGICAL").when(k % 5 == 1, "MIXED").when(k % 5 == 2, "UNRESOLVED_REVIEW").when(k % 5 == 4, "OPERATIONAL")
    second = F.when(k % 7 == 0, F.array(F.lit("EFFICACY"))).when(k % 7 == 1, F.array(F.lit("FUNDING"), F.lit("SAFETY"))).when(k % 7 > 2, F.array().cast("array<string>"))
    return reasons(spark, sf_dir).withColumns({"outcome": outcome, "prim": F.when(k % 3 == 0, "SAFETY").otherwise("ACCRUAL"), "second": second})


def _any(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


BIO_SQL = "coalesce(outcome = 'BIOLOGICAL' OR (outcome = 'MIXED' AND list_has_any(coalesce(second, []), ['EFFICACY', 'SAFETY'])), false)"
BIO_ANY_SQL = "coalesce(outcome = 'BIOLOGICAL' OR (outcome = 'MIXED' AND list_has_any(list_append(coalesce(second, []), prim), ['EFFICACY', 'SAFETY'])), false)"


def _bio(primary: bool = False) -> Column:
    return labels.biological(F.col("outcome"), F.col("second"), F.col("prim") if primary else None)


@query("b18_reason_priority", f"WITH {REC} SELECT o_orderkey, coalesce(CASE WHEN reason <> 'n/a' THEN reason END, CASE WHEN o_orderstatus = 'F' THEN 'override' END, CASE WHEN contains(o_orderpriority, '-') THEN regexp_extract(o_orderpriority, '^.*-(.*)$', 1) END) AS reason FROM r")
def reason_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import after_last

    own = F.when(~classify.is_placeholder(F.col("reason")), F.col("reason"))
    return reasons(spark, sf_dir).select("o_orderkey", F.coalesce(own, F.when(F.col("o_orderstatus") == "F", "override"), after_last(F.col("o_orderpriority"), "-")).alias("reason"))


FIRST_SQL = "CASE WHEN outcome NOT LIKE 'UNRESOLVED%' THEN outcome END"


@query("b20_outcome", f"WITH {LABELLED} SELECT o_orderkey, coalesce({FIRST_SQL}, prim, 'UNKNOWN') AS outcome FROM l")
def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("o_orderkey", labels.first_label(F.col("outcome"), F.col("prim"))["label"].alias("outcome"))


@query("b21_category", f"WITH {LABELLED} SELECT o_orderkey, CASE WHEN outcome IS NULL OR outcome LIKE 'UNRESOLVED%' THEN 'UNSPECIFIED' ELSE outcome END AS category FROM l")
def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("o_orderkey", labels.category(F.col("outcome")).alias("category"))


@query("b11_phase_numbers", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '3' END AS phases FROM orders")
def phase_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{2} for phase 2 without 3, {3} wherever phase 3 stands, else nothing."""
    given = F.element_at(F.array(F.array(F.lit("PHASE1")), F.array(F.lit("PHASE1"), F.lit("PHASE2")), F.array(F.lit("PHASE2"), F.lit("PHASE3")), F.array(F.lit("PHASE3"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    three, two = F.array_contains(given, "PHASE3"), F.array_contains(given, "PHASE2")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(three, "3").when(two, "2").otherwise("").alias("phases"))


@query("b15_condition_key", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'covid-19' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) END AS key FROM part")
def condition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions by a key without case and marks; the spellings of one disease are one."""
    raw = F.when(F.col("p_partkey") % 6 == 0, "SARS-CoV-2 Infection").when(F.col("p_partkey") % 6 == 3, "COVID 19").otherwise(F.col("p_name"))
    plain = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(plain.rlike(r"^(?:covid ?19|sars cov 2|coronavirus)\b"), "covid-19").otherwise(plain).alias("key"))


@query("b08_search_blob", "SELECT o_orderkey, lower(array_to_string(list_filter([c_name, o_orderpriority, o_orderstatus, c_mktsegment], lambda x: x <> 'F'), ' / ')) AS blob FROM orders JOIN customer ON o_custkey = c_custkey")
def search_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    parts = ["c_name", "o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), "c_mktsegment"]
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", F.lower(F.concat_ws(" / ", *parts)).alias("blob"))


@query("c02_joined_types", "SELECT p_partkey FROM part WHERE contains(lower(p_type || '; ' || p_brand), 'brand#1')")
def joined_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.contains(F.lower(F.concat_ws("; ", "p_type", "p_brand")), F.lit("brand#1"))).select("p_partkey")


@query("c08_fall_through", f"WITH {LABELLED} SELECT o_orderkey, coalesce({FIRST_SQL}, CASE WHEN o_orderkey % 2 = 0 THEN prim END, o_orderstatus) AS label, CASE WHEN {FIRST_SQL} IS NOT NULL THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END::INTEGER AS level FROM l")
def fall_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.first_label(F.col("outcome"), F.when(F.col("o_orderkey") % 2 == 0, F.col("prim")), F.col("o_orderstatus"))
    return labelled(spark, sf_dir).select("o_orderkey", found.alias("f")).select("o_orderkey", "f.label", "f.level")


@query("c09_required_fields", f"WITH {LABELLED} SELECT o_orderkey FROM l WHERE outcome IS NOT NULL AND second IS NOT NULL AND len(second) > 0 AND reason <> ''")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where(labels.all_filled(F.col("outcome"), F.array_join("second", ","), F.col("reason"))).select("o_orderkey")


@query("c11_type_area_phase", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment IN ('BUILDING', 'FURNITURE') AND contains(lower(o_orderpriority), 'medium')")
def type_area_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(c, "o_custkey")
    return rows.where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE") & F.contains(F.lower("o_orderpriority"), F.lit("medium"))).select("o_orderkey")


@query("c12_biological_or_keyword", f"WITH {LABELLED} SELECT o_orderkey FROM l WHERE {BIO_SQL} OR regexp_matches(reason, 'futility|efficacy')")
def biological_or_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where(_bio() | F.col("reason").rlike("futility|efficacy")).select("o_orderkey")


@query("c13_biological_secondary", f"WITH {LABELLED} SELECT o_orderkey, {BIO_SQL} AS hit FROM l")
def biological_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("o_orderkey", _bio().alias("hit"))


@query("c19_biological_any", f"WITH {LABELLED} SELECT o_orderkey, {BIO_ANY_SQL} AS hit FROM l")
def biological_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("o_orderkey", _bio(primary=True).alias("hit"))


@query("c16_label_or_bucket", f"WITH {LABELLED} SELECT o_orderkey FROM l WHERE regexp_matches(coalesce(outcome, ''), 'BIOLOGICAL|SCIENTIFIC_FAILURE') OR prim = 'EFFICACY' OR list_contains(coalesce(second, []), 'EFFICACY')")
def label_or_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.array_contains(F.coalesce("second", F.array().cast("array<string>")), "EFFICACY") | (F.col("prim") == "EFFICACY")
    return labelled(spark, sf_dir).where(F.coalesce("outcome", F.lit("")).rlike("BIOLOGICAL|SCIENTIFIC_FAILURE") | bucket).select("o_orderkey")


@query("c17_resolved_or_bucket", f"WITH {LABELLED} SELECT o_orderkey FROM l WHERE ({FIRST_SQL} = 'BIOLOGICAL') OR prim IN ('EFFICACY', 'SAFETY')")
def resolved_or_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = labels.first_label(F.col("outcome"))["label"] == "BIOLOGICAL"
    return labelled(spark, sf_dir).where(resolved | F.col("prim").isin(*labels.BIOLOGICAL_REASONS)).select("o_orderkey")


@query("c20_label_rule", f"WITH {LABELLED} SELECT o_orderkey, outcome IN ('BIOLOGICAL', 'MIXED') AND prim IN ('SAFETY') AS positive FROM l WHERE outcome IS NOT NULL")
def label_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = F.col("outcome").isin("BIOLOGICAL", "MIXED") & F.col("prim").isin("SAFETY")
    return labelled(spark, sf_dir).where("outcome is not null").select("o_orderkey", positive.alias("positive"))


@query("c22_leaked_ids", f"WITH {REC}, seen AS (SELECT DISTINCT reason FROM r WHERE o_orderkey % 50 = 0), c AS (SELECT o_custkey FROM r WHERE o_orderkey % 50 = 0) SELECT o_orderkey FROM r WHERE o_orderkey % 50 > 0 AND (reason IN (SELECT reason FROM seen) OR o_custkey IN (SELECT o_custkey FROM c))")
def leaked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share a text or a unit with the training part."""
    r = reasons(spark, sf_dir)
    known, rest = r.where("o_orderkey % 50 = 0"), r.where("o_orderkey % 50 > 0")
    by = lambda c: rest.join(known.select(c).distinct(), c, "left_semi").select("o_orderkey")
    return by("reason").union(by("o_custkey")).distinct()


@query("k07_benefit_risk", f"WITH {REC} SELECT o_orderkey, reason || CASE WHEN regexp_matches(reason, '{_any(labels.UNFAVOURABLE)}') THEN ' benefit_risk_unfavorable' ELSE '' END AS t FROM r")
def benefit_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", labels.with_benefit_risk(F.col("reason")).alias("t"))


BUCKETS, KEYWORDS = {"1-URGENT": "SAFETY", "2-HIGH": "EFFICACY"}, {"accrual|recruitment": "ENROLLMENT", "fund|business": "BUSINESS", "efficacy|futility": "EFFICACY"}


@query("k13_core_buckets", f"WITH {REC} SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'SAFETY' WHEN '2-HIGH' THEN 'EFFICACY' ELSE CASE WHEN regexp_matches(reason, 'accrual|recruitment') THEN 'ENROLLMENT' WHEN regexp_matches(reason, 'fund|business') THEN 'BUSINESS' WHEN regexp_matches(reason, 'efficacy|futility') THEN 'EFFICACY' ELSE 'OTHER' END END AS bucket FROM r")
def core_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", labels.core_bucket(F.col("o_orderpriority"), BUCKETS, F.col("reason"), KEYWORDS).alias("bucket"))


def _stated_sql(word: str, what: str) -> str:
    """Clauses with the word, and of them those in which something before it governs it."""
    found = f"list_filter(string_split_regex(reason, '{labels.CLAUSE_BREAK}'), lambda c: regexp_matches(c, '{word}'))"
    denied = f"list_filter({found}, lambda c: regexp_matches(regexp_extract(c, '^(.*?){word}', 1), '{labels.GOVERNS}'))"
    return {"stated": f"(len({found}) - len({denied}))", "denied": f"len({denied})"}[what]


@query("k15_denied_matches", f"WITH {REC} SELECT o_orderkey, {_stated_sql(labels.SAFETY_WORD, 'denied')} AS denied FROM r")
def denied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", labels.stated_and_denied(F.col("reason"), labels.SAFETY_WORD)["denied"].alias("denied"))


@query("k16_affirmed_safety", f"WITH {REC} SELECT o_orderkey, {_stated_sql(labels.SAFETY_WORD, 'stated')} > 0 AS affirmed FROM r")
def affirmed_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", labels.affirms_safety(F.col("reason")).alias("affirmed"))


CASCADE, OWN = r"another study|parent program", r"efficacy|futility|toxicity|safety"


@query("k18_attribution", f"WITH {REC} SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 7 THEN 'CASCADE' WHEN {_stated_sql(CASCADE, 'stated')} > 0 THEN 'CASCADE' WHEN {_stated_sql(OWN, 'stated')} > 0 THEN 'OWN_DATA' WHEN o_orderstatus = 'F' THEN 'CASCADE' ELSE 'UNCLEAR' END AS verdict, CASE WHEN o_orderkey % 40 = 7 THEN 'reviewed' WHEN {_stated_sql(CASCADE, 'stated')} > 0 OR {_stated_sql(OWN, 'stated')} > 0 THEN 'textual' WHEN o_orderstatus = 'F' THEN 'structural' END AS basis FROM r")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    siblings, reviewed = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.when(F.col("o_orderkey") % 40 == 7, "CASCADE")
    return reasons(spark, sf_dir).select("o_orderkey", labels.attribution(F.col("reason"), CASCADE, OWN, siblings, reviewed).alias("a")).select("o_orderkey", "a.*")


LEGACY = {"F": ("EFFICACY", "efficacy|futility"), "O": ("OPERATIONAL", "accrual|recruitment|fund")}


@query("k20_second_scheme", f"WITH {REC} SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'EFFICACY' WHEN 'O' THEN 'OPERATIONAL' ELSE 'UNKNOWN' END AS code, (o_orderstatus = 'F' AND regexp_matches(reason, 'efficacy|futility')) OR (o_orderstatus = 'O' AND regexp_matches(reason, 'accrual|recruitment|fund')) AS confirmed FROM r")
def second_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", labels.second_scheme(F.col("o_orderstatus"), F.col("reason"), LEGACY).alias("s")).select("o_orderkey", "s.*")


@query("k21_tolerated", f"WITH {LABELLED} SELECT CASE WHEN outcome IS NOT DISTINCT FROM CASE WHEN {BIO_SQL} THEN 'BIOLOGICAL' ELSE 'OPERATIONAL' END THEN 'equal' WHEN outcome = 'MIXED' AND {BIO_SQL} THEN 'tolerated' ELSE 'wrong' END AS verdict, count(*) AS n FROM l GROUP BY 1")
def tolerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.when(_bio(), "BIOLOGICAL").otherwise("OPERATIONAL")
    return labelled(spark, sf_dir).groupBy(labels.tolerated(F.col("outcome"), got, [("MIXED", "BIOLOGICAL")]).alias("verdict")).agg(F.count("*").alias("n"))


@query("k23_bucket_or_keyword", f"WITH {REC} SELECT count(*) FILTER (o_orderpriority = '1-URGENT' OR regexp_matches(reason, 'accrual|recruit')) AS enrolment FROM r")
def bucket_or_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).agg(F.count_if((F.col("o_orderpriority") == "1-URGENT") | F.col("reason").rlike("accrual|recruit")).alias("enrolment"))


@query("k24_conflicts", f"WITH {LABELLED} SELECT o_orderkey, CASE WHEN outcome IS NULL THEN 'no label' WHEN outcome LIKE 'UNRESOLVED%' THEN 'in review' WHEN outcome = 'BIOLOGICAL' AND prim = 'ACCRUAL' AND {BIO_SQL} AND len(coalesce(second, [])) = 0 THEN 'primary only' WHEN outcome = 'MIXED' THEN 'mixed' ELSE 'plain' END AS why FROM l")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, none = F.col("outcome"), F.size(F.coalesce("second", F.array().cast("array<string>"))) == 0
    why = classify.decide([(o.isNull(), F.lit("no label")), (F.startswith(o, F.lit("UNRESOLVED")), F.lit("in review")), ((o == "BIOLOGICAL") & (F.col("prim") == "ACCRUAL") & _bio() & none, F.lit("primary only")), (o == "MIXED", F.lit("mixed"))], F.lit("plain"))
    return labelled(spark, sf_dir).select("o_orderkey", why.alias("why"))


@query("k25_regulatory_denials", f"WITH {REC} SELECT o_orderkey, regexp_matches(reason, '{_any(labels.REGULATORY_DENIALS)}') AS denied FROM r")
def regulatory_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", labels.any_match(F.col("reason"), labels.REGULATORY_DENIALS).alias("denied"))


@query("k26_regulatory_cues", f"WITH {REC} SELECT o_orderkey, ({' OR '.join(f'''contains(reason, '{c}')''' for c in labels.REGULATORY_CUES)}) AS cue, ({' OR '.join(f'''contains(reason, '{c}')''' for c in labels.REGULATORY_CUES)}) AND NOT regexp_matches(reason, '{_any(labels.REGULATORY_DENIALS)}') AS cause FROM r")
def regulatory_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("reason")
    return reasons(spark, sf_dir).select("o_orderkey", labels.any_contained(t, labels.REGULATORY_CUES).alias("cue"), labels.regulatory(t).alias("cause"))


@query("k27_placeholders", f"WITH {REC} SELECT o_orderkey, reason = 'n/a' OR o_orderkey % 9 = 0 AS placeholder FROM r")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("o_orderkey") % 9 == 0, " Unknown. ").otherwise(F.col("reason"))
    return reasons(spark, sf_dir).select("o_orderkey", classify.is_placeholder(blank).alias("placeholder"))


@query("k03_negated", f"WITH {REC} SELECT o_orderkey, (reason = 'futility')::BIGINT AS safety_concern_or_futility FROM r")
def negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("reason")
    n = classify.occurrences(t, "safety concern") + classify.occurrences(t, "futility")
    return reasons(spark, sf_dir).select("o_orderkey", n.cast("long").alias("safety_concern_or_futility"))


@query("k04_causes", f"WITH {REC} SELECT o_orderkey, (reason LIKE 'due to results of another study%')::BIGINT AS n FROM r")
def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", classify.near_cause(F.col("reason"), "another study").cast("long").alias("n"))


@query("k06_denials", f"WITH {REC} SELECT o_orderkey, o_orderkey % 16 IN (1, 2) AS no_safety, false AS no_efficacy FROM r")
def denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("reason")
    return reasons(spark, sf_dir).select("o_orderkey", classify.denies(t, ("safety concern", "safety issue")).alias("no_safety"), classify.denies(t, ("futility",)).alias("no_efficacy"))


@query("k28_confirmed_sentence", f"WITH {REC} SELECT o_orderkey, o_orderkey % 16 = 14 AS kept FROM r WHERE o_orderkey % 16 IN (13, 14)")
def confirmed_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored sentence is classified again; it stays only if that gives the stored label with a stated confidence."""
    rows = reasons(spark, sf_dir).where("o_orderkey % 16 in (13, 14)").withColumn("c", classify.classify_reason(F.col("reason")))
    return rows.select("o_orderkey", ((F.col("c.label") == "BIOLOGICAL_FAILURE") & F.col("c.confidence").isin("HIGH", "MEDIUM")).alias("kept"))


@query("j21_strict_sentences", "WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s)::INTEGER AS n, coalesce(length(s[1]), 0)::INTEGER AS first_chars FROM s")
def strict_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.strict_sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.coalesce(F.length(F.get(s, 0)), F.lit(0)).alias("first_chars"))


@query(
    "j22_sentence_around",
    "WITH p AS (SELECT doc_id, text, instr(text, ' the ') AS place FROM documents) SELECT doc_id, CASE WHEN place > 0 THEN substring(trim(regexp_extract(substring(text, 1, place - 1), '([^.!?]*)\\z', 1) || regexp_extract(substring(text, place), '\\A([^.!?]*[.!?]?)', 1)), 1, 220) END AS sentence FROM p",
)
def sentence_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.sentence_around(F.col("text"), F.instr("text", " the ")).alias("sentence"))
