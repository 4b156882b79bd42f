"""Families K and M on generated texts: an order's number picks lead, link, cause and tail of its stop reason, so that causes,
negations and clause ends stand in all positions; a part of the records has a short reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.spans import spans
from ..operators import classify, dispositions, reading
from .registry import query, table

LEADS = ["the study was stopped", "Sponsor terminated the trial", "terminated early", "enrolment was slow and the trial was closed", "the trial was not stopped", "development ended"]
LINKS = [" due to ", " because of ", ", not due to ", " but not because of any ", "; there were no ", ", without ", "; ", " and "]
CAUSES = [
    "safety concerns", "lack of efficacy", "toxicity in the treatment arm", "a regulatory request", "two deaths", "business reasons", "results of another study", "the interim analysis",
    "insufficient data", "an unfavourable benefit-risk balance", "liver enzyme elevations", "the closure of a site", "a clinical hold by the fda", "risks that outweigh the benefits",
]
TAILS = [
    "", ".", "; safety findings were consistent with prior data", ". no new safety issues were identified", ", however adverse events were reported", ". the sponsor decided", ". no request from the regulator was received",
    " were not a factor", ". benefits do not outweigh the risks", ". NCT00000000 was stopped", "; review pending", ". it did not meet its primary endpoint",
]
SHORT = [
    "", "n/a", "sponsor decision", "business reasons", "study terminated", "the risk profile exceeds any benefit", "duplicate registration", "poor retention", "completed", "pi left", "Administrative reasons.", "closed with no further notice by anyone concerned",
    "audit findings", "no longer pursuing this", "difficulties to enrol", "ind was withdrawn", "transitioned to an extension study", "owing to costs and priorities", "Not approved by the ethics committee",
]


def _pick(items: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), F.expr(f"cast({number} % {len(items)} + 1 as int)"))


def _sql(items: list[str], number: str) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + f"][{number} % {len(items)} + 1]"


REASON = f"CASE WHEN o_orderkey % 5 = 4 THEN {_sql(SHORT, '(o_orderkey // 5)')} ELSE {_sql(LEADS, 'o_orderkey')} || {_sql(LINKS, '(o_orderkey // 3)')} || {_sql(CAUSES, '(o_orderkey // 7)')} || {_sql(TAILS, '(o_orderkey // 11)')} END"
#: reason as written, and t: its normalised form.
REC = f"r AS (SELECT o_orderkey, o_orderkey AS k, {REASON} AS reason, lower(trim(regexp_replace({REASON}, '\\s+', ' ', 'g'))) AS t FROM orders)"


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(_pick(LEADS, "o_orderkey"), _pick(LINKS, "o_orderkey div 3"), _pick(CAUSES, "o_orderkey div 7"), _pick(TAILS, "o_orderkey div 11"))
    reason = F.when(F.col("o_orderkey") % 5 == 4, _pick(SHORT, "o_orderkey div 5")).otherwise(whole)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), reason.alias("reason")).withColumn("t", text.normalized(F.col("reason")))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


#: Matches with what stands before and behind them, up to the clause's ends.
SAFETY_SQL = f"""{REC}, m AS (SELECT o_orderkey, string_split_regex(reason, '{reading.SAFETY_WORD}') AS b, regexp_extract_all(reason, '{reading.SAFETY_WORD}') AS h FROM r),
  u AS (SELECT o_orderkey, b, h, unnest(range(1, len(h) + 1)) AS i FROM m),
  c AS (SELECT o_orderkey, array_to_string(list_transform(range(1, i + 1), lambda j: b[j] || CASE WHEN j < i THEN h[j] ELSE '' END), '') AS head,
               array_to_string(list_transform(range(i + 1, len(b) + 1), lambda j: b[j] || CASE WHEN j <= len(h) THEN h[j] ELSE '' END), '') AS rest, h[i] AS word FROM u),
  d AS (SELECT *, regexp_matches(string_split_regex(head, '{reading.CLAUSE_BREAK}')[-1], '{reading.GOVERNS}') OR regexp_matches(string_split_regex(rest, '{reading.CLAUSE_BREAK}')[1], '{reading.DENIED_BEHIND}') AS denied FROM c)"""


@query("k15_denied_places", f"WITH {SAFETY_SQL} SELECT o_orderkey, length(head)::INTEGER AS start, (length(head) + length(word))::INTEGER AS end_, denied FROM d")
def denied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each safety word of a reason: its place, and whether it stands in a denial of its clause."""
    found = F.transform(spans(F.col("reason"), reading.SAFETY_WORD), lambda s: F.struct(s.alias("s"), reading.denied(F.col("reason"), s).alias("denied")))
    rows = reasons(spark, sf_dir).select("o_orderkey", F.explode(found).alias("m"))
    return rows.select("o_orderkey", F.col("m.s.start").alias("start"), F.col("m.s.end").alias("end_"), "m.denied")


@query("k16_affirms_safety", f"WITH {SAFETY_SQL} SELECT r.o_orderkey, coalesce(bool_or(NOT denied), false) AS affirmed FROM r LEFT JOIN d ON d.o_orderkey = r.o_orderkey GROUP BY 1")
def affirmed_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", reading.affirms(F.col("reason")).alias("affirmed"))


@query("k17_without_ruled_out")
def without_ruled_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons without what they rule out. The patterns look ahead, which SQL's can't: tests hold them against plain Python."""
    return reasons(spark, sf_dir).select("o_orderkey", text.collapse(reading.without_ruled_out(F.col("reason"))).alias("t"))


@query("k18_attribution_evidence")
def attribution_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose finding stopped a record, with the evidence: by the whole rule set (looking around: no SQL), siblings and reviews."""
    k = F.col("k")
    a = reading.attribution(F.col("reason"), F.when(k % 2 == 0, "NCT00000000"), F.when(k % 3 == 0, 1).otherwise(0), F.when(k % 40 == 7, reading.CASCADE))
    return reasons(spark, sf_dir).select("o_orderkey", a.alias("a")).select("o_orderkey", "a.*")


@query("k05_reason_scores")
def reason_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, causes and scores of each dimension in the generated reasons (look-around: tests hold them against plain Python)."""
    t = F.col("t")
    counted = {f"n_{w.replace(' ', '_')}": classify.occurrences(t, w) for w in ("toxicity", "adverse event", "death")} | {f"near_{w}": classify.near_cause(t, w) for w in ("toxicity", "death")}
    denied = {"no_safety": classify.denies(t, classify.SAFETY_WORDS), "no_efficacy": classify.denies(t, classify.EFFICACY_WORDS)}
    scores = {"safety": classify.score(t, classify.SAFETY, F.col("no_safety")), "efficacy": classify.score(t, classify.EFFICACY, F.col("no_efficacy"))}
    return reasons(spark, sf_dir).withColumns(counted | denied).withColumns(scores).drop("k", "reason")


@query("k28_confirmed_reasons")
def confirmed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reasons classified again: a stored label is kept if the rules give it with high confidence."""
    stored = F.when(F.col("k") % 3 == 0, "BIOLOGICAL_FAILURE").when(F.col("k") % 3 == 1, "NON_BIOLOGICAL").otherwise("UNCLEAR")
    c = reasons(spark, sf_dir).select("o_orderkey", stored.alias("stored"), classify.classify_reason(F.col("reason")).alias("c"))
    return c.select("o_orderkey", "stored", "c.label", "c.reason", "c.confidence", ((F.col("c.label") == F.col("stored")) & (F.col("c.confidence") == "HIGH")).alias("kept"))


#: Judged causes: what a plain "due to" tells, with the evidence that must be found and must not.
GOLDEN = {
    "safety concerns": (reading.OWN_DATA, "safety in this trial", "refers to another study"), "lack of efficacy": (reading.OWN_DATA, "efficacy observed in this trial", "safety in this trial"),
    "toxicity in the treatment arm": (reading.OWN_DATA, "an event in this trial", "safety in this trial"), "business reasons": (reading.UNCLEAR, None, "safety in this trial"),
    "results of another study": (reading.CASCADE, "refers to another study", "safety in this trial"), "the interim analysis": (reading.OWN_DATA, "its own interim analysis", "refers to another study"),
    "an unfavourable benefit-risk balance": (reading.OWN_DATA, "this trial's benefit-risk assessment", "safety in this trial"), "the closure of a site": (reading.UNCLEAR, None, "an event in this trial"),
}
GOLDEN_SQL = f"o_orderkey % 5 < 4 AND (o_orderkey // 3) % {len(LINKS)} IN (0, 1) AND o_orderkey % {len(LEADS)} < 3 AND (o_orderkey // 11) % {len(TAILS)} IN (0, 1, 5) AND {_sql(CAUSES, '(o_orderkey // 7)')} IN ({', '.join(repr(c) for c in GOLDEN)})"


@query("p09_golden", f"SELECT count(*) AS cases, 0::BIGINT AS verdicts, 0::BIGINT AS lacking, 0::BIGINT AS wrong FROM orders WHERE {GOLDEN_SQL}")
def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged reasons read again: how many, and how many have another verdict, lack their evidence, or have evidence that they must not have."""
    judged = F.create_map(*[x for c, (v, a, b) in GOLDEN.items() for x in (F.lit(c), F.struct(F.lit(v).alias("v"), F.lit(a).cast("string").alias("a"), F.lit(b).alias("b")))])
    k, cause = F.col("o_orderkey"), _pick(CAUSES, "o_orderkey div 7")
    chosen = (k % 5 < 4) & F.expr(f"(o_orderkey div 3) % {len(LINKS)} in (0, 1)") & (k % len(LEADS) < 3) & F.expr(f"(o_orderkey div 11) % {len(TAILS)} in (0, 1, 5)")
    cases = reasons(spark, sf_dir).where(chosen).withColumn("w", F.element_at(judged, cause)).where("w IS NOT NULL")
    a = cases.select("w", reading.attribution(F.col("reason"), F.lit(""), F.lit(0), F.lit(None).cast("string")).alias("a")).select("w", "a.verdict", F.concat("a.own", "a.elsewhere").alias("e"))
    has = lambda c: F.coalesce(F.array_contains("e", F.col(c)), F.lit(False))
    return a.agg(F.count("*").alias("cases"), F.count_if(F.col("verdict") != F.col("w.v")).alias("verdicts"), F.count_if(F.col("w.a").isNotNull() & ~has("w.a")).alias("lacking"), F.count_if(has("w.b")).alias("wrong"))


def _any_sql(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?is){_q(p)}')" for p in patterns) + ")"


@query("k07_unfavourable_balance", f"WITH {REC} SELECT o_orderkey, reason || CASE WHEN {_any_sql('reason', dispositions.UNFAVOURABLE)} THEN '{dispositions.UNFAVOURABLE_TOKEN}' ELSE '' END AS t FROM r")
def benefit_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", dispositions.with_benefit_risk(F.col("reason")).alias("t"))


@query("k25_denied_regulators", f"WITH {REC} SELECT o_orderkey, {_any_sql('reason', dispositions.REGULATORY_DENIALS)} AS denied FROM r")
def regulatory_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).select("o_orderkey", dispositions.regulatory_denied(F.col("reason")).alias("denied"))


CUE_SQL = "(" + " OR ".join(f"contains(lower(reason), '{c}')" for c in dispositions.REGULATORY_CUES) + ")"


@query("k26_regulatory_causes", f"WITH {REC} SELECT o_orderkey, {CUE_SQL} AS cue, regexp_matches(lower(reason), '{dispositions.REGULATORY_ANCHOR}') AND {CUE_SQL} AND NOT {_any_sql('reason', dispositions.REGULATORY_DENIALS)} AS cause FROM r")
def regulatory_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("reason")
    return reasons(spark, sf_dir).select("o_orderkey", dispositions.any_contained(F.lower(t), dispositions.REGULATORY_CUES).alias("cue"), dispositions.regulatory_cause(t).alias("cause"))


def _when(rules) -> str:
    return " ".join(f"WHEN regexp_matches(t, '{_q(p)}') THEN '{c}/{q}'" for p, c, q in rules)


PLACEHOLDER_SQL = "trim(regexp_replace(t, '[.!\\s]+$', '')) IN (" + ", ".join(f"'{p}'" for p in classify.PLACEHOLDERS) + ")"
DISPOSITION_SQL = f"""CASE WHEN k % 17 = 0 THEN 'MULTIPLE_EXPLICIT_CAUSES/HIGH' WHEN k % 19 = 0 THEN 'BIOLOGICAL_DOMAIN_UNSPECIFIED/HIGH' WHEN t = '' THEN 'MISSING_STOP_REASON/LOW'
  WHEN {PLACEHOLDER_SQL} THEN 'PLACEHOLDER_WITHOUT_EXPLICIT_SOURCE_CAUSE/LOW' {_when(dispositions.BEFORE_EVIDENCE)} WHEN k % 23 = 0 THEN 'STATUS_OR_ACTION_WITHOUT_CAUSE/LOW' {_when(dispositions.AFTER_EVIDENCE)}
  WHEN length(t) <= {dispositions.FRAGMENT_CHARS} OR len(string_split(t, ' ')) <= {dispositions.FRAGMENT_WORDS} THEN 'ABBREVIATION_OR_FRAGMENT/MEDIUM' ELSE 'OTHER_AMBIGUOUS_TEXT/HIGH' END"""


def disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    d = dispositions.disposition(F.col("t"), F.when(k % 17 == 0, dispositions.MIXED), F.when(k % 19 == 0, dispositions.BIO_UNSPECIFIED), F.when(k % 23 == 0, f"a;{dispositions.NO_CAUSE_EVIDENCE}"))
    return reasons(spark, sf_dir).select("o_orderkey", d.alias("d")).select("o_orderkey", "d.code", "d.priority")


@query("k14_dispositions", f"WITH {REC}, d AS (SELECT o_orderkey, {DISPOSITION_SQL} AS d FROM r) SELECT o_orderkey, split_part(d, '/', 1) AS code, split_part(d, '/', 2) AS priority FROM d")
def decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disposed(spark, sf_dir)


#: An outcome, a secondary reason and external labels for each record.
CONFLICT = ["UNRESOLVED", "MIXED_CAUSES", "NON_FAILURE_TRANSITION", "CAUSE_NOT_STATED", "BIOLOGICAL", "NON_BIOLOGICAL", "NON_BIOLOGICAL"]
SECOND = ["SAFETY; FUNDING", "RECRUITMENT", "", "REGULATORY", "STAFFING_RESOURCES; SAFETY"]
EXTERNAL = ["Safety_Sideeffects", "Insufficient_Enrollment", "Regulatory", "Study_Staff_Moved", "Business"]


@query(
    "k24_label_conflicts",
    f"""WITH {REC}, l AS (SELECT o_orderkey, {_sql(CONFLICT, 'k')} AS outcome, {_sql(SECOND, '(k // 2)')} AS second, [{_sql(EXTERNAL, '(k // 3)')}, {_sql(EXTERNAL, '(k // 4)')}] AS labels FROM r)
    SELECT o_orderkey, CASE outcome {' '.join(f"WHEN '{o}' THEN '{c}'" for o, c in dispositions.CONFIRMED.items())} ELSE CASE WHEN {' OR '.join(f"(list_contains(labels, '{x}') AND contains(second, '{c}'))" for x, c in dispositions.EXTERNAL.items())}
      THEN 'CONFIRMED_SECONDARY' ELSE 'CONFIRMED_TAXONOMY_DIFFERENCE' END END AS why FROM l""",
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(_pick(EXTERNAL, "k div 3"), _pick(EXTERNAL, "k div 4"))
    return reasons(spark, sf_dir).select("o_orderkey", dispositions.label_conflict(_pick(CONFLICT, "k"), _pick(SECOND, "k div 2"), labels).alias("why"))


OLD = ["UNCLEAR", "NON_BIOLOGICAL", "BIOLOGICAL_FAILURE", "UNCLEAR"]
OLD_REASON = ["OPERATIONAL", "SAFETY", "EFFICACY/FUTILITY"]
NEW = [*dispositions.UNCLEAR_BUT, *dispositions.OPERATIONAL_BUT, dispositions.BIO_UNSPECIFIED, "SAFETY"]


@query(
    "k21_accepted_transitions",
    f"""WITH {REC}, l AS (SELECT o_orderkey, t, {_sql(OLD, 'k')} AS label, {_sql(OLD_REASON, '(k // 4)')} AS why, {_sql(NEW, '(k // 2)')} AS got, CASE WHEN k % 13 = 0 THEN 'MIXED_CAUSES' ELSE 'OTHER' END AS outcome FROM r)
    SELECT o_orderkey, {' OR '.join(f"(label = 'UNCLEAR' AND got = '{p}' AND regexp_matches(t, '{_q(x)}'))" for p, x in dispositions.UNCLEAR_BUT.items())}
      OR (label = 'NON_BIOLOGICAL' AND why = 'OPERATIONAL' AND (got IN ({', '.join(f"'{o}'" for o in dispositions.OPERATIONAL_BUT)}) OR (got = 'REGULATORY' AND regexp_matches(t, '{dispositions.REGULATOR}'))))
      OR (label = 'BIOLOGICAL_FAILURE' AND why = 'SAFETY' AND got = '{dispositions.BIO_UNSPECIFIED}' AND regexp_matches(t, '{dispositions.BENEFIT_RISK}'))
      OR (label = 'BIOLOGICAL_FAILURE' AND why IN ('SAFETY', 'EFFICACY/FUTILITY') AND outcome = 'MIXED_CAUSES') AS accepted FROM l""",
)
def tolerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("k") % 13 == 0, dispositions.MIXED).otherwise("OTHER")
    return reasons(spark, sf_dir).select("o_orderkey", dispositions.accepted_transition(F.col("t"), _pick(OLD, "k"), _pick(OLD_REASON, "k div 4"), outcome, _pick(NEW, "k div 2")).alias("accepted"))


# --- sentences that state a miss ----------------------------------------------------------------

#: What stands before a statement, the statement, and what stands behind it.
OPENINGS = ["", "Recruitment was slow. ", "The parent study NCT00000001 ended. ", "Study CX-2041 was closed. ", "Two sites were closed! ", "The drug was well tolerated. "]
STATED = [
    "The primary endpoint was not met.", "The study did not meet its primary endpoint.", "It failed to meet the primary objective.", "This study failed to demonstrate a benefit in the primary analysis.", "Patients who did not achieve the primary endpoint left.",
    "If the trial did not meet its primary endpoint, it would end.", "The study did not reach its primary objective as not enough patients were accrued.", "NCT00000002 did not meet its primary endpoint.", "The earlier trial did not meet its primary endpoint.",
    "Study AB12C did not meet its primary endpoint.", "NCT00000007 did not meet the pre-specified primary efficacy endpoint, and a long account of what that means follows here, with the numbers of all arms, all sites, all visits and all of the sensitivity analyses that had been planned, none of which changed the result that was seen at the interim look, or at the final one, in any group that was defined beforehand.",
    "The primary endpoint was met.", "The co-primary hypothesis was not demonstrated.",
]
CLOSINGS = ["", " The primary outcome was not achieved.", " No harm was seen."]
OWN_ID = "NCT00000007"
SAID_SQL = f"s AS (SELECT o_orderkey, {_sql(OPENINGS, 'o_orderkey')} || {_sql(STATED, '(o_orderkey // 2)')} || {_sql(CLOSINGS, '(o_orderkey // 5)')} AS said FROM orders)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(_pick(OPENINGS, "o_orderkey"), _pick(STATED, "o_orderkey div 2"), _pick(CLOSINGS, "o_orderkey div 5"))
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))


def _else_sql(s: str) -> str:
    return f"(regexp_matches({s}, '{reading.RECORD_ID}') OR regexp_matches({s}, '{reading.OTHER_STUDY}') OR regexp_matches({s}, '{reading.STUDY_CODE}'))"


GUARDED_SQL = f"""{SAID_SQL}, p AS (SELECT o_orderkey, string_split(regexp_replace(said, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM s),
  x AS (SELECT o_orderkey, unnest(ss) AS one, unnest(range(1, len(ss) + 1)) AS i, ss FROM p),
  g AS (SELECT o_orderkey, i, one, string_split_regex(one, '{_q(reading.MISS)}')[1] AS lead, CASE WHEN i > 1 THEN ss[i - 1] END AS earlier FROM x WHERE regexp_matches(one, '{_q(reading.MISS)}')),
  f AS (SELECT o_orderkey, i, one FROM g WHERE NOT regexp_matches(one, '{reading.NO_ANSWER}') AND NOT (regexp_matches(one, '{reading.PRONOUN}') AND NOT regexp_matches(one, '{reading.PRONOUN_OF_THIS}') AND coalesce({_else_sql('earlier')}, false))
    AND len(list_filter(regexp_extract_all(one, '{reading.RECORD_ID}'), lambda n: upper(n) <> '{OWN_ID}')) = 0 AND NOT regexp_matches(one, '{reading.OTHER_STUDY}') AND NOT regexp_matches(one, '{reading.STUDY_CODE}')
    AND NOT regexp_matches(lead, '{reading.PER_PATIENT}') AND NOT regexp_matches(lead, '{reading.CONDITIONAL}')),
  q AS (SELECT o_orderkey, arg_min(one, i) AS one FROM f GROUP BY 1)"""


@query("m08_guarded_statements", f"WITH {GUARDED_SQL} SELECT s.o_orderkey, substring(one, 1, 300) || CASE WHEN length(one) > 300 THEN '…' ELSE '' END AS sentence FROM s LEFT JOIN q ON q.o_orderkey = s.o_orderkey")
def guarded_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence that states a miss of the record's own study, behind all guards."""
    return statements(spark, sf_dir).select("o_orderkey", reading.miss_statement(F.col("said"), F.lit(OWN_ID)).alias("sentence"))


@query("m09_first_place", f"WITH {GUARDED_SQL}, w AS (SELECT s.o_orderkey, a.one AS first, b.one AS second FROM s LEFT JOIN q a ON a.o_orderkey = s.o_orderkey AND s.o_orderkey % 2 = 0 LEFT JOIN q b ON b.o_orderkey = s.o_orderkey + 1) SELECT o_orderkey, CASE WHEN first IS NOT NULL THEN 'caveats' WHEN second IS NOT NULL THEN 'description' END AS place, substring(coalesce(first, second), 1, 300) || CASE WHEN length(coalesce(first, second)) > 300 THEN '…' ELSE '' END AS sentence FROM w")
def first_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first statement of a miss over a record's places: the caveats of half of the records, then the next record's text."""
    s = statements(spark, sf_dir)
    after = s.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("said").alias("next"))
    rows = s.join(after, "o_orderkey", "left").withColumn("said", F.when(F.col("o_orderkey") % 2 == 0, F.col("said")))
    found = reading.first_miss([("caveats", F.col("said")), ("description", F.col("next"))], F.lit(OWN_ID))
    return rows.select("o_orderkey", found.alias("f")).select("o_orderkey", F.col("f.where").alias("place"), F.col("f.text").alias("sentence"))
