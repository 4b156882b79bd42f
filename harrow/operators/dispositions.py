"""Ordered decision lists over stop reasons: why a record waits for review, whether a regulator is the cause, whether benefits
fall short of risks, and which disagreements with another labelling are accepted. Rules read normalised text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import decide, is_placeholder
from .labels import any_contained, any_match

# --- fixed values: codes, patterns and cues --------------------------------------------------

MIXED, BIO_UNSPECIFIED, NO_CAUSE_EVIDENCE = "MIXED_CAUSES", "BIOLOGICAL_UNSPECIFIED", "unknown.action_without_cause"
_DONE = "terminated|discontinued|stopped|closed|halted|withdrawn|cancelled|canceled|abandoned|ended"
_PLACE = "site|center|centre|institution|department|faculty|research office|local team"
_LOCAL = "administrative|decision|request|closed|closure|withdrew|withdrawal|stopped|terminated|unable to continue"
#: pattern, code and priority, in the order in which they are tried; the evidence rule stands before STATUS_ONLY.
GENERIC_CATEGORY = r"^(?:due to )?(?:unspecified )?(?:administrative|business|corporate|strategic|operational|scientific|ethical|management) (?:reason|reasons|decision|consideration|considerations|issue|issues|change|changes)\.?$"
ACTOR_ONLY = r"^(?:per |at the request of )?(?:the )?(?:sponsor|company|business|corporate|strategic|administrative|management|investigator|principal investigator|pi|funder|board|committee|dmc|dsmb|idmc)(?:'s)?\s+(?:decision|request|reasons?|recommendation|discretion|choice)\.?$"
NEGATED_CAUSE = r"\b(?:not due to|not related to|unrelated to|not based on|not driven by|not linked to|not prompted by|no)\b[^.;:]{0,100}\b(?:safety|efficacy|tolerability|risk[- /:]?benefit|benefit[- /:]?risk|adverse events?|regulatory)\b"
ANALYSIS_WITHOUT_RESULT = r"\b(?:interim analysis|analysis|analyses|data review|safety review|efficacy review|results? review|review of (?:the )?(?:available )?data|dmc|dsmb|idmc|committee recommendation|preliminary results?|available data)\b"
PROVISIONAL = r"\b(?:pending|awaiting|under discussion|being considered|considering|temporarily|temporary hold|deferred|reevaluating|re-evaluating|to be determined|tbd)\b"
STATUS_ONLY = r"^(?:the )?(?:study|trial|program|programme|development|compound|substance|research|enrollment|enrolment|recruitment|accrual)?\s*(?:was |is |has been )?(?:terminated|stopped|halted|closed|discontinued|withdrawn|cancelled|canceled|abandoned|finished|not completed)\.?$"
REGISTRY = r"\b(?:clinicaltrials\.gov|trial registration|registry (?:entry|record)|duplicate (?:entry|record|registration)|registration (?:error|mistake)|entered in error|reporting (?:error|issue)|submission discarded)\b"
DOMAIN_MENTION = r"\b(?:efficacy|effectiveness|safety|tolerability|toxicity|futility|benefit\s*[- /:]\s*risk|risk\s*[- /:]\s*benefit)\b"
RETENTION = r"\b(?:follow[- ]?up|retention|lost to follow[- ]?up|drop[- ]?out|withdrawal rate|participant withdrawal|patient withdrawal|compliance)\b"
INSUFFICIENT_DATA = r"\b(?:insufficient|inadequate|limited|poor|lack of|not enough)\b[^.;:]{0,90}\b(?:data|information|evidence|data quality|sample|cases?|events?)\b"
SITE_ADMIN = rf"\b(?:{_PLACE})\b[^.;:]{{0,120}}\b(?:{_LOCAL})\b|\b(?:{_LOCAL})\b[^.;:]{{0,120}}\b(?:{_PLACE})\b"
COMPLETION = r"\b(?:completed|completion|complete|end of (?:the )?(?:study|trial)|part [a-z0-9]+|phase [1234][ab]?|follow[- ]?on|continuation study|extension study|transition(?:ed|ing)?)\b"
CAUSAL_CONNECTOR = r"\b(?:due to|because of|as a result of|resulting from|owing to|secondary to)\b"
PROGRAM_ACTION = rf"\b(?:study|trial|program|programme|development|compound|asset)\b[^.;:]{{0,100}}\b(?:{_DONE})\b|\b(?:{_DONE})\b[^.;:]{{0,100}}\b(?:study|trial|program|programme|development|compound|asset)\b"
BEFORE_EVIDENCE = (
    (GENERIC_CATEGORY, "GENERIC_CAUSE_CATEGORY_WITHOUT_DETAIL", "LOW"),
    (ACTOR_ONLY, "GENERIC_ACTOR_OR_DECISION_ONLY", "LOW"),
    (NEGATED_CAUSE, "NEGATED_SIGNAL_WITHOUT_AFFIRMATIVE_CAUSE", "MEDIUM"),
    (ANALYSIS_WITHOUT_RESULT, "ANALYSIS_OR_REVIEW_WITHOUT_RESULT", "MEDIUM"),
    (PROVISIONAL, "PROVISIONAL_OR_FUTURE_PLAN", "MEDIUM"),
)
AFTER_EVIDENCE = (
    (STATUS_ONLY, "STATUS_OR_ACTION_WITHOUT_CAUSE", "LOW"),
    (REGISTRY, "REGISTRY_OR_REPORTING_ADMIN_TEXT", "LOW"),
    (DOMAIN_MENTION, "DOMAIN_MENTION_WITHOUT_DIRECTIONAL_RESULT", "HIGH"),
    (RETENTION, "RETENTION_OR_FOLLOW_UP_LIMITATION", "MEDIUM"),
    (INSUFFICIENT_DATA, "INSUFFICIENT_OR_LOW_QUALITY_DATA", "HIGH"),
    (SITE_ADMIN, "SITE_OR_INSTITUTION_ADMIN_TEXT", "MEDIUM"),
    (COMPLETION, "COMPLETION_OR_TRANSITION_CONTEXT_UNCLEAR", "MEDIUM"),
    (CAUSAL_CONNECTOR, "EXPLICIT_BUT_UNMAPPED_CAUSE", "HIGH"),
    (PROGRAM_ACTION, "PROGRAM_ACTION_WITHOUT_UNDERLYING_CAUSE", "MEDIUM"),
)
FRAGMENT_CHARS, FRAGMENT_WORDS = 32, 3

#: Ways to deny that a regulator was the cause.
REGULATORY_DENIALS = (
    r"\bnot\s+due\s+to\b.{0,120}\bregulat",
    r"\bnot\s+because\s+of\b.{0,120}\bregulat",
    r"\bno\s+request(?:s)?\s+from\b.{0,120}\bregulat",
    r"\bnot\s+requested\s+by\b.{0,120}\bregulat",
    r"\bwithout\b.{0,120}\bregulat",
    r"\bno\b.{0,60}\bregulatory\b.{0,60}\brequest",
    r"\bno\b.{0,60}\brequest\b.{0,60}\bregulatory",
    r"\bno\b.{0,60}\bregulatory\b.{0,60}\bconcern",
    r"\bno\b.{0,60}\bregulatory\b.{0,60}\bissue",
)
#: Parts of a text that name a cause; the two short ones also stand inside words.
REGULATORY_CUES = (
    "due to", "because of", "at the request of", "requested by", "required by",
    "per fda", "per ema", "based on fda", "based on ema", "fda feedback", "ema feedback",
    "following fda", "following ema", "as requested by",
    "clinical hold", "fda clinical hold", "regulatory hold", "placed on hold by",
    "approval not obtained", "not approved by", "not approved", "regulatory approval",
    "inspection", "audit", "gcp", "non-compliance", "warning letter",
    "ind", "cta",
    "regulatory request", "regulatory requests",
)
#: A regulator or an act of one, without which no cause is regulatory.
REGULATORY_ANCHOR = (
    r"\b(?:fda|food and drug administration|ema|european medicines agency|mhra|health canada|therapeutic goods administration|tga|anvisa|pmda|nmpa|"
    r"regulatory authority|regulatory authorities|health authority|health authorities|competent authority|regulatory agency|regulatory agencies|regulator|regulators|"
    r"clinical hold|fda clinical hold|regulatory hold|regulatory request|regulatory requests)\b"
)
#: Ways to say that risks outweigh benefits, and the token that stands for them.
UNFAVOURABLE = (
    r"\brisk profile\b.{0,120}\bexceed(?:s|ed)?\b.{0,60}\bbenefit",
    r"\brisk profile\b.{0,120}\boutweigh(?:s|ed)?\b.{0,60}\bbenefit",
    r"\brisks?\b.{0,80}\boutweigh(?:s|ed)?\b.{0,80}\bbenefits?\b",
    r"\brisks?\b.{0,80}\bexceed(?:s|ed)?\b.{0,80}\bbenefits?\b",
    r"\bbenefits?\b.{0,80}\b(?:do(?:es)? not|don't|did not|doesn't|didn't)\b.{0,40}\boutweigh\b.{0,80}\brisks?\b",
    r"\bunfavo(?:u)?rable\b.{0,40}\bbenefit[- ]risk\b",
    r"\bnegative\b.{0,40}\bbenefit[- ]risk\b",
)
UNFAVOURABLE_TOKEN = " benefit_risk_unfavorable"
#: Outcomes that explain a disagreement with an external label, and labels that a secondary reason may hold.
CONFIRMED = {"UNRESOLVED": "CONFIRMED_CONSERVATIVE", "MIXED_CAUSES": "CONFIRMED_MIXED", "NON_FAILURE_TRANSITION": "CONFIRMED_NON_FAILURE", "CAUSE_NOT_STATED": "CONFIRMED_CAUSE_NOT_STATED"}
EXTERNAL = {"Safety_Sideeffects": "SAFETY", "Insufficient_Enrollment": "RECRUITMENT", "Regulatory": "REGULATORY", "Study_Staff_Moved": "STAFFING_RESOURCES"}
#: An unclear older label is accepted beside these reasons where the text says so.
UNCLEAR_BUT = {
    "BUSINESS_STRATEGY": r"\b(?:business|corporate|strategic(?:/business| business)?) (?:priority )?(?:decision|decisions|reasons?|considerations?)\b|\bno longer pursuing\b",
    "OPERATIONAL_OTHER": r"\b(?:administrative|operational|organizational) (?:decision|reasons?|change|pause|closure)\b",
    "REGULATORY": r"\b(?:ind (?:was )?(?:withdrawn|withdrawal)|withdrawal of ind|not approved)\b",
    "SUPPORT_WITHDRAWAL": r"\b(?:partner termination|study agreement|provider of drug|pis? not interested)\b",
    "RECRUITMENT": r"\bdifficult(?:y|ies)?\b[^.;:]{0,60}\b(?:enrol|enroll|recruit|accru)",
}
#: An older operational label is accepted beside these, and beside REGULATORY where a regulator is named.
OPERATIONAL_BUT = ("DECISION_ONLY", "PROGRAM_ACTION_ONLY", "PLANNED_TRANSITION", "REPLACEMENT", "NOT_INITIATED")
REGULATOR = r"\b(?:fda|ema|mhra|irb|reb|ethics committee|regulatory authority)\b"
BENEFIT_RISK = r"\b(?:benefit\s*[-/:]?\s*risk|risk\s*[-/:]?\s*benefit)\b"


def disposition(t: Column, outcome: Column, primary: Column, evidence: Column) -> Column:
    """struct(code, priority) of a record that waits for review: the first rule that holds. t is normalised text; the other
    columns may be null."""
    out = lambda code, priority: F.struct(F.lit(code).alias("code"), F.lit(priority).alias("priority"))
    listed = lambda rules: [(t.rlike(p), out(c, q)) for p, c, q in rules]
    none = out("STATUS_OR_ACTION_WITHOUT_CAUSE", "LOW")
    rules = [(outcome == MIXED, out("MULTIPLE_EXPLICIT_CAUSES", "HIGH")), (primary == BIO_UNSPECIFIED, out("BIOLOGICAL_DOMAIN_UNSPECIFIED", "HIGH"))]
    rules += [(F.coalesce(t, F.lit("")) == "", out("MISSING_STOP_REASON", "LOW")), (is_placeholder(t), out("PLACEHOLDER_WITHOUT_EXPLICIT_SOURCE_CAUSE", "LOW"))]
    rules += [*listed(BEFORE_EVIDENCE), (F.contains(evidence, F.lit(NO_CAUSE_EVIDENCE)), none), *listed(AFTER_EVIDENCE)]
    rules += [((F.length(t) <= FRAGMENT_CHARS) | (F.size(F.split(t, " ")) <= FRAGMENT_WORDS), out("ABBREVIATION_OR_FRAGMENT", "MEDIUM"))]
    return decide(rules, out("OTHER_AMBIGUOUS_TEXT", "HIGH"))


def regulatory_denied(t: Column) -> Column:
    return any_match(t, [f"(?is){p}" for p in REGULATORY_DENIALS])


def regulatory_cause(t: Column) -> Column:
    """Whether a regulator is the stated cause: one is named, something says that it caused, and nothing denies it."""
    lower = F.lower(t)
    return lower.rlike(REGULATORY_ANCHOR) & any_contained(lower, REGULATORY_CUES) & ~regulatory_denied(t)


def with_benefit_risk(t: Column) -> Column:
    """The text, with a token behind it where it says that risks outweigh benefits."""
    return F.when(any_match(t, [f"(?is){p}" for p in UNFAVOURABLE]), F.concat(t, F.lit(UNFAVOURABLE_TOKEN))).otherwise(t)


def label_conflict(outcome: Column, secondary: Column, labels: Column) -> Column:
    """Why an outcome stands against external labels: the outcome itself, a secondary reason (a text) that holds one of the
    labels' concepts, or another taxonomy. Null columns hold nothing."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIRMED.items() for x in kv]), F.coalesce(outcome, F.lit("")))
    concept = F.create_map(*[F.lit(x) for kv in EXTERNAL.items() for x in kv])
    held = F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.contains(F.coalesce(secondary, F.lit("")), F.element_at(concept, x)))
    return F.coalesce(named, F.when(F.coalesce(held, F.lit(False)), "CONFIRMED_SECONDARY"), F.lit("CONFIRMED_TAXONOMY_DIFFERENCE"))


def accepted_transition(t: Column, label: Column, reason: Column, outcome: Column, primary: Column, patterns: dict[str, str] = UNCLEAR_BUT, operational: Sequence[str] = OPERATIONAL_BUT) -> Column:
    """Whether a new outcome and primary reason may differ from an older label and reason: the text makes it so. t is
    normalised; null columns accept nothing."""
    unclear = [(label == "UNCLEAR") & (primary == p) & t.rlike(x) for p, x in patterns.items()]
    ran = (label == "NON_BIOLOGICAL") & (reason == "OPERATIONAL")
    bio = label == "BIOLOGICAL_FAILURE"
    rest = [
        ran & (primary.isin(*operational) | ((primary == "REGULATORY") & t.rlike(REGULATOR))),
        bio & (reason == "SAFETY") & (primary == BIO_UNSPECIFIED) & t.rlike(BENEFIT_RISK),
        bio & reason.isin("SAFETY", "EFFICACY/FUTILITY") & (outcome == MIXED),
    ]
    return decide([(c, F.lit(True)) for c in [*unclear, *rest]], F.lit(False))
