"""Predicates and decisions over classified records: labels, buckets, reasons and where they came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

#: Labels of the second scheme.
BIOLOGICAL, MIXED, UNRESOLVED = "BIOLOGICAL", "MIXED", "UNRESOLVED"
BIOLOGICAL_REASONS = ("EFFICACY", "SAFETY")
#: Phrases by which a text denies a regulatory cause, and cues of one.
REGULATORY_DENIALS = (r"not (?:related to|due to|because of) (?:any )?(?:regulatory|fda)", r"no regulatory (?:action|concern|request)s?", r"without (?:any )?regulatory (?:input|request)")
REGULATORY_CUES = ("clinical hold", "regulatory hold", "not approved", "regulatory approval", "inspection", "audit", "warning letter", "regulatory request")
#: Ways to say that benefits do not outweigh risks, and the token that stands for them.
UNFAVOURABLE = (r"risks? (?:profile )?(?:exceeds?|outweigh(?:s|ed)?) (?:the )?(?:potential )?benefits?", r"benefits? (?:did|do|does) not outweigh (?:the )?risks?", r"unfavou?rable (?:benefit|risk)[- /](?:risk|benefit)")
UNFAVOURABLE_TOKEN = "benefit_risk_unfavorable"
#: Where a clause ends, what denies the words behind it, words of safety problems.
CLAUSE_BREAK = r"[.;:(),]|\bbut\b|\bhowever\b|\bwhereas\b|\balthough\b"
GOVERNS = r"\b(?:no|not|without|never|unrelated to|rather than)\b"
SAFETY_WORD = r"\b(?:safety|toxicit(?:y|ies)|adverse (?:events?|reactions?|effects?)|deaths?|side effects?)\b"


def any_match(t: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, p: a | t.rlike(p), patterns, F.lit(False))


def any_contained(t: Column, cues: Sequence[str]) -> Column:
    return reduce(lambda a, c: a | F.contains(t, F.lit(c)), cues, F.lit(False))


def with_benefit_risk(t: Column) -> Column:
    """The text with a token behind it where it says that risks outweigh benefits."""
    return F.when(any_match(t, UNFAVOURABLE), F.concat(t, F.lit(" " + UNFAVOURABLE_TOKEN))).otherwise(t)


def regulatory(t: Column) -> Column:
    """Whether a regulator is a stated cause: a cue, and no denial."""
    return any_contained(t, REGULATORY_CUES) & ~any_match(t, REGULATORY_DENIALS)


def clauses(t: Column) -> Column:
    return F.split(t, CLAUSE_BREAK)


def stated_and_denied(t: Column, word: str) -> Column:
    """struct(stated, denied): clauses in which a word stands, by whether something before it in its clause
    governs it."""
    found = F.filter(clauses(t), lambda c: c.rlike(word))
    denied = F.filter(found, lambda c: F.regexp_extract(c, rf"^(.*?){word}", 1).rlike(GOVERNS))
    return F.struct((F.size(found) - F.size(denied)).cast("long").alias("stated"), F.size(denied).cast("long").alias("denied"))


def affirms_safety(t: Column) -> Column:
    return stated_and_denied(t, SAFETY_WORD)["stated"] > 0


def biological(outcome: Column, secondary: Column, primary: Column | None = None) -> Column:
    """BIOLOGICAL, or MIXED with a biological secondary reason (or primary, where that counts)."""
    reasons = F.coalesce(secondary, F.array().cast("array<string>"))
    if primary is not None:
        reasons = F.array_append(reasons, primary)
    return F.coalesce((outcome == BIOLOGICAL) | ((outcome == MIXED) & F.arrays_overlap(reasons, F.array(*map(F.lit, BIOLOGICAL_REASONS)))), F.lit(False))


def first_label(*levels: Column) -> Column:
    """struct(label, level): the first filled level that is not unresolved; level counts from 1, 0 for none."""
    clean = [F.when(~F.startswith(tx.code_of(c), F.lit(UNRESOLVED)), F.nullif(tx.code_of(c), F.lit(""))) for c in levels]
    tries = [F.when(c.isNotNull(), F.struct(c.alias("label"), F.lit(i + 1).alias("level"))) for i, c in enumerate(clean)]
    return F.coalesce(*tries, F.struct(F.lit("UNKNOWN").alias("label"), F.lit(0).alias("level")))


def category(final: Column) -> Column:
    """A final category; what is unresolved is unspecified."""
    return F.when(F.startswith(F.coalesce(final, F.lit(UNRESOLVED)), F.lit(UNRESOLVED)), "UNSPECIFIED").otherwise(final)


def all_filled(*columns: Column) -> Column:
    return reduce(lambda a, c: a & F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)), columns, F.lit(True))


def core_bucket(code: Column, buckets: Mapping[str, str], t: Column, keywords: Mapping[str, str]) -> Column:
    """The bucket of a code, else of the first keyword pattern in the text, else OTHER."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv]), code)
    return F.coalesce(named, *[F.when(t.rlike(p), b) for p, b in keywords.items()], F.lit("OTHER"))


def attribution(t: Column, cascade: str, own: str, siblings: Column, reviewed: Column) -> Column:
    """struct(verdict, basis): a review decides; else a reference to something elsewhere, even where the text
    also has a finding; else the text's own finding; else stops of sibling records; else unclear. A match
    counts only where nothing in its clause denies it."""
    outward, inward = (stated_and_denied(t, p)["stated"] > 0 for p in (cascade, own))
    out = lambda v, b: F.struct((v if isinstance(v, Column) else F.lit(v)).alias("verdict"), F.lit(b).alias("basis"))
    return F.when(reviewed.isNotNull(), out(reviewed, "reviewed")).when(outward, out("CASCADE", "textual")).when(inward, out("OWN_DATA", "textual")).when(siblings > 0, out("CASCADE", "structural")).otherwise(out("UNCLEAR", None))


def tolerated(expected: Column, got: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """equal, tolerated (a listed pair) or wrong; null counts as a value."""
    listed = reduce(lambda a, p: a | ((expected == p[0]) & (got == p[1])), pairs, F.lit(False))
    return F.when(expected.eqNullSafe(got), "equal").when(F.coalesce(listed, F.lit(False)), "tolerated").otherwise("wrong")


def second_scheme(legacy: Column, t: Column, rules: Mapping[str, tuple[str, str]]) -> Column:
    """struct(code, confirmed): the code that a legacy label maps to, and whether its pattern stands in the text."""
    code = F.element_at(F.create_map(*[F.lit(x) for k, (c, _) in rules.items() for x in (k, c)]), legacy)
    seen = reduce(lambda a, kv: a | ((legacy == kv[0]) & t.rlike(kv[1][1])), rules.items(), F.lit(False))
    return F.struct(F.coalesce(code, F.lit("UNKNOWN")).alias("code"), F.coalesce(seen, F.lit(False)).alias("confirmed"))
