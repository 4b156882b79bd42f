"""Rule-based text classification as Column expressions.

Occurrences are counted by one pattern each. What stands near an occurrence - a negation before it, a
cause around it - is a look-around of bounded width that does not cross the end of a clause, so
scoring stays inside the JVM and needs no per-row Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from re import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

#: Characters that end a clause.
CLAUSE_END = ".;:"
#: Fixed values of the built-in rule set: negations, causes, and weighted terms of each dimension.
NEGATIONS = ("not", "no", "without", "never", "neither", "nor", "unrelated to", "rather than", "wasn't", "isn't", "non")
CAUSES = ("due to", "because of", "owing to", "as a result of", "based on", "stopped for", "terminated for", "reason")
SAFETY = {"safety concern": 4, "safety issue": 4, "toxicity": 4, "adverse event": 4, "adverse effect": 4, "side effect": 3, "risk profile": 3, "exceeds the benefit": 4, "hepatotoxicity": 2, "death": 2}
EFFICACY = {"lack of efficacy": 5, "insufficient efficacy": 5, "efficacy concern": 4, "futility": 5, "no benefit": 4, "ineffective": 4, "did not meet": 4, "not met": 4, "unmet": 4, "failed to meet": 4, "lack of benefit": 4}
OPERATIONAL = ("slow accrual", "accrual", "recruit", "enrol", "business", "strateg", "portfolio", "sponsor request", "administrative", "funding", "competitive landscape", "external environment", "logistic", "staffing", "supply")
REGULATORY = {"clinical hold": 6, "fda": 4, "ema ": 3, "health authority": 4, "regulatory authorities requested": 5}
#: What a denial denies.
SAFETY_WORDS, EFFICACY_WORDS = ("safety", "adverse", "toxicity", "risk"), ("efficacy", "futility", "effectiveness")
PLACEHOLDERS = ("", "n/a", "na", "none", "unknown", "not provided", "reason not provided", "see description", "other")


def _any(words: Sequence[str]) -> str:
    return "|".join(escape(w) for w in words)


def _gap(width: int) -> str:
    return f"[^{CLAUSE_END}]{{0,{width}}}"


def _after(words: Sequence[str], width: int, term: str) -> str:
    """What stands up to `width` characters before a term that has just been read."""
    return rf"\b(?:{_any(words)})\b{_gap(width)}{escape(term)}"


def _counted(text: Column, term: str, pattern: str) -> Column:
    return F.when(F.contains(text, F.lit(term)), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def occurrences(text: Column, term: str, negations: Sequence[str] = NEGATIONS, window: int = 50) -> Column:
    """How often a term stands in the text without a negation up to `window` characters before it in
    its clause. A negation that is part of the term does not count. The pattern reads the term first,
    so that it looks back only where there is one."""
    return _counted(text, term, rf"{escape(term)}(?<!{_after(negations, window, term)})")


def near_cause(text: Column, term: str, causes: Sequence[str] = CAUSES, negations: Sequence[str] = NEGATIONS, window: int = 90) -> Column:
    """Occurrences with an un-negated cause up to `window` characters before or behind."""
    free = rf"(?<!\b(?:{_any(negations)})\b{_gap(25)})(?:{_any(causes)})"
    own = rf"{escape(term)}(?<!{_after(negations, 50, term)})"
    cause = rf"(?:{_any(causes)}){_gap(window)}{escape(term)}"
    return _counted(text, term, rf"{own}(?:(?<={cause})|(?<!{cause})(?={_gap(window)}{free}))")


def denies(text: Column, words: Sequence[str], negations: Sequence[str] = NEGATIONS) -> Column:
    """Whether a clause says that one of the words is no cause."""
    pattern = rf"\b(?:{_any(negations)})\b{_gap(60)}\b(?:{_any(words)})"
    return F.exists(F.split(text, f"[{CLAUSE_END}]"), lambda c: c.rlike(pattern) & ~c.rlike(r"\b(?:lack of|no|insufficient) (?:efficacy|benefit)"))


def affirms(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands somewhere without a negation before it in its clause."""
    return reduce(lambda a, w: a | (occurrences(text, w) > 0), words, F.lit(False))


def score(text: Column, terms: Mapping[str, int], denied: Column) -> Column:
    """Sum of weights over un-negated occurrences, two more for each near a cause, three less for a
    denial. Overlapping terms all count."""
    total = F.when(denied, -3).otherwise(0)
    for term, weight in terms.items():
        total = total + occurrences(text, term) * weight + near_cause(text, term) * 2
    return total


def hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that the text contains, in the given order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def decide(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """An ordered decision list: the value of the first rule that holds (null holds not)."""
    return F.coalesce(*[F.when(c, v) for c, v in rules], otherwise)


def classify_reason(reason: Column) -> Column:
    """struct(label, reason, confidence, evidence) of a stated reason, by the built-in rule set. What
    several rules look at is computed once, so the expression stays small."""
    return tx.let(tx.normalized(reason), lambda t: tx.let(_findings(t), lambda f: tx.let(_scores(t, f), lambda s: _label(t, f, s))))


def _findings(t: Column) -> Column:
    return F.struct(denies(t, SAFETY_WORDS).alias("no_safety"), denies(t, EFFICACY_WORDS).alias("no_efficacy"), hits(t, OPERATIONAL).alias("operational"))


def _scores(t: Column, f: Column) -> Column:
    less = (F.size(f["operational"]) > 0).cast("int")
    return F.struct((score(t, SAFETY, f["no_safety"]) - less).alias("safety"), (score(t, EFFICACY, f["no_efficacy"]) - less).alias("efficacy"), score(t, REGULATORY, F.lit(False)).alias("regulatory"))


def _label(t: Column, f: Column, s: Column) -> Column:
    busy = F.size(f["operational"]) > 0
    best = F.greatest(s["safety"], s["efficacy"])
    top = F.when(s["safety"] >= s["efficacy"], "SAFETY").otherwise("EFFICACY/FUTILITY")

    def out(label: str, why, confidence: str, evidence: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))

    scores = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), s[n].cast("string")) for n in ("safety", "efficacy", "regulatory")])
    terms = F.array_join(f["operational"], "|")
    operational = out("NON_BIOLOGICAL", "OPERATIONAL", "HIGH", terms)
    return decide(
        [
            (t == "", out("UNCLEAR", "OTHER/UNKNOWN", "LOW", F.lit(""))),
            (busy & t.rlike(r"\bnon-?(?:safety|efficacy)\b"), operational),
            (busy & t.rlike(r"(?:safety|risk)[^.;:]{0,60}unchanged"), operational),
            (busy & f["no_safety"] & f["no_efficacy"], operational),
            (best >= 6, out("BIOLOGICAL_FAILURE", top, "HIGH", scores)),
            ((best >= 2) & ~busy, out("BIOLOGICAL_FAILURE", top, "MEDIUM", scores)),
            (s["regulatory"] >= F.when(busy, 6).otherwise(4), out("NON_BIOLOGICAL", "REGULATORY", "MEDIUM", scores)),
            (busy, operational),
        ],
        out("UNCLEAR", "OTHER/UNKNOWN", "LOW", scores),
    )


def is_placeholder(text: Column) -> Column:
    return tx.normalized(F.regexp_replace(F.coalesce(text, F.lit("")), r"[.!\s]+$", "")).isin(*PLACEHOLDERS)


def with_fallback(reason: Column, *others: Column) -> Column:
    """The reason's class; where it is unclear or a placeholder, that of the first other text that
    says something, with where it came from."""
    tries = [F.struct(classify_reason(stop_snippet(o)).alias("c"), F.lit(i + 1).alias("source")) for i, o in enumerate(others)]

    def choose(own: Column) -> Column:
        better = F.get(F.filter(F.array(*tries), lambda x: x["c"]["label"] != "UNCLEAR"), 0)
        return F.when((own["c"]["label"] == "UNCLEAR") | is_placeholder(reason), F.coalesce(better, own)).otherwise(own)

    return tx.let(F.struct(classify_reason(reason).alias("c"), F.lit(0).alias("source")), choose)


def stop_snippet(text: Column, cues: Sequence[str] = ("stopped", "terminated", "discontinued", "halted", "withdrawn"), window: int = 360) -> Column:
    """Up to `window` characters from a little before the first cue; empty without one."""
    t = tx.collapse(F.coalesce(text, F.lit("")))
    places = F.filter(F.array(*[F.locate(c, F.lower(t)) for c in cues]), lambda p: p > 0)
    begin = F.greatest(F.lit(1), F.array_min(places) - window // 4)
    return F.when(F.size(places) > 0, F.substring(t, begin, F.lit(window))).otherwise("")


def stop_sentences(text: Column, cue: str, plan: str) -> Column:
    """Sentences that report a stop and state no plan or negation."""
    return F.filter(tx.sentences(text), lambda s: F.lower(s).rlike(cue) & ~F.lower(s).rlike(plan))


def area_scores(text: Column, lexicon: Mapping[str, Sequence[str]], preferred: str | None = None) -> Column:
    """struct(primary, matched): areas by number of their keywords in the text; ties go to
    `preferred`, then by name. "Other" if none matches."""
    n = [F.struct((-sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))).alias("n"), F.lit(int(a != preferred)).alias("p"), F.lit(a).alias("area")) for a, words in lexicon.items()]
    found = F.array_sort(F.filter(F.array(*n), lambda x: x["n"] < 0))
    return F.struct(F.coalesce(F.get(found, 0)["area"], F.lit("Other")).alias("primary"), F.array_sort(F.transform(found, lambda x: x["area"])).alias("matched"))


def resolve(final: Column, second: Column, legacy: Column) -> Column:
    """struct(label, source, resolved): the final label unless unresolved, else the second, else the
    legacy one, else unknown."""
    clean = [F.nullif(tx.code_of(c), F.lit("")) for c in (final, second, legacy)]
    usable = F.when(clean[0] != "UNRESOLVED", clean[0])
    label = F.coalesce(usable, clean[1], clean[2], F.lit("UNKNOWN"))
    source = F.when(usable.isNotNull(), "final").when(clean[1].isNotNull(), "second").when(clean[2].isNotNull(), "legacy").otherwise("none")
    return F.struct(label.alias("label"), source.alias("source"), F.coalesce(usable.isNotNull(), F.lit(False)).alias("resolved"))


def bucket(code: Column, mapping: Mapping[str, str], review: Column, otherwise: str = "OTHER/UNKNOWN") -> Column:
    """The bucket of a code; what waits for review, and codes without one, go to `otherwise`."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), code)
    return F.when(~F.coalesce(review, F.lit(False)), F.coalesce(named, F.lit(otherwise))).otherwise(F.lit(otherwise))


def reason_set(primary: Column, secondary: Column, non_causal: Sequence[str]) -> Column:
    both = F.array_union(F.array_compact(F.array(primary)), F.coalesce(secondary, F.array().cast("array<string>")))
    return F.sort_array(F.array_except(both, F.array(*map(F.lit, non_causal))))


def affirmed(text: Column, negated: Sequence[str]) -> Column:
    """The text without its negated phrases."""
    return tx.collapse(reduce(lambda t, p: F.regexp_replace(t, p, " "), negated, text))


def parse_answers(raw: Column, schema: str, expected: Column) -> Column:
    """The well-formed entries of a JSON array whose id is expected; malformed text gives none."""
    parsed = F.from_json(raw, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    return F.filter(F.coalesce(parsed, F.array().cast(f"array<struct<{schema}>>")), lambda x: x["id"].isNotNull() & F.array_contains(expected, x["id"]))
