"""The weighted rules against a plain Python reading of their definitions, position by position."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.operators import classify
from harrow.plans import reading as plans

from . import oracle


def word_ends(t, words, upto):
    """Ends, not behind `upto`, of whole words (or phrases) of a list."""
    return [m.end() for w in words for m in re.finditer(rf"\b(?={re.escape(w)}\b)(?:{re.escape(w)})", t) if m.end() <= upto]


def same_clause(between):
    return not any(c in between for c in classify.CLAUSE_END)


def negated(t, at, window):
    return any(at - e <= window and same_clause(t[e:at]) for e in word_ends(t, classify.NEGATIONS, at))


def places(t, term):
    at = t.find(term)
    while at >= 0:
        yield at
        at = t.find(term, at + len(term))


def plain_occurrences(t, term):
    return sum(not negated(t, at, 50) for at in places(t, term))


def plain_near(t, term):
    n = 0
    for at in places(t, term):
        if negated(t, at, 50):
            continue
        causes = [(p, p + len(c)) for c in classify.CAUSES for p in range(len(t)) if t.startswith(c, p)]
        ahead = any(e <= at and at - e <= 90 and same_clause(t[e:at]) for _, e in causes)
        end = at + len(term)
        behind = any(end <= p <= end + 90 and same_clause(t[end:p]) and not negated(t, p, 25) for p, _ in causes)
        n += ahead or behind
    return n


def plain_denies(t, words):
    for clause in re.split(f"[{classify.CLAUSE_END}]", t):
        if re.search(r"\b(?:lack of|no|insufficient) (?:efficacy|benefit)", clause):
            continue
        starts = [m.start() for w in words for m in re.finditer(rf"\b{re.escape(w)}", clause)]
        if any(0 <= s - e <= 60 for s in starts for e in word_ends(clause, classify.NEGATIONS, s)):
            return True
    return False


def plain_score(t, terms, denied):
    return (-3 if denied else 0) + sum(plain_occurrences(t, w) * n + plain_near(t, w) * 2 for w, n in terms.items())


def plain_class(reason):
    t = " ".join((reason or "").lower().split())
    if not t:
        return "UNCLEAR", "OTHER/UNKNOWN", "LOW"
    busy = any(w in t for w in classify.OPERATIONAL)
    no_safety, no_efficacy = plain_denies(t, classify.SAFETY_WORDS), plain_denies(t, classify.EFFICACY_WORDS)
    safety, efficacy = plain_score(t, classify.SAFETY, no_safety) - busy, plain_score(t, classify.EFFICACY, no_efficacy) - busy
    regulatory, best = plain_score(t, classify.REGULATORY, False), max(safety, efficacy)
    top = "SAFETY" if safety >= efficacy else "EFFICACY/FUTILITY"
    if busy and (re.search(r"\bnon-?(?:safety|efficacy)\b", t) or re.search(r"(?:safety|risk)[^.;:]{0,60}unchanged", t) or (no_safety and no_efficacy)):
        return "NON_BIOLOGICAL", "OPERATIONAL", "HIGH"
    if best >= 6:
        return "BIOLOGICAL_FAILURE", top, "HIGH"
    if best >= 2 and not busy:
        return "BIOLOGICAL_FAILURE", top, "MEDIUM"
    if regulatory >= (6 if busy else 4):
        return "NON_BIOLOGICAL", "REGULATORY", "MEDIUM"
    return ("NON_BIOLOGICAL", "OPERATIONAL", "HIGH") if busy else ("UNCLEAR", "OTHER/UNKNOWN", "LOW")


def salads(seed, n):
    rng = random.Random(seed)
    parts = [*classify.NEGATIONS, *classify.CAUSES, *classify.SAFETY, *classify.EFFICACY, *classify.REGULATORY, "safety", "risk", "efficacy", "accrual", "business", "and", "the", "of", "in a long and winding account of it", ".", ";", ":", ",", "unchanged", "non-safety"]
    return [" ".join(rng.choices(parts, k=rng.randrange(1, 18))) for _ in range(n)]


@pytest.mark.parametrize("term", ["toxicity", "death", "futility", "not met", "fda"])
def test_occurrences_and_causes(spark, term):
    texts = salads(term, 300)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", classify.occurrences(F.col("t"), term).alias("n"), classify.near_cause(F.col("t"), term).alias("c")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        assert (r["n"], r["c"]) == (plain_occurrences(t, term), plain_near(t, term)), t


def test_classes_of_salads(spark):
    texts = salads("classes", 400)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", classify.classify_reason(F.col("t")).alias("c")).orderBy("i").collect()
    got = [(r["c"]["label"], r["c"]["reason"], r["c"]["confidence"]) for r in rows]
    assert got == [plain_class(t) for t in texts]
    assert len(set(got)) >= 6


def test_generated_reasons(spark):
    said = {r["o_orderkey"]: r for r in plans.reasons(spark, str(oracle.DATA)).collect()}
    for r in plans.confirmed_reasons(spark, str(oracle.DATA)).collect():
        want = plain_class(said[r["o_orderkey"]]["reason"])
        assert (r["label"], r["reason"], r["confidence"]) == want and r["kept"] == (want[0] == r["stored"] and want[2] == "HIGH")
    for r in plans.reason_scores(spark, str(oracle.DATA)).collect():
        t = r["t"]
        assert (r["n_toxicity"], r["n_adverse_event"], r["n_death"], r["near_toxicity"], r["near_death"]) == (plain_occurrences(t, "toxicity"), plain_occurrences(t, "adverse event"), plain_occurrences(t, "death"), plain_near(t, "toxicity"), plain_near(t, "death"))
        assert (r["safety"], r["efficacy"]) == (plain_score(t, classify.SAFETY, r["no_safety"]), plain_score(t, classify.EFFICACY, r["no_efficacy"]))
        assert (r["no_safety"], r["no_efficacy"]) == (plain_denies(t, classify.SAFETY_WORDS), plain_denies(t, classify.EFFICACY_WORDS))
