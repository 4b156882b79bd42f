"""Reports and rules that SQL does not say, against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.functions import names, text
from harrow.operators import classify, labels, reporting


def plain_kept(sets, share=0.85):
    kept = []
    for t in sorted(sets, key=lambda t: (-len(sets[t]), len(t), t)):
        if not any(len(sets[t] & sets[k]) >= share * len(sets[t]) for k in kept):
            kept.append(t)
    return set(kept)


def test_overlapping_terms_fall_in_order(spark):
    rng = random.Random(4)
    sets = {f"t{i}": set(rng.sample(range(40), rng.randrange(1, 30))) for i in range(40)}
    sets |= {f"s{i}": set(list(sets["t1"])[: len(sets["t1"]) - i]) for i in range(4)} | {"copy": set(sets["t2"])}
    rows = [(t, i) for t, items in sets.items() for i in items] * 2
    got = {r["term"] for r in reporting.suppress_overlaps(spark.createDataFrame(rows, "term string, item int"), "term", "item").collect()}
    assert got == plain_kept(sets)
    assert reporting.suppress_overlaps(spark.createDataFrame([], "term string, item int"), "term", "item").count() == 0


def test_strict_joins_fail_on_lost_keys(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "u")], "k int, b string")
    with pytest.raises(Exception, match="no match for k 2"):
        reporting.strict_join(a, b, "k").collect()
    assert reporting.strict_join(b, a, "k").count() == 1
    with pytest.raises(Exception, match="no match for k 2"):
        reporting.strict_join(b, a, "k", both=True).collect()


def test_proposals_for_unknown_rows_are_an_error(spark):
    rows = spark.createDataFrame([(1, "a")], "k int, c string")
    retired = spark.createDataFrame([(9, "z", True), (1, "n", False)], "k int, value string, retired boolean")
    assert [r["c"] for r in reporting.apply_proposals(rows, retired, "k", "c").collect()] == ["n"]
    with pytest.raises(Exception, match="no match for k 9"):
        reporting.apply_proposals(rows, retired.withColumn("retired", F.lit(False)), "k", "c").collect()


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in rows.orderBy("i").select(column(F.col("x")).alias("v")).collect()]


def test_negation_and_cause_by_hand(spark):
    texts = ["toxicity", "no toxicity was seen", "not slow; toxicity", "toxicity and toxicity", "without any sign of toxicity", ""]
    assert values(spark, lambda c: classify.occurrences(c, "toxicity"), *texts) == [1, 0, 1, 2, 0, 0]
    causes = ["stopped due to toxicity", "toxicity. it was due to costs", "toxicity was the reason", "not due to toxicity", "toxicity"]
    assert values(spark, lambda c: classify.near_cause(c, "toxicity"), *causes) == [1, 0, 1, 0, 0]


def plain_denied(t, word):
    found = [c for c in re.split(labels.CLAUSE_BREAK, t) if re.search(word, c)]
    denied = [c for c in found if re.search(labels.GOVERNS, c[: re.search(word, c).start()])]
    return len(found) - len(denied), len(denied)


def test_denials_in_clauses_equal_plain_python(spark):
    rng = random.Random(2)
    words = ["no", "safety", "issues", "deaths", "but", "not", "efficacy", "was", ",", ".", "however", "without", "toxicity"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(200)]
    got = values(spark, lambda c: labels.stated_and_denied(c, labels.SAFETY_WORD), *texts)
    assert [(g["stated"], g["denied"]) for g in got] == [plain_denied(t, labels.SAFETY_WORD) for t in texts]


def test_stop_sentences_and_snippets(spark):
    t = "We plan to stop. It was stopped for futility! Nothing else? It will not be stopped."
    assert values(spark, lambda c: classify.stop_sentences(c, "stopped", r"\b(?:not|will)\b"), t) == [["It was stopped for futility!"]]
    assert values(spark, lambda c: classify.stop_snippet(c, ("stopped",), 20), "a" * 50 + " stopped here and there", "nothing") == ["aaaa stopped here an", ""]


def test_visible_text_and_sentences(spark):
    html = "<html><script>var a='<b>';</script><p>One <b>two</b></p><!-- no --> three</html>"
    assert values(spark, text.visible_text, html) == ["One two three"]
    assert values(spark, text.sentences, "A b. C d! E?f g? ") == [["A b.", "C d!", "E?f g?"]]


def test_shards_by_plain_fnv(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h & 0xFF

    ids = ["NCT00000257", " nct123456789012345678901 ", "EU-2020-1", "ncT12x", "", "é1"]
    want = [int(m[1]) % 256 if (m := re.fullmatch(r"NCT(\d+)", i.strip().upper())) else fnv(i.strip().upper()) for i in ids]
    assert values(spark, text.shard_of, *ids) == want


def test_names_fold_marks(spark):
    assert values(spark, text.organisation_key, "Société Générale (X) S.A.", "Bayer Åland Oy", "A. B. Incorporated") == ["societe generale", "bayer aland", "a b"]
    assert values(spark, names.drug_key, "Aspirin 50 mg tablets", "A + B", "placebo", "x1", "Paclitaxel (Taxol) injection") == ["aspirin", None, None, None, "paclitaxel"]


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_of_many_terms_equal_plain_python(spark, seed):
    """Chains of near-copies, an item that all terms have, empty keys: greedy suppression to the end."""
    rng = random.Random(seed)
    base = [rng.sample(range(200), rng.randint(1, 30)) for _ in range(40)]
    sets = {f"t{k}": set(b) | {999} for k, b in enumerate(base)}
    for k in range(120):  # near-copies of what is there, so that chains form
        s = set(sets[rng.choice(sorted(sets))])
        s ^= set(rng.sample(range(200), rng.randint(0, 2)))
        sets[f"u{k}" + "x" * (k % 3)] = s | {999}
    rows = [(t, i) for t, s in sets.items() for i in s] + [(None, 1), ("gone", None)]
    got = {r["term"] for r in reporting.suppress_overlaps(spark.createDataFrame(rows, "term string, item int").repartition(4), "term", "item").collect()}
    kept: list[str] = []
    for t in sorted(sets, key=lambda t: (-len(sets[t]), len(t), t)):
        if not any(len(sets[t] & sets[k]) >= 0.85 * len(sets[t]) - 1e-9 for k in kept):
            kept.append(t)
    assert got == set(kept)


@pytest.mark.parametrize("per_range", [3, 10**6])
def test_ring_neighbours_by_ranges(spark, monkeypatch, per_range):
    from harrow.operators import joins, ordered

    monkeypatch.setattr(joins, "with_ranges", lambda rows, order: ordered.with_ranges(rows, order, per_range))
    groups = {"a": list(range(0, 90, 3)), "b": [5], "c": [1, 9], None: [4, 6, 8, 100]}
    df = spark.createDataFrame([(g, i) for g, ids in groups.items() for i in ids], "g string, i long")
    got = {(r["id"], r["neighbour"], r["place"]) for r in joins.ring_neighbours(df.where("g is not null"), "g", "i", 4).collect()}
    want = set()
    for g, ids in groups.items():
        for at, i in enumerate(ids if g else []):
            want |= {(i, ids[(at + step) % len(ids)], place) for place, step in ((1, 1), (2, -1), (3, 2), (4, -2)) if place <= len(ids) - 1}
    assert got == want
