"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import pytest

from harrow.llm import chat, decontaminate, language_model, licenses, mixing, pii, quality_model, quality_rules, simhash, substrings

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
COPY = " ".join(f"copied{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, kept boolean, row string, token int, word string, size int, g int, d2 string, runs int"
ROWS = [
    (1, None, None, None), (2, "", "en", "web"), (3, "   \n\t ", "en", "web"), (4, LONG, "en", "web"), (5, COPY, "en", "web"), (6, COPY + " end", "de", None),
    (7, "one", None, "web"), (7, "one", None, "web"), (None, COPY, "en", "web"), (None, None, None, None), (8, "émigré 😀 naïve \x00 text", "fr", "books"), (9, "ONE", "en", "web"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (5, 99, "x", True, "r", 1, "w", 3, 4, "d", 9)
    return spark.createDataFrame([(*r, *extra) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("a", " ".join(f"copied{i}" for i in range(20, 45)), 1), ("b", "one", 1), ("c", None, 1), (None, "one", 1), ("d", "", 1), ("b", "one", 2)], "item_id string, text string, id int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0, "x"), (5, 0, 0, "x"), (None, 1, 0, "x"), (7, None, 0, "x")], "doc_id long, quality int, toxic int, text string")


def by_id(df, column):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r[column])
    return out


def test_pii(docs, empty):
    assert pii.scan(docs).count() == len(ROWS)
    assert pii.scan(empty).count() == 0
    assert by_id(docs.select("doc_id", pii.redact(docs["text"]).alias("t")), "t")[1] == [None]


def test_decontaminate(docs, empty, items):
    got = decontaminate.contamination(docs, items)
    assert got.count() == len(ROWS)
    hits = by_id(got, "n_hit")
    assert (hits[1], hits[2], hits[4], hits[5], hits[6], hits[7], sorted(hits[None]), hits[9]) == ([0], [0], [0], [25], [25], [1, 1], [0, 25], [1])
    assert by_id(got, "items")[7] == [["b"], ["b"]]
    assert decontaminate.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 8]


def test_simhash(docs, empty):
    got = by_id(simhash.near_duplicates(docs), "component")
    assert got[1] == got[2] == got[3] == [1]  # no words: fingerprint zero
    assert got[7] == [7, 7] and got[9] == [7]
    assert sorted(got[None]) == [1, 5]
    assert simhash.near_duplicates(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs, keep=("lang",)).collect()
    assert len(rows) == len(ROWS)
    assert sum(r["taken"] for r in rows if r["source"] == "web") == round(next(r["target"] for r in rows if r["source"] == "web"))
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5), keep=("lang",)).collect()))


def test_quality_rules(docs, empty):
    rows = quality_rules.judge(docs)
    assert rows.count() == len(ROWS)
    assert by_id(rows, "base_failed")[1] == [True]
    assert by_id(rows, "n_words")[4] == [60_000]
    assert quality_rules.judge(empty).count() == 0


def test_quality_classifier(docs, empty, labels):
    assert quality_model.classify(docs, labels).where("score between 0 and 1").count() == len(ROWS)
    assert quality_model.classify(docs, labels.limit(0)).where("score = 0.5").count() == len(ROWS)
    assert quality_model.classify(empty, labels).count() == 0


def test_labels_that_are_none(spark, docs):
    """Labels other than 0 and 1 are not learned from, alone or beside others."""
    other = spark.createDataFrame([(i, 2) for i in (4, 6, 8)], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.classify(docs, other).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (6, 2), (8, -1)], "doc_id long, quality int")
    assert quality_model.classify(docs, one).where("score between 0 and 1").count() == len(ROWS)


def test_sample_is_bounded(spark, monkeypatch):
    """One row of an id that many rows share, and no more bytes than the bound."""
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda texts, y, weights: seen.append(texts) or 0.25)
    rows = [(i % 2 + 1, f"text {i} " + "x" * 1000) for i in range(400)] + [(i, f"other {i} " + "y" * 1000) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality_model.train(docs, labels) == 0.25
    ids = [i for i in [1, 2, *range(10, 60)] if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0]) == len(ids)
    monkeypatch.setattr(quality_model, "SAMPLE_BYTES", 5000)
    quality_model.train(docs, labels)
    assert 2 <= len(seen[1]) <= 8 and sum(map(len, seen[1])) <= 10_000


def test_substrings(docs, empty):
    got = by_id(substrings.remove_repeats(docs), "n_removed")
    assert got[1] == [0] and got[5] == [0] and got[6] == [60] and got[7] == [0, 0] and sorted(got[None]) == [0, 60]
    assert got[4] == [60_000 - 977]  # all but the first period
    assert substrings.remove_repeats(empty).count() == 0


def test_language_model(docs, empty):
    rows = language_model.score(docs)
    assert rows.where("score <= 0 and n_tokens > 0").count() == len(ROWS)
    assert by_id(rows, "n_tokens")[1] == [1]
    assert language_model.score(empty).count() == 0


def test_licenses(docs, empty):
    rows, paragraphs = licenses.scan(docs)
    assert rows.count() == len(ROWS) and paragraphs.count() == 0
    rows, paragraphs = licenses.scan(empty)
    assert rows.count() == 0 and paragraphs.count() == 0


CHAT = [
    (1, 1, "assistant", "</s>[INST] \\[INST] <\\\\s> ok [/INST]"), (1, 0, "user", None), (1, 2, None, "x"), (2, 0, "assistant", ""), (None, 0, "assistant", "lost"),
    (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (4, 0, "[/INST]", "<s>[INST]user[/INST]</s>"),
]


def test_chat(spark):
    rows = spark.createDataFrame([(*r, 1, "x") for r in CHAT], "conv_id long, turn long, role string, text string, formatted int, turns string")
    found = chat.format_conversations(rows)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["conv_id"], []).append(r)
    text = {k: "".join(r["piece"] for r in v) for k, v in got.items()}
    assert [t[:2] for t in chat.parse(text[1])] == [("user", ""), ("assistant", CHAT[0][3]), ("", "x")]
    assert [t[:2] for t in chat.parse(text[4])] == [CHAT[7][2:]]
    assert [t[:2] for t in chat.parse(text[3])] == [("assistant", "tie")] * 2
    assert [t[:2] for t in chat.parse(text[None])] == [("assistant", "lost")]
    assert [chat.unescape(r["piece"][r["loss_start"] : r["loss_end"]]) for r in got[1] if r["loss_start"] is not None] == [CHAT[0][3]]
    read = {r["conv_id"]: r for r in chat.read_back(found).collect()}
    assert {k: (r["n_turns"], r["loss_chars"], r["formatted_chars"]) for k, r in read.items()} == {k: (len(v), sum(len(c[3]) for c in CHAT if c[0] == k and c[2] == "assistant"), len(text[k])) for k, v in got.items()}
    assert chat.read_back(chat.format_conversations(rows.limit(0))).count() == 0


def plain_removed(rows):
    """Words that stay, for (id, text) rows of distinct ids, window by window."""
    first: dict = {}
    out = {}
    for i, t in sorted(rows):
        words = (t or "").split()
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in first:
                gone |= set(range(s, s + 20))
            first.setdefault(w, (i, s))
        out[i] = [x for j, x in enumerate(words) if j not in gone]
    return out


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_substrings_compare_words_not_hashes(spark):
    """Two long words whose polynomial hashes modulo 2**64 agree, in otherwise equal windows."""
    bits = thue_morse(2048)
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    around = [f"w{i}" for i in range(24)]
    rows = [(i, " ".join([*around[:12], w, *around[12:]])) for i, w in enumerate((one, two, one))]
    got = by_id(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "kept")
    assert {i: k[0].split() for i, k in got.items()} == plain_removed(rows)


def test_substrings_of_hot_passages(spark):
    """A common line in ever different surroundings, edited copies, and periodic texts."""
    import random

    rng = random.Random(3)
    line = " ".join(f"c{i}" for i in range(14))
    rows = []
    for i in range(700):
        around = [" ".join(f"x{rng.randrange(40)}" for _ in range(rng.randrange(2, 30))) for _ in range(2)]
        rows.append((i, f"{around[0]} {line} {around[1]}"))
    long = [f"d{i}" for i in range(60)]
    for i in range(700, 900):
        copy = list(long)
        copy[rng.randrange(60)] = f"e{rng.randrange(5)}"
        rows.append((i, " ".join(copy)))
    rows += [(900 + i, " ".join(["p", "q"] * (20 + i)) + " end") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    got = by_id(substrings.remove_repeats(docs), "kept")
    assert {i: k[0].split() for i, k in got.items()} == plain_removed(rows)


def test_simhash_deduplicate(spark, docs, empty):
    rows = simhash.deduplicate(docs)
    assert rows.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in rows.collect()]
    # no words; LONG; COPY and its near copy are apart or not, as their fingerprints say; "one"; the French text
    roots = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()}
    assert sorted(i for i, _ in left) == sorted(set(roots.values()))
    assert simhash.deduplicate(empty).count() == 0
    lost = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "A b c d e f"), (3, "x y z"), (3, "x y z"), (3, "p q r")], "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"].lower()) for r in simhash.deduplicate(lost).collect())
    assert kept == [("3", "p q r"), ("3", "x y z"), ("None", "a b c d e f")]


def test_pii_long_texts_are_read_once():
    import time

    began = time.time()
    assert len(pii.find("http://" * 150_000)) == 1
    assert [k for *_, k in pii.find("token=" * 50_000 + "a" * 20)] == ["secret"]
    assert len(pii.find("x@" * 100_000 + "a.b")) == 1
    assert pii.find("+1 (((" * 100_000) == []
    for blank in (" ", "\t \n"):  # a cue before a long blank
        assert pii.find(f"account{blank * 200_000}x password{blank * 200_000}= x iban{blank * 200_000}DE89") == []
    assert [k for *_, k in pii.find("account  number :  12345678 acct #12345678 account 12345678")] == ["account"] * 3
    assert time.time() - began < 20
    assert [(s, e, k) for s, e, k in pii.find("naïve Social Security Number: 123-45-6789, ApiKey = 'abcdefghijklmnop1'")] == [(30, 41, "ssn"), (53, 70, "secret")]
