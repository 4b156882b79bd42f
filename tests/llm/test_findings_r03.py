"""What the review of round 3 found in the training-data operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import language_model, licenses


def test_op1_compares_with_the_templates_of_all_families(spark):
    """The index names every template that reaches its least share: the best one is that of a plain comparison with all."""
    pairs = lambda words: {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}
    templates = licenses._templates_with_bigrams(spark)
    known = [(r["family"], set(r["bigrams"])) for r in templates.collect()]
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        words = " and ".join(rng.choice(licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))]) for _ in range(rng.randrange(1, 4))).split()
        texts.append(" ".join(w for w in words if rng.random() > 0.04))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.tokens(F.col("t")).alias("words")).crossJoin(licenses._indexed(templates))
    others = 0
    for r in rows.select("words", licenses.best_template(F.col("words"), F.col("templates"), F.col("keys")).alias("best")).collect():
        own = pairs(r["words"])
        brief = len(r["words"]) <= licenses.SHORT_WORDS or bool(set(r["words"]) & set(licenses.LICENSING))
        held = [(len(b & own), len(b & own) / len(b), f) for f, b in known]
        held = [h for h in held if h[1] >= licenses.MIN_TEMPLATE and (brief or h[0] >= licenses.SHORT_BIGRAMS)]
        assert (tuple(r["best"]) if r["best"] else None) == max(held, default=None)
        others += len({f for _, _, f in held}) > 1
    assert others > 50


@pytest.fixture(scope="module")
def words_op6(spark):
    """Words of each document of sf0.01, a text in bytes that are no UTF-8 among them."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    return [language_model.words_of((r["text"] or "").encode()) for r in rows] + [[], [b"\xff\xfea", "ß".encode()]]


def test_op6_learned_ranks_equal_plain_byte_pairs(words_op6):
    counts = dict(Counter(w for t in words_op6 for w in t).most_common(150))
    parts = {w: [bytes([b]) for b in b" " + w] for w in counts}
    want = {bytes([b]): b for b in range(256)}
    while len(want) < 330:
        pairs = Counter()
        for w, p in parts.items():
            for pair in zip(p, p[1:], strict=False):
                pairs[pair] += counts[w]
        pair = min(pairs, key=lambda x: (-pairs[x], x))
        want.setdefault(b"".join(pair), len(want))
        for p in parts.values():
            i = 0
            while i < len(p) - 1:
                if (p[i], p[i + 1]) == pair:
                    p[i : i + 2] = [b"".join(pair)]
                i += 1
    assert language_model.learn_ranks(counts, 330) == want
    assert len(language_model.learn_ranks({})) == 256


def test_op6_reads_a_text_once_into_few_ids(words_op6):
    """Ids of hot and of other words are those of the whole text, and half as many as the cut public vocabulary gives."""
    words = [w for w, _ in Counter(w for t in words_op6 for w in t).most_common(5_000)]
    counts = Counter(w for t in words_op6 for w in t)
    public = language_model.read_ranks()
    sizes = []
    for ranks in (language_model.learn_ranks({w: counts[w] for w in words}), public):
        table = language_model.HotWords(words, np.zeros(len(words)), ranks).begin()
        at, others, ids, size = table.read(words_op6)
        whole = language_model.encoder(ranks)
        for t, got in zip(words_op6, np.split(ids, np.cumsum(size)[:-1]), strict=True):
            assert got.tolist() == (whole.encode_ordinary(" " + b" ".join(t).decode("utf-8", "replace")) if t else [])
        named = [*words, *others]
        assert [named[i] for i in at] == [w for t in words_op6 for w in t] and len(others) > 1_000
        sizes.append(len(ids))
    assert sizes[0] < 2 * len(at) < 0.7 * sizes[1]


def test_op6_rows_of_tables_are_summed():
    rng = np.random.default_rng(4)
    row, values = rng.integers(0, 40, 300) ** 2, rng.normal(size=(300, 5))
    rows, sums, times = language_model._by_row(row, values)
    assert dict(zip(rows.tolist(), times.tolist(), strict=True)) == Counter(row.tolist())
    assert all(np.allclose(s, values[row == r].sum(axis=0)) for r, s in zip(rows, sums, strict=True))


def test_op6_held_out_texts_score_well_above_word_counts(spark):
    """A tenth of a decimal place a token above the base score of the same texts."""
    rows = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] - r["base_score"] for r in rows) > 0.1 * sum(r["n_tokens"] for r in rows)
