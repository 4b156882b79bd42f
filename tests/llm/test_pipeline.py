"""The corpus pipeline: each stage against plain Python on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from harrow.llm import pii
from harrow.llm.common import read

from .. import oracle
from .test_bruteforce import WORD, base_spans, lower, plain_components, plain_fingerprint, plain_statistics

SF = str(oracle.DATA)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = read(spark, SF, "documents")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs.collect())
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == COLUMNS
    return out


def ids(rows):
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"] for r in rows}


def test_quality_stage(steps):
    before, after = steps[0], steps[1]
    failed = {r["doc_id"] for r in before for s in [plain_statistics(r["text"] or "")] if s[0] < 20 or 100 * s[4] > 30 * s[0]}
    assert not failed & ids(after)
    assert len(after) > 0.9 * (len(before) - len(failed))


def test_near_dedup_stage(steps):
    before, after = steps[1], steps[2]
    groups = plain_components({r["doc_id"]: plain_fingerprint(r["text"] or "") for r in before}, 4)
    assert ids(after) == set(groups.values())


def test_decontamination_stage(spark, steps):
    windows = set()
    for r in read(spark, SF, "benchmark").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert ids(steps[3]) == {r["doc_id"] for r in steps[2] if not hit(r["text"])}


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def test_personal_data_stage(steps):
    before = {r["doc_id"]: r for r in steps[3]}
    assert ids(steps[4]) == set(before)
    changed = 0
    for r in steps[4]:
        old = before[r["doc_id"]]["text"]
        assert not base_spans(r["text"]) or not base_spans(old)
        assert r["n_chars"] == len(r["text"])
        changed += r["text"] != old
        assert (r["text"] != old) == any(k != "url" for _, _, k in pii.find(old))
    assert changed


def test_mix_stage_and_run(spark, steps):
    taken: dict = {}
    for r in steps[5]:
        assert r["size"] == len(WORD.findall(r["text"])) and 0 < r["taken"] <= 2 * r["size"]
        taken.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 0.5 for t, n in taken.values())
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["taken"], r["text"]) for r in got.collect()) == sorted((r["doc_id"], r["taken"], r["text"]) for r in steps[5])


def test_stages_on_hard_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, and empty tables, in every stage."""
    from .test_edges import COPY, LONG

    prose = " ".join(f"word{i} and" for i in range(40))
    rows = [(1, None, None, None), (2, "", "en", "web"), (3, LONG, "en", "web"), (4, prose, "en", "web"), (4, prose, "en", "web"), (None, COPY, "en", "web"), (None, COPY, "en", None), (5, prose + " me@mail.example", "de", "web"), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, kept boolean")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert out.columns[:5] == COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0
    before = [(i, t) for i, t, *_ in rows]
    assert all(x in before and x[1] for x in got["quality rules"])
    assert sorted((str(i), t == prose) for i, t in got["simhash near-dedup"] if i in (1, 2, 4)) == [("1", False), ("4", True)]
    assert sum(t == COPY for _, t in got["simhash near-dedup"]) == 1
    assert sorted(map(str, got["benchmark decontamination"])) == sorted(map(str, before))
    assert len(got["pii"]) == len(rows) and (5, prose + " <EMAIL>") in got["pii"] and (1, None) in got["pii"]
    assert got["mixing"] and all(t and t.split() for _, t in got["mixing"])
