"""Token counts, prefix tries and hard negatives against plain Python, on hard inputs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import negatives, tokens, trie
from harrow.llm import queries as llm

from .. import oracle

SF = str(oracle.DATA)
PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- token counts ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return tokens.Merges(PATH)


def test_tokens_query_equals_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, library(list(docs.values())), strict=True))
    got = llm.QUERIES["op11_count_tokens"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


def test_tokens_of_every_code_point(library, merges):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(points[i : i + 64]) + "1" for i in range(0, len(points), 64)]
    assert list(tokens._count([t.encode() for t in texts], merges)) == library(texts)


def test_tokens_of_random_texts(library, merges):
    draw = random.Random(7)
    bits = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", " ", "  ", "\n", "\t", "1", "é", "中", "!", "<|endoftext|>", "<|", "😀", " ", "\x85", "\x1c", "²", "́", "　", "\x00"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(5000)]
    assert list(tokens._count([t.encode() for t in texts], merges)) == library(texts)


def test_tokens_of_unbroken_runs(library, merges):
    draw = random.Random(3)
    texts = ["a" * n for n in (1, 2, 3, tokens.LONG - 1, tokens.LONG, tokens.LONG + 1, 50_001)]
    texts += ["".join(draw.choice("abcdefghij") for _ in range(40_000)), "中国人" * 3000, "ab" * 5000 + "a", " " * 9999 + "x", "!" * 12_345]
    assert list(tokens._count([t.encode() for t in texts], merges)) == library(texts)


def test_tokens_on_hard_rows(spark, library):
    rows = [(1, None, 9), (2, "", 9), (3, "  \n", 9), (None, "one two", 9), (4, "one two", 9), (4, "one two", 9), (5, "<|endoftext|>a<|endoftext|>", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(docs, PATH).collect())
    assert got == [(0, 7, 2), (1, 0, 0), (2, 0, 0), (3, 3, *library(["  \n"])), (4, 7, 2), (4, 7, 2), (5, 27, 3)]
    assert tokens.count_tokens(docs.limit(0), PATH).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.Merges(public_tokenizers.path("word_bpe_49k.json"))


# --- prefix trie -------------------------------------------------------------------------


def plain_trie(rows: list[tuple]) -> set[tuple]:
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: tuple(x for _, x in sorted(t)) for c, t in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), ())[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)

    def saved(path: tuple) -> int:
        return (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)

    out = set()
    for path, ids in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in ids if rebuilt[c] == path)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]), sum(not children[p] for p in under), sum(map(saved, under)), digest))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(spark, rows):
    data = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, digest string, depth int").repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(data).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def conversations(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for c in [*range(40), 103, 104, -1, -3, -5, -7, -12]:
        for turn in range(draw.choice([1, 2, 3, 9, 12])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "é", "b" * 30])))
    rows += [(200, None, None, None), (200, 0, "user", "a"), (201, 1, "user", None), (201, 1, "user", None), (201, 1, "assistant", "same turn"), (None, 0, "user", "no id")]
    return rows


def test_trie_equals_plain(spark):
    """Ties, nulls, negative and missing bases."""
    rows = conversations(5)
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_families_hand_nodes_on(monkeypatch):
    """A family that hands its nodes on again and again gives the nodes of one that holds them all."""
    turns = sorted((c - int(math.fmod(c, 5)), c != c - int(math.fmod(c, 5)), c, t or -1, f"{r}{x}") for c, t, r, x in conversations(5) if c is not None)
    batch = pa.RecordBatch.from_pylist([{"base": b, "conv": c, "shared": zlib.crc32(str(c).encode()) % 9, "digest": hashlib.sha256(x.encode()).digest(), "bytes": len(x)} for b, _, c, _, x in turns])

    def merged(limit):
        monkeypatch.setattr(trie, "HELD", limit)
        out = defaultdict(lambda: [0, 10**9, []])
        for part in trie._build(iter([batch])):
            for r in part.to_pylist():
                node = out[r["base"], r["digest"], r["parent"], r["depth"], r["bytes"]]
                node[0] += r["n"]
                node[1] = min(node[1], r["conv"])
                node[2] = sorted(node[2] + r["ends"])
        return dict(out)

    assert merged(3) == merged(10**6)


def test_trie_of_long_and_common_conversations(spark):
    rows = [(c, t, "user", "same") for c in range(0, 300) for t in range(3)] + [(1000, t, "user", f"turn {t % 7}") for t in range(400)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_empty_trie(spark):
    assert trie_rows(spark, [(None, 0, "user", "x")]) == set()


# --- hard negatives ----------------------------------------------------------------------


def plain_negatives(rows: list[tuple]) -> list[tuple]:
    """rows: id, label, whole components, is_anchor."""
    live = [(i, label, q, a) for i, label, q, a in rows if label is not None and q is not None]
    out = []
    for n, (anchor, label, q, is_anchor) in enumerate(live):
        if not is_anchor:
            continue
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(q, other[2], strict=False)))), other) for k, other in enumerate(live) if k != n]  # a missing component is 0
        order = sorted(scored, key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))
        for p_score, p in [s for s in order if s[1][1] == label][:5]:
            fit = [s for s in order if s[1][1] != label and 30 * p_score <= 100 * s[0] <= 90 * p_score][:10]
            out += [(anchor, p[0], rank, s[1][0], p_score, s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, schema="id long, label int, q array<int>, is_anchor boolean, row string, cell int"):
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(4)
    return sorted((tuple(r) for r in negatives.hard_negatives(data).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_plain(spark, seed):
    """Ties (few distinct values), copies, repeated ids, shorter, empty and zero vectors, null ids and labels."""
    draw = random.Random(seed)
    rows = []
    for i in range(400):
        q = [draw.randint(-3, 6) for _ in range(draw.choice([8, 8, 8, 5, 0]))]
        rows.append((draw.choice([i, i, 7, None]), draw.choice([0, 0, 0, 1, 2, None]), q if i % 31 else None, i % 20 == 0))
    rows += rows[:40] + [(1000 + i, 1, [1, 2, 3, 4, 5, 6, 7, 8], False) for i in range(50)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_large_components(spark):
    big = 2**31 - 1
    rows = [(0, 1, [big, big, -big], True), (1, 1, [big, big, big], False), (2, 2, [big, big // 2, big], False), (3, 2, [big, 0, 0], False), (4, 2, [big // 2, 0, 1], False), (5, 1, [-big, 0, 0], False)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_blocks(spark, monkeypatch):
    """Many blocks of anchors and small tiles give what one block gives."""
    draw = np.random.default_rng(1)
    rows = [(i, int(draw.integers(4)), [int(x) for x in draw.integers(-60, 100, 16)], i % 3 == 0) for i in range(300)]
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_without_rows(spark):
    assert mined(spark, [(1, None, [1], True), (2, 1, None, True)]) == []
    assert mined(spark, [(1, 1, [1], False), (2, 1, [1], None)]) == []


def test_quantised(spark):
    rows = [(0, [0.5, -0.001]), (1, [1e30, -1e30]), (2, [float("nan"), 1.0]), (3, [float("inf")]), (4, [None, 1.0]), (5, None), (6, [])]
    data = spark.createDataFrame(rows, "i int, v array<float>").select("i", negatives.quantised(F.col("v")).alias("q"))
    assert {r["i"]: r["q"] for r in data.collect()} == {0: [128, -1], 1: [2**31 - 1, -(2**31)], 2: None, 3: None, 4: None, 5: None, 6: []}
