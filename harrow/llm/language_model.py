"""Language-model scoring.

Two scores for every text. The base score comes from word counts over all training documents.
The model is a causal self-attention network in numpy over subword ids. Their byte-pair vocabulary
is learned from the FIT_WORDS most frequent training words and spells every other word too; a public
one can be named instead. Texts are turned into ids once, as a table. A place is embedded by its id and, through hashed tables, by its last two and last three
ids. Texts are read in overlapping windows of SPAN ids that advance by STRIDE: the first
SPAN - STRIDE ids of a later window are context only, so each id is scored once, with at least
that much context. The softmax has two levels, a group of ids and the id in its group.

Training is data-parallel: in each of ROUNDS, every partition goes on from the shared parameters
over every ROUNDS-th window of each of its training documents, so that the rounds together read
every id of all training text once; then the parameters are averaged, rows of tables by how often
each partition used them. The first parameters give every id its frequency in the training words.
What is gathered - word counts and ids - grows with the corpus; the parameters do not. A partition holds a bounded number of windows at a time. The parameters
depend on how rows are dealt to partitions (each goes its own way within a round), so another layout
gives slightly other scores; base scores do not depend on it.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_LOWER_TABLE, materialize, read, slices

#: A public vocabulary that can stand for the learned one, as can another file of the same kind. Only the driver reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCAB = 2048
#: Frequent words that a vocabulary is learned from.
FIT_WORDS = 1 << 14
END = VOCAB  # the id after each text
GROUP = 64
GROUPS = VOCAB // GROUP + 1
DIMS, HIDDEN, SPAN, STRIDE = 24, 32, 32, 24
#: Rows of the tables of the last two and the last three ids.
PAIRS, TRIPLES = 1 << 14, 1 << 15
ROUNDS = 2
#: Windows that a task shuffles and trains on at once.
WINDOWS_AT_HAND = 96 * 64
#: Windows of a step: the first number, as many more every GROW_STEPS steps, the second at most. Small partitions
#: so take as many steps as they can.
BATCH, LARGEST_BATCH, GROW_STEPS = 48, 192, 400
#: Optimiser steps that a partition makes at least in a round; a small one repeats its windows for them.
MIN_STEPS = 150
RATE, TABLE_RATE = 0.01, 0.1
#: Rows in a block of a table that is averaged, and the first level of that sum.
BLOCK, FIRST_LEVEL = 1 << 12, 64
#: Windows that a task scores at once.
WINDOWS_AT_ONCE = 96
#: Words whose counts are sent to every task, at most; the others are counted by a join.
HOT_WORDS = 1 << 17
#: Distinct words that a task holds while it counts.
COUNTER_WORDS = 300_000
#: Words whose ids a task keeps at hand.
KEPT_WORDS = 100_000
#: Ids of texts that a task scores at once, at least.
IDS_AT_ONCE = 1 << 16

Params = dict[str, np.ndarray]


def read_ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if int(b) < VOCAB}


def encoder(ranks: dict[bytes, int] | None = None) -> tiktoken.Encoding:
    return tiktoken.Encoding("cut", pat_str=r" ?[^ ]+", mergeable_ranks=ranks or read_ranks(), special_tokens={})


def learn_ranks(counts: dict[bytes, int], size: int | None = None) -> dict[bytes, int]:
    """Byte-pair ranks of words behind a space: all bytes, then again and again the pair of neighbours that is most
    frequent, until there are `size` (VOCAB). Of equally frequent pairs the smaller bytes come first."""
    words, times = [[bytes([b]) for b in b" " + w] for w in counts], [*counts.values()]
    pairs: defaultdict[tuple, int] = defaultdict(int)
    where: defaultdict[tuple, set] = defaultdict(set)
    for i, w in enumerate(words):
        for pair in zip(w, w[1:], strict=False):
            pairs[pair] += times[i]
            where[pair].add(i)
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    ranks = {bytes([b]): b for b in range(256)}
    while heap and len(ranks) < (size or VOCAB):
        n, pair = heapq.heappop(heap)
        if n + pairs[pair]:  # out of date; the present count is in the heap too
            continue
        joined = pair[0] + pair[1]
        ranks.setdefault(joined, len(ranks))
        changed = set()
        for i in where.pop(pair):
            old, new = words[i], []
            for part in old:
                if new and new[-1] == pair[0] and part == pair[1]:
                    new[-1] = joined
                else:
                    new.append(part)
            for sign, w in ((-1, old), (1, new)):
                for p in zip(w, w[1:], strict=False):
                    pairs[p] += sign * times[i]
                    changed.add(p)
            for p in zip(new, new[1:], strict=False):
                where[p].add(i)
            words[i] = new
        for p in changed:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return ranks


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SPACE_LOWER_TABLE).split()


class WordIds(dict):
    """Ids of a word behind a space; bytes that are not UTF-8 become replacement marks. The vocabulary
    never joins words, so a text's ids are those of its words. Holds KEPT_WORDS words at most."""

    def __init__(self, ranks: dict[bytes, int] | None = None):
        super().__init__()
        self.encode = encoder(ranks).encode_ordinary

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[word] = self.encode(" " + word.decode("utf-8", "replace"))
        return ids

    def of(self, words: list[bytes]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, words)))


# --- the network ------------------------------------------------------------------------

TABLES = ("embed", "pairs", "triples")


def new_params(seed: int = 11) -> Params:
    rng = np.random.default_rng(seed)
    n = GROUPS * GROUP
    p = {
        "embed": rng.normal(0, 0.3, (n, DIMS)), "pairs": np.zeros((PAIRS, DIMS)), "triples": np.zeros((TRIPLES, DIMS)),
        "qkv": rng.normal(0, DIMS**-0.5, (DIMS, 3 * DIMS)),
        "near": -0.1 * np.arange(SPAN, dtype=float),  # bias by distance
        "mix": rng.normal(0, DIMS**-0.5, (DIMS, HIDDEN)), "mix_b": np.zeros(HIDDEN), "back": rng.normal(0, HIDDEN**-0.5, (HIDDEN, DIMS)),
        # weights of both softmax levels, the bias as last row
        "group": rng.normal(0, 0.1, (DIMS + 1, GROUPS)), "inner": rng.normal(0, 0.1, (GROUPS, DIMS + 1, GROUP)),
    }
    return {k: v.astype(np.float32) for k, v in _without_gaps(p).items()}


def _without_gaps(p: Params) -> Params:
    """Ids behind the end do not exist."""
    p["inner"][-1, -1, 1:] = -30.0
    return p


def first_params(counts: np.ndarray) -> Params:
    """Parameters whose biases give each id its share of `counts` (GROUPS * GROUP,), half a time added."""
    p = new_params()
    n = counts + 0.5
    n[VOCAB + 1 :] = 1e-9
    by_group = n.reshape(GROUPS, GROUP)
    p["group"][-1] = np.log(by_group.sum(axis=1) / n.sum())
    p["inner"][:, -1] = np.log(by_group / by_group.sum(axis=1, keepdims=True))
    return _without_gaps(p)


_CAUSAL = np.tril(np.ones((SPAN, SPAN), bool))
_BACK = np.clip(np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :], 0, SPAN - 1)
#: Scores are held to this range before an exponential, so no maximum has to be taken away.
CLIP = np.float32(60)


def _exp_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), in place, and its sum over the last axis (a product with ones is the fast sum)."""
    np.exp(np.clip(z, -CLIP, CLIP, out=z), out=z)
    return z, z @ np.ones(z.shape[-1], z.dtype)


def _embedded(p: Params, x: np.ndarray) -> np.ndarray:
    e = np.take(p["embed"], x[0], axis=0)
    e += np.take(p["pairs"], x[1], axis=0)
    e += np.take(p["triples"], x[2], axis=0)
    return e


def _attention(p: Params, near: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weights of queries, keys and values (queries scaled), these three, scores that are not yet shares, and what
    makes them shares. The division comes after the product with the values: there are fewer of those."""
    w = p["qkv"].copy()
    w[:, :DIMS] *= w.dtype.type(DIMS**-0.5)
    q, k, v = (a.reshape(e.shape) for a in np.split(e.reshape(-1, DIMS) @ w, 3, axis=1))
    s = q @ k.transpose(0, 2, 1)
    np.exp(np.clip(s, -CLIP, CLIP, out=s), out=s)
    s *= near
    return w, q, k, v, s, 1 / (s @ np.ones(s.shape[-1], s.dtype))[..., None]


def _near(p: Params) -> np.ndarray:
    return np.where(_CAUSAL, np.exp(p["near"][_BACK]), 0)


def _forward(p: Params, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """x (3, B, SPAN), rows of the three tables -> hidden states (B, SPAN, DIMS), and what the
    backward pass needs."""
    e = _embedded(p, x)
    w, q, k, v, s, share = _attention(p, _near(p), e)
    a = s @ v
    a *= share
    h = e + a
    m = h.reshape(-1, DIMS) @ p["mix"]
    m += p["mix_b"]
    np.maximum(m, 0, out=m)
    top = m @ p["back"]
    top += h.reshape(-1, DIMS)
    return top.reshape(h.shape), (e, w, q, k, v, s, share, a, h, m)


def _by_group(h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by the group of y, the rows in it with a one behind, groups, places, bounds."""
    g = (y // GROUP).astype(np.uint8)
    order = np.argsort(g, kind="stable")
    h1 = np.empty((len(y), DIMS + 1), h.dtype)
    h1[:, :-1] = h[order]
    h1[:, -1] = 1
    g = g[order]
    return order, h1, g, (y % GROUP)[order], np.searchsorted(g, np.arange(GROUPS + 1))


def _inner(h1: np.ndarray, inner: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    z = np.empty((len(h1), GROUP), h1.dtype)
    for c, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if e > s:
            np.matmul(h1[s:e], inner[c], out=z[s:e])
    return z


def log_probs(p: Params, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each next id y (n,) from hidden states h (n, DIMS)."""
    order, h1, g, i, bounds = _by_group(h, y)
    rows = np.arange(len(y))
    total = np.zeros(len(y))
    for z, at in ((h1 @ p["group"], g), (_inner(h1, p["inner"], bounds), i)):
        total += np.clip(z[rows, at], -CLIP, CLIP)
        total -= np.log(_exp_sums(z)[1])
    out = np.empty(len(y))
    out[order] = total
    return out


def score_windows(p: Params, near: np.ndarray, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Log probabilities of the places in use, in row order. Only places that are scored pass the last layers."""
    e = _embedded(p, x)
    _, _, _, v, s, share = _attention(p, near, e)
    a = s @ v
    a *= share
    e += a
    at = np.flatnonzero(used)
    h = np.take(e.reshape(-1, DIMS), at, axis=0)
    m = h @ p["mix"]
    m += p["mix_b"]
    np.maximum(m, 0, out=m)
    h += m @ p["back"]
    return log_probs(p, h, y.ravel()[at])


def _gradients(p: Params, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[Params, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of the mean log loss over the places `used` of windows x with next ids y: gradients of the dense
    parameters; and for each table its rows in use, their gradients, and how often they are used."""
    top, (e, w, q, k, v, s, share, a, h, m) = _forward(p, x)
    at = np.flatnonzero(used)
    flat = lambda z: z.reshape(-1, z.shape[-1])
    hs, ys = np.take(flat(top), at, axis=0), y.ravel()[at]
    order, h1, g, i, bounds = _by_group(hs, ys)
    rows = np.arange(len(ys))
    one = top.dtype.type(1 / len(ys))

    def softmax_less_hit(z: np.ndarray, hit: np.ndarray) -> np.ndarray:
        z, total = _exp_sums(z)
        z *= (one / total)[:, None]
        z[rows, hit] -= one
        return z

    z = softmax_less_hit(h1 @ p["group"], g)
    grad: Params = {"group": h1.T @ z}
    dh = z @ p["group"][:-1].T
    z = softmax_less_hit(_inner(h1, p["inner"], bounds), i)
    grad["inner"] = np.zeros_like(p["inner"])
    for c, (b, d) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if d > b:
            np.matmul(h1[b:d].T, z[b:d], out=grad["inner"][c])
            dh[b:d] += z[b:d] @ p["inner"][c, :-1].T
    dtop = np.zeros_like(flat(top))
    dtop[at[order]] = dh
    grad["back"] = m.T @ dtop
    dm = dtop @ p["back"].T
    dm *= m > 0
    grad |= {"mix": flat(h).T @ dm, "mix_b": dm.sum(axis=0)}
    dtop += dm @ p["mix"].T
    d = dtop.reshape(top.shape)
    u = d * share
    ds = u @ v.transpose(0, 2, 1)
    ds -= np.einsum("bid,bid->bi", a, u)[..., None]
    ds *= s
    grad["near"] = np.bincount(_BACK.ravel(), (ds.sum(axis=0) * _CAUSAL).ravel(), SPAN)
    dqkv = np.concatenate([flat(ds @ k), flat(ds.transpose(0, 2, 1) @ q), flat(s.transpose(0, 2, 1) @ u)], axis=1)
    grad["qkv"] = flat(e).T @ dqkv
    grad["qkv"][:, :DIMS] *= w.dtype.type(DIMS**-0.5)
    dtop += dqkv @ w.T
    return grad, {name: _by_row(row.ravel(), dtop) for name, row in zip(TABLES, x, strict=True)}


def _by_row(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the sums of their values, and how often they occur. Rows are below 2**16."""
    row = row.astype(np.uint16)
    order = np.argsort(row, kind="stable")
    row = row[order]
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    times = np.diff(begins, append=len(row))
    sums = np.take(values, order[begins], axis=0)
    more = np.flatnonzero(times > 1)
    if len(more):
        own = np.repeat(times > 1, times)
        size = times[more]
        sums[more] = np.add.reduceat(np.take(values, order[own], axis=0), np.cumsum(size) - size, axis=0)
    return row[begins].astype(np.int64), sums, times


class Trainer:
    """Goes on from given parameters: Adam for dense ones; rows of tables by the root of their own summed
    squares (only rows in use are touched)."""

    def __init__(self, p: Params, seed: int):
        self.p = {k: v.copy() for k, v in p.items() if k in TABLES}
        # dense parameters are views of one array, which is updated as a whole
        self.names = [k for k in p if k not in TABLES]
        self.dense = np.concatenate([p[k].ravel() for k in self.names])
        at = 0
        for k in self.names:
            self.p[k] = self.dense[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        self.first, self.second = np.zeros_like(self.dense), np.zeros_like(self.dense)
        self.squares = {k: np.full(len(p[k]), 1e-8, np.float32) for k in TABLES}
        self.uses = {k: np.zeros(len(p[k]), np.float32) for k in TABLES}
        self.rng, self.steps, self.weight = np.random.default_rng(seed), 0, 0.0

    def step(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> None:
        dense, tables = _gradients(self.p, x, y, used)
        self.steps += 1
        self.weight += float(used.sum())
        rate = RATE / (1 + self.steps / 1000) ** 0.5
        g = np.concatenate([dense[k].ravel() for k in self.names], dtype=np.float32)
        self.first *= np.float32(0.9)
        self.first += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.01)
        self.second *= np.float32(0.99)
        self.second += g
        np.multiply(self.second, np.float32(1 / (1 - 0.99**self.steps)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-7)
        np.divide(self.first, g, out=g)
        g *= np.float32(rate / (1 - 0.9**self.steps))
        self.dense -= g
        for k, (rows, g, times) in tables.items():
            self.squares[k][rows] += np.einsum("rd,rd->r", g, g) / np.float32(DIMS)
            g *= (np.float32(TABLE_RATE) / np.sqrt(self.squares[k][rows]))[:, None]
            self.p[k][rows] -= g
            self.uses[k][rows] += times

    def windows(self, x: np.ndarray, y: np.ndarray, used: np.ndarray, steps: int | None = None) -> None:
        """Once over the windows in a seeded order, `steps` steps at most."""
        order = self.rng.permutation(len(y))
        s, last = 0, None if steps is None else self.steps + steps
        while s < len(order) and self.steps != last:
            at = order[s : s + min(LARGEST_BATCH, BATCH * (1 + self.steps // GROW_STEPS))]
            self.step(x[:, at], y[at], used[at])
            s += len(at)


def windows_of(texts: list[list[int]], stride: int = STRIDE, every: int = 1, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts given as ids: rows of the three tables (3, B, SPAN; each text begins with END),
    next ids, which places to score, and the text of each window. Of a text's windows those whose
    number and the text's own first id, plus shift, are divisible by `every`."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1  # ids to score, the end included
    begins = np.cumsum(sizes + 1) - sizes - 1
    seq = np.full(int(sizes.sum()) + len(texts), END, np.int32)
    within = np.ones(len(seq), bool)
    within[begins] = within[begins + sizes] = False
    seq[within] = np.concatenate([np.asarray(t, np.int32) for t in texts]) if len(texts) else 0
    back = np.concatenate([[END, END], seq]).astype(np.uint32)
    now = back[2:]
    pair = (back[1:-1] * np.uint32(0x9E3779B1) + now * np.uint32(0x85EBCA77)) >> np.uint32(4)
    triple = ((pair ^ (back[:-2] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)) >> np.uint32(12)
    # the ids before a text are ends, whatever text stands before it
    for place, n in ((begins, 2), (begins + 1, 1)):
        one = now[place - 1] if n == 1 else np.full(len(place), END, np.uint32)
        first = (one * np.uint32(0x9E3779B1) + now[place] * np.uint32(0x85EBCA77)) >> np.uint32(4)
        pair[place] = first
        triple[place] = ((first ^ np.uint32((END * 0xC2B2AE3D) & 0xFFFFFFFF)) * np.uint32(0x27D4EB2F)) >> np.uint32(12)
    pair, triple = (pair % PAIRS).astype(np.int32), (triple % TRIPLES).astype(np.int32)
    counts = -(-np.maximum(1, sizes - (SPAN - stride)) // stride)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    if every > 1:
        take = (nth + seq[begins + 1][owner] + shift) % every == 0
        owner, nth = owner[take], nth[take]
    at = (nth * stride)[:, None] + np.arange(SPAN)
    inside = at < sizes[owner][:, None]
    used = inside.copy()
    used[nth > 0, : SPAN - stride] = False
    at += begins[owner][:, None]
    at *= inside  # a place that is not used reads the first text's END
    x = np.empty((3, *at.shape), np.int32)
    for part, of in zip(x, (seq, pair, triple), strict=True):
        np.take(of, at, out=part, mode="clip")
    at += 1
    y = np.take(seq, at)
    y[~inside] = END
    return x, y, used, owner


# --- distributed passes ------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> word, n: partial counts over training documents; the end is a null word."""

    def flush(counts: Counter, ends: int) -> pa.RecordBatch:
        words = pa.array([*counts], pa.binary())
        words = pa.concat_arrays([words, pa.nulls(1, pa.binary())])
        return pa.RecordBatch.from_arrays([words, pa.array([*counts.values(), ends], pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    ends = 0
    for b in batches:
        for text in b.column("text").cast(pa.large_binary()):
            counts.update(words_of(text.as_py()))
            ends += 1
            if len(counts) > COUNTER_WORDS:
                yield flush(counts, ends)
                counts, ends = Counter(), 0
    yield flush(counts, ends)


_PARTS = "part string, block int, level int, rows binary, value binary, weight binary"
_PARTS_SCHEMA = pa.schema([("part", pa.string()), ("block", pa.int32()), ("level", pa.int32()), ("rows", pa.binary()), ("value", pa.binary()), ("weight", pa.binary())])


def _part_row(part: str, block: int, level: int, rows: np.ndarray, value: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Rows (int32) of a block of a parameter, their weighted sums and their weights (float32)."""
    cells = [part, block, level, rows.astype(np.int32).tobytes(), value.astype(np.float32).tobytes(), weight.astype(np.float32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _PARTS_SCHEMA, strict=True)], schema=_PARTS_SCHEMA)


def _as_rows(name: str, value: np.ndarray) -> np.ndarray:
    """Tables by their rows; another parameter is one row."""
    return value if name in TABLES else value.reshape(1, -1)


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each text."""
    for ids in batch.column("ids"):
        yield np.frombuffer(ids.as_py(), np.uint16)


def _train_round(batches: Iterator[pa.RecordBatch], params, turn: int) -> Iterator[pa.RecordBatch]:
    """ids -> part, block, level, value, weight: this partition's parameters times their weights."""
    number = TaskContext.get().partitionId() if TaskContext.get() else 0
    trainer = Trainer(params.value, number)
    held: list[np.ndarray] = []
    size, last = 0, None

    def train() -> None:
        nonlocal last
        x, y, used, _ = windows_of(held, SPAN, ROUNDS, turn)
        if len(y):
            trainer.windows(x, y, used)
            last = x, y, used

    for b in batches:
        for ids in _texts(b):
            held.append(ids)
            size += len(ids)
            if size >= WINDOWS_AT_HAND * SPAN * ROUNDS:
                train()
                held, size = [], 0
    if held:
        train()
    # what is repeated counts once in the average: weights are those of the ids read
    weight, uses = trainer.weight, {k: v.copy() for k, v in trainer.uses.items()}
    while last and trainer.steps < MIN_STEPS:
        trainer.windows(*last, steps=MIN_STEPS - trainer.steps)
    trainer.weight, trainer.uses = weight, uses
    if trainer.steps:
        for name, value in _without_gaps(trainer.p).items():
            value = _as_rows(name, value)
            weight = trainer.uses[name] if name in TABLES else np.full(1, trainer.weight)
            for n in range(0, len(value), BLOCK):
                rows = np.flatnonzero(weight[n : n + BLOCK])  # only what this partition has used
                if len(rows):
                    yield _part_row(name, n, number % FIRST_LEVEL, rows, value[n + rows] * weight[n + rows, None], weight[n + rows])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, block and level -> one for each, sums of value and weight."""
    key, sums, weights = None, None, None

    def row() -> pa.RecordBatch:
        rows = np.flatnonzero(weights)
        return _part_row(*key, rows, sums[rows], weights[rows])

    for b in batches:
        for r in b.to_pylist():
            rows, value, weight = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["value"], np.float32), np.frombuffer(r["weight"], np.float32)
            if key != (new := (r["part"], r["block"], r["level"])):
                if key:
                    yield row()
                key, sums, weights = new, np.zeros((BLOCK, len(value) // len(rows))) if r["part"] in TABLES else np.zeros((1, len(value))), np.zeros(BLOCK)
            sums[rows] += value.reshape(len(rows), -1)
            weights[rows] += weight
    if key:
        yield row()


def train(texts: DataFrame, start: Params) -> Params:
    """Parameters from rows of ids, the first ones given; what comes to the driver is one set of parameters. Partitions are
    summed in two levels, so that no task reads more than a FIRST_LEVEL-th of them."""
    sc = texts.sparkSession.sparkContext
    p = start
    for turn in range(ROUNDS):
        shared = sc.broadcast(p)
        parts = texts.mapInArrow(lambda it, s=shared, t=turn: _train_round(it, s, t), _PARTS)
        for level in (F.col("level"), F.lit(0)):
            parts = parts.withColumn("level", level).repartition("part", "block", "level").sortWithinPartitions("part", "block", "level").mapInArrow(_summed, _PARTS)
        p = {k: v.copy() for k, v in p.items()}
        for r in parts.collect():
            rows, value, weight = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["value"], np.float32), np.frombuffer(r["weight"], np.float32)
            _as_rows(r["part"], p[r["part"]])[r["block"] + rows] = value.reshape(len(rows), -1) / weight[:, None]
    return p


class HotWords:
    """The frequent words: values of the base score and ids. Runs of texts get places of words, those
    of other words behind; the ids of these are made once a run."""

    def __init__(self, words: list[bytes], values: np.ndarray, ranks: dict[bytes, int]):
        self.words, self.values, self.ranks = words, values, ranks

    def begin(self) -> HotWords:
        """To be called once a task."""
        self.at = {w: i for i, w in enumerate(self.words)}
        self.encode = encoder(self.ranks).encode_to_numpy
        self.begins = np.zeros(END + 1, bool)  # ids that begin a word
        self.begins[[i for token, i in self.ranks.items() if token[:1] == b" "]] = True
        self.ids, self.sizes = self._ids(self.words)
        return self

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word's behind another's, and how many each has."""
        if not words:
            return np.empty(0, np.uint16), np.empty(0, np.int64)
        ids = self.encode(" " + b" ".join(words).decode("utf-8", "replace")).astype(np.uint16)
        return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Places of the texts' words, the other words, all ids, and how many ids each text has."""
        others: dict[bytes, int] = {}
        known, n = self.at, len(self.words)
        counts = np.array([len(t) for t in texts])
        at = np.fromiter((known[w] if w in known else n + others.setdefault(w, len(others)) for t in texts for w in t), np.int64, int(counts.sum()))
        more, more_sizes = self._ids([*others])
        pool, sizes = np.concatenate([self.ids, more]), np.concatenate([self.sizes, more_sizes])
        begins = (np.cumsum(sizes) - sizes)[at]
        size = sizes[at]
        ends = np.cumsum(size)
        ids = pool[np.repeat(begins - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return at, [*others], ids, np.diff(np.concatenate([[0], ends])[np.cumsum(counts)], prepend=0)


_READ = "row long, n_tokens long, n_known long, base double, ids binary, word binary, n long"
_READ_SCHEMA = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("ids", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])


def _read_texts(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """(id, held_out, text) -> a line per row with sums over hot words and its ids, and lines (row, word, n)
    of its other words. Sums count words only; the end is added later."""
    table = hot.value.begin()
    values, n_hot = np.append(table.values, 0.0), len(table.words)
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

    def lines(size: int, given: dict[str, list | np.ndarray], id_and_split: list[pa.Array]) -> pa.RecordBatch:
        columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in _READ_SCHEMA]
        return pa.RecordBatch.from_arrays([*columns, *id_and_split], [*_READ_SCHEMA.names, "id", "held_out"])

    for b in batches:
        for begin, run in slices(b, "text"):
            texts = [words_of(t) for t in run]
            at, others, ids, sizes = table.read(texts)
            counts = np.array([len(t) for t in texts])
            owner = np.repeat(np.arange(len(run)), counts)
            hit = at < n_hot
            base = np.bincount(owner, values[np.minimum(at, n_hot)], len(run))
            cuts = (2 * np.cumsum(sizes)).tolist()
            data = ids.tobytes()
            rows = number + np.arange(len(run))
            given = {"row": rows, "n_tokens": counts + 1, "n_known": np.bincount(owner, hit, len(run)).astype(np.int64), "base": base, "ids": [data[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]}
            yield lines(len(run), given, [b.column(c).slice(begin, len(run)) for c in ("id", "held_out")])
            pairs, times = np.unique(owner[~hit] * max(1, len(others)) + at[~hit] - n_hot, return_counts=True)
            text, word = np.divmod(pairs, max(1, len(others)))
            given = {"row": rows[text], "word": [others[w] for w in word.tolist()], "n": times}
            yield lines(len(pairs), given, [pa.nulls(len(pairs), b.schema.field(c).type) for c in ("id", "held_out")])
            number += len(run)


def _score(batches: Iterator[pa.RecordBatch], params) -> Iterator[pa.RecordBatch]:
    """Lines with ids -> the same with a score instead."""
    network = params.value
    for b in batches:
        held: list[np.ndarray] = []
        size, scores = 0, [np.empty(0)]
        for ids in _texts(b):
            held.append(ids)
            size += len(ids)
            if size >= IDS_AT_ONCE:
                scores.append(_score_texts(network, held))
                held, size = [], 0
        if held:
            scores.append(_score_texts(network, held))
        yield b.drop_columns(["ids"]).append_column("score", pa.array(np.concatenate(scores)))


def _score_texts(network: Params, held: list) -> np.ndarray:
    """log10 probability of each text, a bounded number of windows at a time."""
    x, y, used, owner = windows_of(held)
    near = _near(network).astype(np.float32)
    out = np.zeros(len(held))
    for s in range(0, len(y), WINDOWS_AT_ONCE):
        part = slice(s, s + WINDOWS_AT_ONCE)
        lp = score_windows(network, near, x[:, part], y[part], used[part])
        out += np.bincount(np.repeat(owner[part], used[part].sum(axis=1)), lp, len(held))
    return out / np.log(10)


def _frequent(counts: DataFrame, most: int) -> list:
    """The rows of greatest n, `most` at most: those above the edge of a histogram of n, so that only
    they come to the driver."""
    step = F.floor(F.log2("n") * 64)
    bins = counts.groupBy(step.alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect()  # 64 a doubling
    total, edge = 0, None
    for r in bins:
        total += r["words"]
        if total > most:
            break
        edge = r["bin"]
    return counts.where(step >= edge).collect() if edge is not None else []


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, the end. A null id counts as the empty string for the
    split. Repeated rows count and are scored each for itself. Without training documents the
    base score is 0 a token and the model keeps its first parameters. An empty table gives an
    empty result; other columns are ignored. `vocabulary` is a file to use instead of learned ranks.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    partial = rows.where("not held_out").select("text").mapInArrow(_count_words, "word binary, n long")
    counts = materialize(partial.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends")).first()
    floor = total["n"] + 0.5 * (total["v"] + 1)
    hot = _frequent(counts.where("word is not null"), HOT_WORDS)
    hot.sort(key=lambda r: (-r["n"], r["word"]))
    words, times = [bytes(r["word"]) for r in hot], np.array([r["n"] for r in hot], float)
    del hot
    ranks = read_ranks(vocabulary) if vocabulary else learn_ranks({w: int(n) for w, n in zip(words[:FIT_WORDS], times[:FIT_WORDS], strict=True)})
    table = HotWords(words, np.log10((times + 0.5) / floor), ranks)
    hot_words = spark.sparkContext.broadcast(table)
    id_type = docs.schema[id_col].dataType.simpleString()
    lines = f"id {id_type}, held_out boolean"
    encoded = materialize(rows.mapInArrow(lambda it: _read_texts(it, hot_words), f"{_READ}, {lines}"))
    table.begin()
    uses = np.bincount(table.ids, np.repeat(times, table.sizes), GROUPS * GROUP)
    uses[END] = total["ends"]
    texts = encoded.where("n_tokens is not null")
    model = spark.sparkContext.broadcast(train(texts.where("not held_out").select("ids"), first_params(uses)))
    scored = texts.drop("word", "n").mapInArrow(lambda it: _score(it, model), f"row long, n_tokens long, n_known long, base double, {lines}, score double")
    other = encoded.where("word is not null").select("row", "word", F.col("n").alias("times")).join(counts, "word", "left")
    value = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(floor)))
    other = other.groupBy("row").agg(F.sum(F.col("times") * value).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    out = scored.join(other, "row", "left")
    end = float(np.log10((total["ends"] + 0.5) / floor))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0)) + F.lit(1 if total["ends"] else 0)).cast("long").alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        "score",
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
