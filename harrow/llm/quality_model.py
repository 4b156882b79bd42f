"""Quality classifier: a byte-level convolutional network in numpy.

Every text is cut into chunks that overlap by the filter width less one, so that each run of
bytes under a filter lies in exactly one chunk and the whole document is covered. A learned
filter's answer at a place is a sum of table rows (byte embedding times filter tap), the
greatest answer in a chunk is kept, and the document is the mean and the maximum over its chunks.
A small hidden layer turns these into one probability.

The fit is on the driver, from a bounded sample of labelled rows (SAMPLE_ROWS per class, by
hash of the id); fit and scoring both read all chunks of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

WIDTH, FILTERS, DIMS, HIDDEN = 6, 32, 8, 16
#: Filter places of a chunk; a chunk is WIDTH - 1 bytes longer.
PLACES = 250
CHUNK = PLACES + WIDTH - 1
#: Rows per class that the fit takes at most.
SAMPLE_ROWS = 1500
#: Bytes of text per class at most; longer texts are not sampled.
SAMPLE_BYTES = 32 << 20
STEPS, BATCH, RATE = 480, 50, 0.004
#: Least score that predicts label 1.
THRESHOLD = 0.3

Params = dict[str, np.ndarray]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def chunks_of(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes, zero-padded; at least one chunk."""
    n = max(1, -(-(len(text) - WIDTH + 1) // PLACES))
    padded = np.zeros(n * PLACES + WIDTH - 1, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::PLACES]


def _tables(p: Params) -> np.ndarray:
    """(WIDTH, 256, FILTERS): what a byte adds to each filter at each tap."""
    return np.einsum("bd,wdf->wbf", p["embed"], p["taps"]).astype(np.float32)


def _pooled(chunks: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Greatest answer of each filter in each chunk, and its place if asked."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    at = np.empty((len(chunks), FILTERS), np.int64) if where else None
    for s in range(0, len(chunks), 32):  # what is in hand fits a cache
        c = chunks[s : s + 32]
        answer = tables[0][c[:, :PLACES]]
        for j in range(1, WIDTH):
            answer += tables[j][c[:, j : j + PLACES]]
        if where:
            at[s : s + 32] = answer.argmax(axis=1)
        out[s : s + 32] = answer.max(axis=1)
    return out, at


def _head(p: Params, mean: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.concatenate([mean, top], axis=1)
    h = np.tanh(x @ p["w1"] + p["b1"])
    return x, h, 1 / (1 + np.exp(-(h @ p["w2"] + p["b2"][0])))


def score_chunks(p: Params, tables: np.ndarray, chunks: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    pooled = np.tanh(_pooled(chunks, tables)[0] / 4)
    first = np.searchsorted(owner, np.arange(n))
    mean = np.add.reduceat(pooled, first, axis=0) / np.bincount(owner, minlength=n)[:, None]
    return _head(p, mean, np.maximum.reduceat(pooled, first, axis=0))[2]


def gradients(p: Params, pieces: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Params:
    """Of the log loss over all chunks of each text, weighted; weights sum to one."""
    chunks = np.concatenate(pieces)
    sizes = np.array([len(c) for c in pieces])
    owner = np.repeat(np.arange(len(pieces)), sizes)
    begins = np.cumsum(sizes) - sizes
    raw, at = _pooled(chunks, _tables(p), where=True)
    pooled = np.tanh(raw / 4)
    mean = np.add.reduceat(pooled, begins, axis=0) / sizes[:, None]
    top = np.maximum.reduceat(pooled, begins, axis=0)
    x, h, y = _head(p, mean, top)
    d = (y - labels) * weights
    g = {"w2": h.T @ d, "b2": np.array([d.sum()])}
    dh = np.outer(d, p["w2"]) * (1 - h * h)
    g |= {"w1": x.T @ dh, "b1": dh.sum(axis=0)}
    dx = dh @ p["w1"].T
    is_top = pooled == top[owner]
    is_top = is_top / np.add.reduceat(is_top, begins, axis=0, dtype=float)[owner]  # equal chunks share it
    dpool = dx[owner, :FILTERS] / sizes[owner, None] + dx[owner, FILTERS:] * is_top
    draw = dpool * (1 - pooled * pooled) / 4
    g |= {"embed": np.zeros_like(p["embed"]), "taps": np.zeros_like(p["taps"])}
    rows, filters = np.indices(at.shape)
    for j in range(WIDTH):  # only the place of the greatest answer passes the gradient on
        byte = chunks[rows, at + j]
        per_byte = np.zeros((256, FILTERS))
        np.add.at(per_byte, (byte.ravel(), filters.ravel()), draw.ravel())
        g["embed"] += per_byte @ p["taps"][j].T
        g["taps"][j] = p["embed"].T @ per_byte
    return g


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Params:
    """Adam on weighted log loss over all chunks of each text."""
    rng = np.random.default_rng(seed)
    p: Params = {
        "embed": rng.normal(0, 0.5, (256, DIMS)), "taps": rng.normal(0, 0.4, (WIDTH, DIMS, FILTERS)),
        "w1": rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.2, HIDDEN), "b2": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    pieces = [chunks_of(t) for t in texts]
    step = 0
    for _ in range(-(-STEPS // -(-len(texts) // BATCH))):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            g = gradients(p, [pieces[i] for i in batch], labels[batch], weights[batch] / weights[batch].sum())
            step += 1
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def is_held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Params | float:
    """Parameters from the labelled rows that are not held out; where these have one class or
    none, a constant score (its label, or 0.5). Labels other than 0 and 1 are none. An id with several labels has
    the greatest, one with several rows is learned from one of them (the least digest). The sample
    holds at most SAMPLE_ROWS ids and SAMPLE_BYTES bytes of a class, in the order of a hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if set(totals) != {0, 1}:
        return float(next(iter(totals))) if totals else 0.5
    sample = []
    for label in (0, 1):
        ids = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "id")
        one = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "label", "t.text")
        so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id"))  # of SAMPLE_ROWS rows
        sample += one.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("id", "label", "text").collect()
    if len({r["label"] for r in sample}) < 2:  # labelled ids that no document has
        return float(sample[0]["label"]) if sample else 0.5
    sample.sort(key=lambda r: (str(r["id"]), r["label"], r["text"]))
    texts = [_bytes(r["text"]) for r in sample]
    y = np.array([r["label"] for r in sample], float)
    weights = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    return fit(texts, y, weights)


def score(docs: DataFrame, model: Params | float, text_col: str = "text"):
    """A column with each text's score. Null and empty texts are one chunk of zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        tables = None if isinstance(m, float) else _tables(m)
        for texts in batches:
            if tables is None:
                yield pd.Series(np.full(len(texts), m))
                continue
            out, held, size = [], [], 0
            for t in texts:
                c = chunks_of(_bytes(t))
                if held and size + len(c) > 8192:
                    out.append(_scores(m, tables, held))
                    held, size = [], 0
                held.append(c)
                size += len(c)
            if held:
                out.append(_scores(m, tables, held))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return F.pandas_udf(run, T.DoubleType())(F.col(text_col))


def _scores(m: Params, tables: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    owner = np.repeat(np.arange(len(held)), [len(c) for c in held])
    return score_chunks(m, tables, np.concatenate(held), owner, len(held))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Labels, ids, languages and sources are no inputs of a score. Repeated rows are scored each
    for itself; a null id counts as the empty string for the split and is never learned from; empty tables give an empty
    result; other columns are ignored. No shuffle of texts.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    out = rows.select(id_col, is_held_out(id_col).alias("held_out"), score(rows, model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
