"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (ten consecutive words; a shorter item is one window) are sets of shingles
with positions. A document contains a window only if it contains each of its shingles, so the
rarest one - by its count over all documents - is a necessary prefix token. Documents give
only the places of prefix tokens; a join on the token brings the windows, the token's offset in
the window bounds where the window must start and the text's length where it must end, and the
words there are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_LOWER_TABLE, Words, bit_filter, checked_broadcast, in_filter, materialize, read, slices

WINDOW = 10
#: Words of a shingle; a window of fewer words has one shingle of all of them.
SHINGLE = 5
#: Windows up to which their table is broadcast (about 200 bytes each).
BROADCAST_WINDOWS = 100_000
#: Size of the fixed filters: 2**24 bits are 2 MB.
FILTER_BITS = 24


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of each shingle of one size; the size is part of the hash."""
    h, whole = words.grams(size, salt=size)
    at = np.flatnonzero(whole)
    return at, h[at]


def _items(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> a row for each shingle of each window of the item."""
    for b in batches:
        for begin, texts in slices(b, "text"):
            rows: dict[str, list] = {k: [] for k in ("item_id", "window", "size", "offset", "shingle", "token")}
            for i, t in enumerate(texts):
                w = Words([t], ALNUM_LOWER_TABLE)
                words = [w.data[s:e].decode("utf-8", "replace") for s, e in zip(w.starts, w.ends, strict=True)]
                size = min(window, len(words))
                if not size:
                    continue
                k = min(shingle, size)
                tokens = _shingles(w, k)[1].view(np.int64).tolist()
                for at in range(len(words) - size + 1):
                    for o in range(size - k + 1):
                        for key, v in zip(rows, (b.column("item_id")[begin + i].as_py(), " ".join(words[at : at + size]), size, o, k, tokens[at + o]), strict=True):
                            rows[key].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("item_id", pa.string()), ("window", pa.string()), ("size", pa.int32()), ("offset", pa.int32()), ("shingle", pa.int32()), ("token", pa.int64())]))


def _counts(batches: Iterator[pa.RecordBatch], sizes: list[int], bits) -> Iterator[pa.RecordBatch]:
    """(text) -> token, n: partial counts of the tokens that pass the filter."""
    for b in batches:
        for _, texts in slices(b, "text"):
            w = Words(texts, ALNUM_LOWER_TABLE)
            h = np.concatenate([_shingles(w, k)[1] for k in sizes])
            token, n = np.unique(h[in_filter(bits.value, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])


_PLACES = "row long, n_words long, token long, at int, lead int, around string"


def _places(batches: Iterator[pa.RecordBatch], sizes: list[int], window: int, bits) -> Iterator[pa.RecordBatch]:
    """(..., text) -> for each row one line with its number of words, and one for each place of
    a prefix token, with the words around that a window could cover. `row` numbers the rows."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    names = [f.split()[0] for f in _PLACES.split(", ")]
    for b in batches:
        for begin, texts in slices(b, "text"):
            w = Words(texts, ALNUM_LOWER_TABLE)
            rows = np.arange(number + begin, number + begin + len(texts))
            out = [pa.array(rows), pa.array(w.counts.astype(np.int64)), pa.nulls(len(rows), pa.int64()), *[pa.nulls(len(rows), pa.int32())] * 2, pa.nulls(len(rows), pa.string())]
            yield pa.RecordBatch.from_arrays([*out, b.column("id").slice(begin, len(texts))], [*names, "id"])
            for k in sizes:
                at, h = _shingles(w, k)
                hit = in_filter(bits.value, h)
                at, h = at[hit], h[hit]
                for s in range(0, len(at), 10_000):
                    p, token = at[s : s + 10_000], h[s : s + 10_000]
                    text = w.text[p]
                    left = np.maximum(p - (window - k), w.first[text])
                    right = np.minimum(p + window, w.first[text + 1])
                    around = [b" ".join(w.data[x:y].split()).decode("utf-8", "replace") for x, y in zip(w.starts[left], w.ends[right - 1], strict=True)]
                    out = [pa.array(rows[text]), pa.nulls(len(p), pa.int64()), pa.array(token.view(np.int64)), *(pa.array((p - x).astype(np.int32)) for x in (w.first[text], left)), pa.array(around, pa.string())]
                    yield pa.RecordBatch.from_arrays([*out, pa.nulls(len(p), b.schema.field("id").type)], [*names, "id"])
        number += b.num_rows


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted item ids as strings).

    Texts are lower-cased (A-Z); words are runs of ASCII letters and digits and of anything
    beyond ASCII. A word is hit if an occurrence of some item's window covers it. Null and empty
    texts have no words and no windows; items without an id are left out; items with the same
    id are one item; repeated document rows each get a row. Empty tables on either side give no
    hits. Other columns are ignored. The benchmark may be of any size: its table of windows is
    broadcast only up to BROADCAST_WINDOWS rows, and joined by a shuffle beyond.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    shingles = materialize(items.mapInArrow(lambda it: _items(it, window, shingle), "item_id string, window string, size int, offset int, shingle int, token long"))
    sizes = sorted(r[0] for r in shingles.select("shingle").distinct().collect())  # at most `shingle` of them
    if not sizes:
        sizes = [shingle]

    known = sc.broadcast(bit_filter(shingles, "token", FILTER_BITS))
    counts = texts.mapInArrow(lambda it: _counts(it, sizes, known), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # the rarest token of each window that occurs at all; ties by token, then offset
    rarest = shingles.join(materialize(counts), "token", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("p"))
    prefixes = materialize(rarest.where("p.n > 0").select("window", "size", "p.token", "p.offset"))
    owners = materialize(shingles.select("window", "item_id").distinct())

    wanted = sc.broadcast(bit_filter(prefixes, "token", FILTER_BITS))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    places = materialize(rows.mapInArrow(lambda it: _places(it, sizes, window, wanted), f"{_PLACES}, id {id_type}"))
    met = places.where(F.col("token").isNotNull()).join(checked_broadcast(prefixes, BROADCAST_WINDOWS), "token")
    # positional bound on the left, length bound on the right, then the words themselves
    start = F.col("lead") - F.col("offset")
    met = met.where(start >= 0).withColumn("words", F.split("around", " ")).where(start + F.col("size") <= F.size("words"))
    met = met.where(F.array_join(F.slice("words", start + 1, F.col("size")), " ") == F.col("window"))
    met = met.select("row", "window", (F.col("at") - F.col("offset")).alias("start"), "size").distinct()
    met = materialize(met)
    # hit words: each occurrence adds what lies beyond the end of those before it
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = met.select("row", "start", "size").distinct().select("row", F.greatest(F.lit(0), fresh).alias("fresh")).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    of_items = met.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    per_row = hits.join(of_items, "row")
    out = places.where(F.col("n_words").isNotNull()).select("row", "id", "n_words").join(per_row, "row", "left")
    own = [F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit")]
    return out.select(*own, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The document rows without a hit word, with all their columns. Rows that share an id are
    judged together: a hit in one removes all."""
    hit = materialize(contamination(docs, benchmark, id_col, **columns).where("n_hit > 0").select(F.col(id_col).alias("_hit")).distinct())
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("_hit")), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE len(w) >= n)
), met AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM met)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
