"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 13 runs of eight words inside a window of 20 words, the one
of least hash. The choice depends only on the window's words, so two equal windows carry the
same anchor at the same place, and documents meet by a shuffle on anchors. A seed carries the
words that its windows span. Seeds of one anchor are compared word by word, first the anchor
itself, then one word further to the left and to the right at a time: seeds that still agree
stay in one class. A window that reaches d words left of its anchor is repeated if an earlier
seed agrees over d words to the left and the rest to the right. Runs of repeated windows are the
maximal repeats, and the words they cover are removed. Hashes only bring seeds together; what
counts as equal is decided on the words.

To keep very common passages out of single tasks, each task first settles windows among its own
documents: only the earliest of equal windows goes on, the others are already known to be
repeats. So a passage costs at most one row per input batch, however many documents hold it.
An anchor that still has more than HOT_SEEDS seeds (a common line in ever different
surroundings) is dealt out by its windows: one row per window, by the hash of the window's words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Words, bit_filter, checked_broadcast, in_filter, materialize, read, slices

WINDOW = 20
ANCHOR = 8
#: Fixed size of the filter of repeated anchors: 2**27 bits are 16 MB.
FILTER_BITS = 27
#: Seeds of one anchor that are settled in one task; beyond it they are dealt out by their windows.
HOT_SEEDS = 64
#: Hot anchors up to which their table is broadcast.
BROADCAST_ANCHORS = 500_000


def _anchored(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window inside one text: start word, and start word of its anchor."""
    n = len(words) - window + 1
    whole = words.text[: max(0, n)] == words.text[window - 1 :]
    if not whole.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams, _ = words.grams(anchor, salt=anchor)
    # place of the least hash among the runs from each place on; the leftmost of equal ones
    span, least, width = window - anchor + 1, np.arange(len(grams)), 1

    def lesser(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(grams[y] < grams[x], y, x)

    while width * 2 <= span:
        least = lesser(least[:-width], least[width:])
        width *= 2
    start = np.flatnonzero(whole)
    return start, lesser(least[start], least[start + span - width])


def _anchor_counts(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(text) -> anchor hash, occurrences, partial."""
    for b in batches:
        for _, texts in slices(b, "text"):
            w = Words(texts, SPACE_TABLE)
            _, at = _anchored(w, window, anchor)
            if len(at):
                h, n = np.unique(w.grams(anchor, salt=anchor)[0][np.unique(at)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])


_SEEDS = "anchor long, id long, digest long, start int, n int, at int, span binary, runs binary"
_SEED_SCHEMA = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("span", pa.binary()), ("runs", pa.binary())])


def _numbers() -> defaultdict:
    """A number for each distinct word that is asked for."""
    return defaultdict(count().__next__)


def _refined(classes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes of equal (class, word); words are numbers from -1 on."""
    return np.unique(classes * np.int64(word.max() + 2) + word + 1, return_inverse=True)[1]


def repeated_windows(group: np.ndarray, ids: np.ndarray, digests: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray, base: np.ndarray, words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed and start word of each window that an earlier equal window repeats.

    A seed has n windows from word `start` of its document on; their words stand in `words` (word
    numbers) from `base` on, and the anchor `at` words after that. Only seeds of one group are
    compared. Earlier is a smaller id, or the same id and a smaller start.
    """
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    # in the order that decides what is earlier, for windows at the same distance from their anchor
    sub = many[np.lexsort((digests[many], (start + at)[many], ids[many]))]
    if not len(sub):
        return sub, sub
    n, at, base = (x[sub].astype(np.int64) for x in (n, at, base))
    core, end = base + at, base + n + window - 1

    def word(place: np.ndarray) -> np.ndarray:
        inside = (place >= base) & (place < end)
        return np.where(inside, words[np.where(inside, place, 0)], -1).astype(np.int64)

    classes = np.unique(group[sub], return_inverse=True)[1].astype(np.int64)
    for j in range(anchor):
        classes = _refined(classes, word(core + j))
    reach = window - anchor
    left, right = [classes], [classes]
    for d in range(reach):
        left.append(_refined(left[-1], word(core - 1 - d)))
        right.append(_refined(right[-1], word(core + anchor + d)))
    seeds, starts = [], []
    own_ids, own_core = ids[sub], (start[sub] + at).astype(np.int64)
    for d in range(reach + 1):
        has = np.flatnonzero((at >= d) & (at - d < n))
        if not len(has):
            continue
        _, first, kind = np.unique(left[d][has] * np.int64(len(sub)) + right[reach - d][has], return_index=True, return_inverse=True)
        lead = has[first[kind]]
        # rows of one id and place do not precede each other
        later = (own_ids[has] != own_ids[lead]) | (own_core[has] != own_core[lead])
        seeds.append(sub[has[later]])
        starts.append(own_core[has[later]] - d)
    return np.concatenate(seeds), np.concatenate(starts)


def _runs(start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted window starts of each owner into runs: owner, first start, last start."""
    if not len(start):
        return owner[:0], start[:0], start[:0]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return owner[first], start[first], start[last]


def _seeds(batches: Iterator[pa.RecordBatch], window: int, anchor: int, bits) -> Iterator[pa.RecordBatch]:
    """(id, digest, text) -> the seeds at repeated anchors, settled within the batch.

    Rows with an anchor carry the words of the seed's windows, some of which may be the first of
    their kind; rows without one carry the runs known to be repeats (pairs of start words)."""
    for b in batches:
        all_ids, all_digests = b.column("id").to_numpy(), b.column("digest").to_numpy()
        number, done = _numbers(), 0
        found, data, words = [], [], []
        for begin, texts in slices(b, "text"):
            w = Words(texts, SPACE_TABLE)
            start, at = _anchored(w, window, anchor)
            if not len(at):
                continue
            a = w.grams(anchor, salt=anchor)[0][at]
            ok = in_filter(bits.value, a)
            start, a, at = start[ok], a[ok], at[ok]
            # a seed is an anchor with the consecutive windows that chose it
            opens = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
            n = np.diff(np.concatenate([opens, [len(at)]]))
            start, a, at = start[opens], a[opens], at[opens]
            text = w.text[start]
            found.append((text + begin, start - w.first[text], n, at - start, a, start + done, np.full(len(opens), len(data)), w.starts[start], w.ends[start + n + window - 2]))
            data.append(w.data)
            words.append(np.fromiter(map(number.__getitem__, w.data.split()), np.int32, len(w)))
            done += len(w)
        if not found:
            continue
        doc, start, n, at, a, base, part, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        ids, digests = all_ids[doc], all_digests[doc]
        group = np.unique(a, return_inverse=True)[1] if len(a) else np.empty(0, np.int64)
        seed, later = repeated_windows(group, ids, digests, start, n, at, base, np.concatenate(words), window, anchor)
        known = np.bincount(seed, minlength=len(doc))
        take = np.flatnonzero(known < n)  # some window of theirs is the first here
        for s in range(0, len(take), 20_000):
            t = take[s : s + 20_000]
            span = [data[i][x:y] for i, x, y in zip(part[t].tolist(), lo[t].tolist(), hi[t].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[t].view(np.int64)), pa.array(ids[t]), pa.array(digests[t]), *(pa.array(x[t].astype(np.int32)) for x in (start, n, at)), pa.array(span, pa.binary()), pa.nulls(len(t), pa.binary())], schema=_SEED_SCHEMA
            )
        by = np.lexsort((later, doc[seed]))
        owner, lo, hi = _runs(later[by], doc[seed][by])
        yield _run_rows(all_ids[owner], all_digests[owner], lo, hi, owner)


def _run_rows(ids: np.ndarray, digests: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """One row per owner, with its runs as bytes of int32 pairs."""
    opens = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    ends = np.concatenate([opens[1:], [len(owner)]]).astype(np.int64) if len(opens) else opens
    pairs = np.stack([lo, hi], axis=1).astype(np.int32).tobytes()
    runs = [pairs[s * 8 : e * 8] for s, e in zip(opens.tolist(), ends.tolist(), strict=True)]
    n = len(opens)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(ids[opens]), pa.array(digests[opens]), *[pa.nulls(n, pa.int32())] * 3, pa.nulls(n, pa.binary()), pa.array(runs, pa.binary())], schema=_SEED_SCHEMA)


def _dealt(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Seeds of hot anchors -> a seed for each of their windows, with a salt from its words."""
    for b in batches:
        rows: dict[str, list] = {c: [] for c in ("anchor", "id", "digest", "start", "n", "at", "span", "salt")}
        for r in b.select(["anchor", "id", "digest", "start", "n", "at", "span"]).to_pylist():
            words = r["span"].split()
            for k in range(r["n"]):
                span = b" ".join(words[k : k + window])
                salt = xxhash.xxh64_intdigest(span) - (1 << 63)
                for c, v in zip(rows, (r["anchor"], r["id"], r["digest"], r["start"] + k, 1, r["at"] - k, span, salt), strict=True):
                    rows[c].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([*[_SEED_SCHEMA.field(c) for c in list(rows)[:-1]], ("salt", pa.int64())]))


def _settle(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Whole groups, sorted by anchor and salt -> runs of windows that an earlier equal window repeats."""

    def settle(t: pa.Table) -> pa.RecordBatch:
        a, salt, ids, digests, start, n, at = (t.column(c).to_numpy() for c in ("anchor", "salt", "id", "digest", "start", "n", "at"))
        group = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])]))
        sizes = n.astype(np.int64) + window - 1
        words = np.fromiter(map(_numbers().__getitem__, b" ".join(t.column("span").to_pylist()).split()), np.int32, int(sizes.sum()))
        seed, later = repeated_windows(group, ids, digests, start, n, at, np.cumsum(sizes) - sizes, words, window, anchor)
        by = np.lexsort((later, seed))
        owner, lo, hi = _runs(later[by], seed[by])
        return _run_rows(ids[owner], digests[owner], lo, hi, owner)

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 1 << 17:
            t = pa.Table.from_batches(held).combine_chunks()
            a, salt = t.column("anchor").to_numpy(), t.column("salt").to_numpy()
            other = np.flatnonzero((a != a[-1]) | (salt != salt[-1]))  # the last group may go on
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield settle(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).to_batches()
    if held and sum(x.num_rows for x in held):
        yield settle(pa.Table.from_batches(held).combine_chunks())


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) -> id, n_words, n_removed, kept (the words that stay, joined by a space)."""
    for b in batches:
        runs = b.column("runs")
        for begin, texts in slices(b, "text"):
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.translate(SPACE_TABLE).split()
                n_words.append(len(words))
                known = runs[begin + i].as_py()
                if known:
                    steps = np.zeros(len(words) + 1, np.int64)
                    for r in known:
                        p = np.frombuffer(r, np.int32).reshape(-1, 2)
                        np.add.at(steps, p[:, 0], 1)
                        np.add.at(steps, p[:, 1] + window, -1)
                    stay = np.cumsum(steps[:-1]) == 0
                    words = [words[j] for j in np.flatnonzero(stay)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            own = b.column("id").slice(begin, len(texts))
            yield pa.RecordBatch.from_arrays([own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: id (long), n_words, n_removed, kept (remaining words, joined by one space).

    Null and empty texts have no words; texts shorter than the window lose nothing. A null id
    comes after all others. Rows that share an id stand at the same place: equal starts do not
    precede each other, so repeated rows do not remove each other, and keep their own rows. An
    empty table gives an empty result; other columns are ignored.
    """
    last = F.lit((1 << 63) - 1).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"))
    counts = rows.select("text").mapInArrow(lambda it: _anchor_counts(it, window, anchor), "anchor long, n int")
    repeated = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, "anchor", FILTER_BITS))
    seeds = materialize(rows.mapInArrow(lambda it: _seeds(it, window, anchor, bits), _SEEDS))
    open_seeds = seeds.where(F.col("anchor").isNotNull()).drop("runs")
    sizes = open_seeds.groupBy("anchor").agg(F.count("*").alias("seeds")).where(F.col("seeds") > HOT_SEEDS)
    hot = checked_broadcast(materialize(sizes.select("anchor")), BROADCAST_ANCHORS)
    fields = "anchor long, id long, digest long, start int, n int, at int, span binary, salt long"
    dealt = open_seeds.join(hot, "anchor", "left_semi").mapInArrow(lambda it: _dealt(it, window), fields)
    groups = open_seeds.join(hot, "anchor", "left_anti").withColumn("salt", F.lit(0).cast("long")).unionByName(dealt)
    groups = groups.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    settled = groups.mapInArrow(lambda it: _settle(it, window, anchor), _SEEDS)
    runs = seeds.where(F.col("anchor").isNull()).union(settled).groupBy("id", "digest").agg(F.collect_list("runs").alias("runs"))
    joined = rows.join(materialize(runs), ["id", "digest"], "left").select("id", "text", "runs")
    out = joined.mapInArrow(lambda it: _removed(it, window), "id long, n_words long, n_removed long, kept string")
    return out.select(F.nullif("id", last).alias(id_col), "n_words", "n_removed", "kept")


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, p, hash(array_to_string(words[p : p + 19], ' ')) AS h1, md5_number_lower(array_to_string(words[p : p + 19], ' ')) AS h2
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w WHERE len(words) >= 20)
),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM later),
lost AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN qs IS NULL THEN array_to_string(words, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(qs, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""
