"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes. Two fingerprints that differ in at most four bits differ
in at most four bytes, so they share at least four bytes position by position: that is the
guaranteed minimum of the count filter. Postings of single bytes would be read whole for any
pair, so the index holds postings of three bytes at once: every four of the eight positions
contain one of the twenty triples below, so each pair that can reach the minimum meets in a
posting. Within a posting the shared positional bytes of a pair are tallied, pairs under the
minimum fall out, and the rest are verified by their differing bits.

Only distinct fingerprints are indexed. A posting gives a spanning forest of its links, not all
pairs; a posting above `block` entries is dealt out in pairs of blocks, each to its own group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_LOWER_TABLE, materialize, read
from .graph import components

#: Differing bits up to which two fingerprints link, and the bytes they then share at least.
MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS


def covering_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of byte positions such that any four positions contain one: positions in
    two rings of four; the triples inside a ring, and two of one ring with one of the other."""
    triples = [t for t in combinations(range(8), 3) if len({p // 4 for p in t}) == 1]
    best: list[tuple[int, int, int]] = triples
    quads = [set(q) for q in combinations(range(8), 4) if not any(set(t) <= set(q) for t in triples)]
    while quads:  # greedy, and in a fixed order
        t = max(combinations(range(8), 3), key=lambda t: sum(set(t) <= q for q in quads))
        best.append(t)
        quads = [q for q in quads if not set(t) <= q]
    return best


TRIPLES = covering_triples()


def fingerprint(text: bytes | str | None, size: int = 4) -> int:
    """Majority vote of the bits of XXH64 (seed 42) over the word shingles; 0 without words."""
    if text is None:
        return 0
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.translate(SPACE_LOWER_TABLE).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) -> (posting, fp) for each triple. The posting's number holds triple and bytes."""
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for k, t in enumerate(TRIPLES):
            key = np.full(len(fp), k, np.uint64)
            for p in t:
                key = (key << np.uint64(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(255))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["posting", "fp"])


_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of the positions at which two fingerprints share a byte: zero bytes of their difference.
    Adding 0x7F to its low seven bits sets a byte's top bit unless the byte is zero."""
    return np.bitwise_count(~(((x & _LOW7) + _LOW7) | x | _LOW7))


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs link (a and b broadcast against each other): the count filter keeps pairs that share
    the guaranteed minimum of positional bytes, and those are verified by their differing bits."""
    x = a ^ b
    ok = shared_bytes(x) >= MIN_SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints: each round takes one
    that is not yet reached and grows its component breadth first. One row of differences at a
    time, so memory is linear."""
    left, edges = fps, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            f = frontier.pop()
            near = linked(left, f)
            found = left[near]
            edges += [(int(f), int(g)) for g in found]
            frontier += list(found)
            left = left[~near]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups (group key columns posting, pair; fp), sorted by them -> edges."""
    held: list[np.ndarray] = []

    def emit(table: np.ndarray) -> pa.RecordBatch:
        edges: set[tuple[int, int]] = set()
        new = np.flatnonzero((table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1])) + 1
        bounds = np.concatenate([[0], new, [len(table)]])
        sizes = np.diff(bounds)
        fps = table[:, 2].copy().view(np.uint64)
        # pairs: all groups of two at once
        two = bounds[:-1][sizes == 2]
        ok = linked(fps[two], fps[two + 1]) if len(two) else np.empty(0, bool)
        edges.update(zip(fps[two[ok]].tolist(), fps[two[ok] + 1].tolist(), strict=True))
        for s, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            edges.update(forest(fps[s : s + n]))
        out = np.array(sorted(edges), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], ["u", "v"])

    for b in batches:
        table = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
        held.append(table)
        # all but the last group of what is held is complete
        if sum(map(len, held)) >= 1 << 17:
            rows = np.concatenate(held)
            last = int(np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))[-1]) + 1 if (rows[:, :2] != rows[-1, :2]).any() else 0
            if last:
                yield emit(rows[:last])
            held = [rows[last:]]
    if held and sum(map(len, held)):
        yield emit(np.concatenate(held))


def link_edges(fps: DataFrame, block: int = 4096) -> DataFrame:
    """fps (fp, distinct) -> edges (u, v) of fingerprints within MAX_BITS, whose components are
    those of all such pairs."""
    postings = materialize(fps.select("fp").mapInArrow(_postings, "posting long, fp long"))
    sizes = postings.groupBy("posting").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = materialize(sizes.select(F.col("posting").alias("p"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    rows = postings.join(sizes, F.col("posting") == F.col("p"))
    # blocks i and j of a large posting meet in group (i, j): a row goes to one group per block
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long")))
    rows = rows.select("posting", "fp", own.alias("own"), other.alias("other"))
    rows = rows.select("posting", (F.least("own", "other") * 1_000_000 + F.greatest("own", "other")).alias("pair"), "fp")
    rows = rows.repartition("posting", "pair").sortWithinPartitions("posting", "pair")
    return rows.mapInArrow(_links, "u long, v long").distinct()


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the text, fp: what decides, without the texts."""
    digest = F.xxhash64(F.col(text_col)).alias("digest")
    return materialize(docs.select(F.col(id_col).alias("id"), digest, _fingerprints(F.col(text_col)).alias("fp")))


def _components(marked: DataFrame) -> DataFrame:
    """fp -> root, and component: the least id of all rows under that root."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(link_edges(nodes))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = materialize(named)
    names = materialize(named.groupBy("root").agg(F.min("first_id").alias("component")).withColumnRenamed("root", "r"))
    return materialize(named.join(names, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (long), component (least id reachable).

    Null, empty and blank texts have fingerprint zero, linked like any other. Equal
    fingerprints are one node, so copies never meet in pairs. Rows without an id belong to a
    component but never name it (a component of such rows alone has a null name). Repeated rows
    stay rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    marked = _marked(docs, id_col, text_col)
    out = marked.join(_components(marked), F.col("fp") == F.col("f"))
    return out.select(F.col("id").alias(id_col), "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near-duplicates one row, with all its columns: the one of least id
    (null ids last), then of least digest of the text, and one of rows that share both.

    Survivors are chosen on ids, digests and fingerprints alone; texts pass one join. A null text
    counts as empty for its fingerprint. An empty table gives an empty result. Columns may have any
    names but `_id`, `_digest` and `_n`.
    """
    marked = _marked(docs, id_col, text_col)
    # first of each fingerprint, so that a fingerprint with very many rows meets its root once
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", F.coalesce("digest", F.lit(0)).alias("digest"))
    first = materialize(marked.groupBy("fp").agg(F.min(place).alias("p")))
    rooted = first.join(_components(marked), F.col("fp") == F.col("f")).groupBy("root").agg(F.min("p").alias("p"))
    chosen = materialize(rooted.select(F.col("p.id").alias("_id"), F.col("p.digest").alias("_digest")))
    times = marked.groupBy("id", F.coalesce("digest", F.lit(0)).alias("digest")).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest"))
    chosen = materialize(chosen.join(times, same, "left").select("_id", "_digest", F.coalesce("_n", F.lit(1)).alias("_n")))
    mine = F.col(id_col).eqNullSafe(F.col("_id")) & (F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)) == F.col("_digest"))
    once = docs.join(chosen.where("_n = 1"), mine, "left_semi")
    many = docs.join(chosen.where("_n > 1"), mine).dropDuplicates(["_id", "_digest"]).select(*docs.columns)
    return once.unionByName(many)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
