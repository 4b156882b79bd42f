"""Hard negatives by orthogonal PCA rotation.

Vectors are whole numbers. One pass sums their second moments; the eigenvectors, strongest first, are an
orthogonal rotation, so inner products stay as they are while the first components carry most of them.
Anchors and rows meet in a grid of cells: each cell holds a block of anchors of bounded size and
streams its share of the rows past it. For each pair the product of the leading components is
accumulated in steps; what is missing is at most the product of the two residual norms, plus slack for rounding.
A pair whose upper or lower bound rules it out is discarded at once, and what survives is verified by
the product of the whole numbers. Bounds only discard; every score is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Anchors that a task holds at a time; rows are dealt out once for each such block.
ANCHORS = 4096
#: Rows that a cell streams at least, where there are as many: it hands on k entries an anchor, however few it reads.
CELL_ROWS = 2048
#: Rows and anchors whose products are formed at a time.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 128
_INT = 2**31 - 1
_LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, held to 32 bits; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-2147483648.0), F.least(F.lit(2147483647.0), x.cast("double") * scale))).cast("int"))
    return F.when(finite, whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; missing components are 0."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def second_moments(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of x xT over all rows: one matrix for each task, added up by Spark. Its size is that of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column("q"), width).astype(np.float64)
            total += x.T @ x
        for i in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, i)), pa.array(np.arange(width)), pa.array(total[i])], ["i", "j", "s"])

    found = rows.select("q").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((width, width))
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("s").to_numpy()
    return out


class _Vectors:
    """Whole and rotated vectors, and the norm of what is left after each step."""

    def __init__(self, whole: np.ndarray, rotation: np.ndarray, steps: list[int]):
        self.whole, self.turned = whole, whole @ rotation
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(whole), 1))], axis=1)[:, steps])
        self.norm = np.sqrt(squares[:, 0]) if whole.shape[1] else np.zeros(len(whole))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products row by row, held to 64 bits."""
    if not len(a) or float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**62:
        return np.einsum("ij,ij->i", a, b)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([max(-_LONG, min(_LONG, int(x))) for x in exact], np.int64)


class _Best:
    """The first k entries of each slot, by score, then id (a missing id last)."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.missing = np.empty(0, bool)
        self.least = np.full(slots, -np.inf)  # the score of the k-th entry

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.r_[self.slot, slot], np.r_[self.score, score]
        ids, missing = np.r_[self.id, ids], np.r_[self.missing, missing]
        order = np.lexsort((ids, missing, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        kept = rank < self.k
        order = order[kept]
        self.slot, self.score, self.id, self.missing = slot[kept], score[order], ids[order], missing[order]
        full = rank[kept] == self.k - 1
        self.least[self.slot[full]] = self.score[full]


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """score * percent / 100, rounded down or up, without leaving 64 bits."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + (-(-rest * percent // 100) if up else rest * percent // 100)


class _Cell:
    """A block of anchors, past which rows are streamed."""

    def __init__(self, anchors: pa.RecordBatch, rotation: np.ndarray, steps: list[int], k: int, band: tuple[int, int] | None):
        width = len(rotation)
        self.steps, self.band, self.rotation = steps, band, rotation
        self.v = _Vectors(_matrix(anchors.column("q"), width), rotation, steps)
        self.row, self.label = anchors.column("row").to_numpy(), np.asarray(anchors.column("label"))
        n = len(self.row)
        if band:
            lists = anchors.column("scores")
            sizes = np.diff(np.asarray(lists.offsets))
            self.m = max(1, int(sizes.max(initial=0)))
            score = np.zeros((n, self.m), np.int64)
            held = np.arange(self.m) < sizes[:, None]
            score[held] = lists.flatten().to_numpy(zero_copy_only=False)
            self.low, self.high = _share(score, band[0], up=True), _share(score, band[1], up=False)
            self.low[~held], self.high[~held] = 1, 0  # no score is within
        else:
            self.m = 1
        # lists of their own for each tile, so that adding to them sorts a tile's entries only
        self.tiles = [(slice(i, i + ANCHORS_AT_ONCE), _Best(len(self.row[i : i + ANCHORS_AT_ONCE]) * self.m, k)) for i in range(0, n, ANCHORS_AT_ONCE)]
        self.k = k

    def stream(self, rows: pa.RecordBatch) -> None:
        for at in range(0, rows.num_rows, ROWS_AT_ONCE):
            part = rows.slice(at, ROWS_AT_ONCE)
            v = _Vectors(_matrix(part.column("q"), len(self.rotation)), self.rotation, self.steps)
            row, label = part.column("row").to_numpy(), np.asarray(part.column("label"))
            ids, missing = part.column("id").fill_null(0).to_numpy(), np.asarray(part.column("id").is_null())
            for tile, best in self.tiles:
                self._tile(tile, best, v, row, label, ids, missing)

    def _tile(self, tile: slice, best: _Best, v: _Vectors, row: np.ndarray, label: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        a, m = self.v, self.m
        same = self.label[tile, None] == label[None, :]
        fit = ~same if self.band else same & (self.row[tile, None] != row[None, :])
        part = a.turned[tile, : self.steps[0]] @ v.turned[:, : self.steps[0]].T
        slack = 1e-9 * a.norm[tile, None] * v.norm[None, :] + 1e-6
        room = a.rest[tile, 0][:, None] * v.rest[None, :, 0] + slack
        upper = part + room
        floors = best.least.reshape(-1, m)  # the least score that can still enter each list
        if self.band:
            floors, high = np.maximum(floors, self.low[tile]), self.high[tile]
            fit &= part - room <= high.max(axis=1)[:, None]
        elif fit.shape[1] > self.k:
            # the k-th highest lower bound of these rows is a floor as well
            sure = np.where(fit, part - room, -np.inf)
            fit &= upper >= np.partition(sure, fit.shape[1] - self.k, axis=1)[:, fit.shape[1] - self.k, None]
        # all lists of an anchor at once first, each by itself for the pairs that are left
        fit &= upper >= floors.min(axis=1)[:, None]
        x, y = np.nonzero(fit)
        part, room, slack = part[x, y], room[x, y], slack[x, y]
        for k in range(len(self.steps)):
            if k:
                start, stop = self.steps[k - 1], self.steps[k]
                part = part + np.einsum("ij,ij->i", a.turned[tile, start:stop][x], v.turned[y, start:stop])
                room = a.rest[tile, k][x] * v.rest[y, k] + slack
            live = np.zeros(len(x), bool)
            for j in range(m):
                ok = part + room >= floors[x, j]
                live |= ok & (part - room <= high[x, j]) if self.band else ok
            x, y, part, room, slack = x[live], y[live], part[live], room[live], slack[live]
        score = _products(a.whole[tile][x], v.whole[y])
        found = []
        for j in range(m):
            ok = score >= floors[x, j]
            if self.band:
                ok &= score <= high[x, j]
            found.append((x[ok] * m + j, score[ok], ids[y[ok]], missing[y[ok]]))
        best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def rows(self) -> pa.RecordBatch:
        parts = [(self.row[tile][b.slot // self.m], b.slot % self.m, b.score, b.id, b.missing) for tile, b in self.tiles]
        anchor, j, score, ids, missing = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(j.astype(np.int32)), pa.array(score), pa.array(ids, mask=missing)], ["anchor", "j", "score", "id"])


def _search(rows: DataFrame, anchors: DataFrame, rotation: np.ndarray, n_rows: int, n_anchors: int, k: int, band: tuple[int, int] | None) -> DataFrame:
    """anchor (its row), j (place of the positive), score, id: the first k of each anchor and positive, by cells."""
    spark = rows.sparkSession
    blocks = -(-n_anchors // ANCHORS)
    groups = max(1, min(-(-n_rows // CELL_ROWS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))
    width = len(rotation)
    steps = sorted({max(1, width // 4), max(1, width // 2), width}) if width else [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, cell = None, [], None

        def opened() -> _Cell:
            return _Cell(pa.Table.from_batches(held).combine_chunks().to_batches()[0], rotation, steps, k, band)

        for b in batches:
            cells, kinds = b.column("cell").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])]) if len(cells) else []
            for start, end in zip(edges, [*edges[1:], len(cells)], strict=True):
                if cells[start] != at:
                    if cell:
                        yield cell.rows()
                    at, held, cell = cells[start], [], None
                piece = b.slice(start, end - start)
                if kinds[start] == 0:
                    held.append(piece)
                elif held:
                    cell = cell or opened()
                    cell.stream(piece)
        if cell:
            yield cell.rows()

    group, block = F.pmod(F.xxhash64("row"), F.lit(groups)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))
    if "scores" not in anchors.columns:
        anchors = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    held = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), (block * groups).alias("b"), "row", "id", "label", "q", "scores")
    held = held.select((F.col("b") + F.col("g")).alias("cell"), F.lit(0).alias("kind"), "row", "id", "label", "q", "scores")
    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), group.alias("g"), "row", "id", "label", "q")
    dealt = dealt.select((F.col("b") * groups + F.col("g")).alias("cell"), F.lit(1).alias("kind"), "row", "id", "label", "q", F.lit(None).cast("array<long>").alias("scores"))
    grid = held.union(dealt).repartitionById(blocks * groups, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")
    return grid.mapInArrow(run, "anchor long, j int, score long, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """rank from 1 to k among what all cells found for an anchor and positive."""
    from pyspark.sql import Window

    order = Window.partitionBy("anchor", "j").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, n_positives: int = 5, n_negatives: int = 10, band: tuple[int, int] = (30, 90)) -> DataFrame:
    """vectors (id, label, q: whole components, is_anchor) -> anchor_id, positive_id, rank, negative_id and the two scores.

    Scores are inner products. An anchor's positives are its first n_positives other rows of its label; a positive's
    negatives are the first n_negatives rows of other labels with band[0] % to band[1] % of its score. Higher scores
    come first, ties by smaller id, a null id last. Rows with a null label or q take no part. Every row stands for
    itself: rows that repeat an id or a vector are rows of their own, and only the anchor's own row is not
    its positive. Missing components of a shorter vector are 0. Components are held to 32 bits and scores to 64.
    An empty table, or one without anchors, gives an empty result.

    A task holds ANCHORS anchors and a batch of rows; rows are dealt out once for each block of
    anchors, whatever their labels, so that no label is gathered. Each cell hands on k entries an anchor.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("label").isNotNull() & F.col("q").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "q", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("rows"), F.count_if("is_anchor").alias("n"), F.max(F.size("q")).alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], _OUT)
    moments = second_moments(rows, size["width"])
    rotation = np.linalg.eigh(moments)[1][:, ::-1].copy() if size["width"] else moments
    anchors = rows.where("is_anchor")
    top = _first(_search(rows, anchors, rotation, size["rows"], size["n"], n_positives, None), n_positives)
    ranked = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("id"), F.col("score"))))
    positives = materialize(anchors.join(top.groupBy("anchor").agg(ranked.alias("positives")), F.col("row") == F.col("anchor")).drop("anchor"))
    found = _search(rows, positives.withColumn("scores", F.col("positives.score")), rotation, size["rows"], size["n"], n_negatives, band)
    found = _first(found, n_negatives).select("anchor", "j", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = positives.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "positives")
    out = found.join(own, "anchor").withColumn("p", F.element_at("positives", F.col("j") + 1))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), quantised(F.col("embedding")).alias("q"), (F.col("vec_id") % 100 == 0).alias("is_anchor"))
    return hard_negatives(rows)


SQL = r"""
WITH r AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS a, a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.r <> b.r WHERE a.id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS place FROM scored WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN scored n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW o AS (PARTITION BY p.a, p.place ORDER BY n.score DESC, n.id NULLS LAST)
QUALIFY rank <= 10
"""
