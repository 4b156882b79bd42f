"""Bootstrap within strata, each replicate of exactly its strata's sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replicates that are drawn for a stratum in one step.
DRAWS_AT_ONCE = 100
#: Distinct cells that a stratum may have: its draws hold this many counts each.
CELLS = 100_000


def ratio_cells(rows: DataFrame, stratum: str, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """stratum, n and, for each pair, top_i and bottom_i: rows that contribute the same are one cell. A null counts as 0."""
    parts = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{side}_{i}") for i, pair in enumerate(pairs.values()) for side, c in zip(("top", "bottom"), pair, strict=True)]
    own = rows.select(F.col(stratum).alias("stratum"), *parts)
    return own.groupBy(*own.columns).agg(F.count("*").alias("n"))


def bootstrap_ratios(rows: DataFrame, stratum: str, pairs: dict[str, tuple[Column, Column]], draws: int = 2000, seed: str = "r1") -> DataFrame:
    """metric, estimate, low, high: each pair's sum(top) / sum(bottom) over all rows, with its percentile interval.

    A replicate draws, in each stratum, as many rows as the stratum has, with replacement; weights are part of
    the pair's columns. What a stratum's rows contribute is first reduced to cells, and a replicate's counts of them
    are one multinomial draw (a binomial for each cell, given what the cells before it took), so a stratum's size
    costs nothing and is met exactly. Draws depend on seed, stratum and replicate alone. The interval takes the values
    at places int(0.025 m) and int(0.975 m) - 1 of the m replicates with a bottom other than 0; null where there is
    none. A stratum with more than CELLS cells raises: coarsen what it sums.
    """
    m = len(pairs)
    cells = ratio_cells(rows, stratum, pairs)
    sums = [f"{side}_{i}" for i in range(m) for side in ("top", "bottom")]
    blocks = -(-draws // DRAWS_AT_ONCE)
    dealt = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def draw(table):
        if table.num_rows > CELLS:
            raise ValueError(f"a stratum has {table.num_rows} cells, more than {CELLS}")
        order = [("n", "ascending"), *[(s, "ascending") for s in sums]]
        table = table.sort_by(order)  # the draw doesn't depend on how rows arrive
        name, block = table.column("stratum")[0].as_py(), table.column("block")[0].as_py()
        n = table.column("n").to_numpy()
        values = np.stack([table.column(s).to_numpy() for s in sums], axis=1)
        first, last = block * DRAWS_AT_ONCE, min(draws, (block + 1) * DRAWS_AT_ONCE)
        out = np.empty((last - first, 2 * m))
        for i in range(first, last):
            key = hashlib.sha256(f"{seed}\n{name is None}\n{name}\n{i}".encode()).digest()
            out[i - first] = np.random.default_rng(list(key)).multinomial(n.sum(), n / n.sum()) @ values
        return pa.table([pa.array(np.arange(first, last, dtype=np.int32)), *[pa.array(out[:, j]) for j in range(2 * m)]], names=["draw", *sums])

    drawn = dealt.groupBy("stratum", "block").applyInArrow(draw, ", ".join(["draw int", *[f"{s} double" for s in sums]]))
    each = drawn.groupBy("draw").agg(*[F.sum(s).alias(s) for s in sums])
    ratios = lambda df, keep: df.select(*keep, F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.when(F.col(f"bottom_{i}") != 0, F.col(f"top_{i}") / F.col(f"bottom_{i}")).alias("r")) for i, name in enumerate(pairs)])).alias("m")).select("m.metric", "m.r")
    # an array of `draws` numbers for each metric
    found = ratios(each, []).groupBy("metric").agg(F.sort_array(F.collect_list("r")).alias("v"))
    at = lambda share, less: F.get("v", F.floor(F.size("v") * F.lit(share)).cast("int") - less)
    whole = ratios(cells.agg(*[F.sum(F.col(s) * F.col("n")).alias(s) for s in sums]), []).withColumnRenamed("r", "estimate")
    return whole.join(found, "metric", "left").select("metric", "estimate", at(0.025, 0).alias("low"), at(0.975, 1).alias("high"))


def weighted_pairs(metrics: Sequence[tuple[str, Column, Column]], weight: Column) -> dict[str, tuple[Column, Column]]:
    """name, hit, among -> the pair of weighted sums whose ratio is the share of hits among the rows that count."""
    return {name: (F.when(hit & among, weight).otherwise(0.0), F.when(among, weight).otherwise(0.0)) for name, hit, among in metrics}
