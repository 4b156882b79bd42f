"""Running sums over an order that no single task holds.

Rows are cut into ranges of the order's value, at quantiles, so that a range has some `per_range`
rows whatever the segment sizes. Range totals are summed first; each range then sums its own rows, starting
from what stands before it. Only range totals are ever ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows that a range has on average.
PER_RANGE = 250_000


def with_ranges(rows: DataFrame, order: str, per_range: int = PER_RANGE) -> DataFrame:
    """rows with _range, an int that grows with the value of `order` (a number). Equal values share a range. Rows
    without a value are in range 0. Counting and a quantile sketch are the only passes; rows should be a written table."""
    n = rows.count()
    ranges = max(1, -(-n // per_range))
    cuts: list[float] = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        found = rows.select(F.percentile_approx(F.col(order).cast("double"), F.array(*map(F.lit, at)), F.lit(max(10_000, 20 * ranges)))).first()[0]
        cuts = sorted(set(found or ()))
    if not cuts:
        return rows.withColumn("_range", F.lit(0))
    # Bucketizer searches the cut points by halving, in the JVM
    splits = [-float("inf"), *cuts, float("inf")]
    out = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket", handleInvalid="keep").transform(rows.withColumn("_order", F.col(order).cast("double")))
    return out.withColumn("_range", F.when(F.col("_order").isNull(), 0).otherwise(F.col("_bucket").cast("int"))).drop("_order", "_bucket")


def before_ranges(totals: DataFrame, keys: Sequence[str], columns: Sequence[str], descending: bool = False) -> DataFrame:
    """totals (keys, _range, columns) -> the same keys with the sums of the ranges before each (after it, if descending)."""
    order = F.desc("_range") if descending else F.asc("_range")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in columns])


def running_sums(rows: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """rows (with _range) plus, for each name, the sum of its column up to the row in the order, ties included."""
    parts = {f"_{name}": c for name, c in sums.items()}
    own = rows.withColumns(parts)
    totals = own.groupBy(*keys, "_range").agg(*[F.sum(p).alias(f"_before{p}") for p in parts])
    offsets = before_ranges(totals, keys, [f"_before{p}" for p in parts], descending)
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(order) if descending else F.asc(order))
    local = own.withColumns({p: F.sum(p).over(inside) for p in parts})
    out = joined(local, offsets, [*keys, "_range"])
    return out.withColumns({name: F.col(f"_{name}") + F.col(f"_before_{name}") for name in sums}).drop(*parts, *[f"_before{p}" for p in parts])


def joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with the one row of small that has the same keys; a null key is a key."""
    right = small.withColumnsRenamed({c: f"_k_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]
    return rows.join(right, same).drop(*[f"_k_{c}" for c in on])


def medians(rows: DataFrame, keys: Sequence[str], value: str, per_range: int = PER_RANGE) -> DataFrame:
    """keys, median (exact, the mean of the middle two) of the values that are not null, for groups of any size: distinct
    values are counted first, and the middle is found among their running counts. A group without values has no row."""
    counted = written(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    upto = running_sums(with_ranges(counted, "v", per_range), keys, "v", {"upto": F.col("n")})
    total = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    both = joined(upto, total, list(keys))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = both.groupBy(*keys).agg(F.min(F.when(F.col("upto") >= low, F.col("v"))).alias("low"), F.min(F.when(F.col("upto") >= high, F.col("v"))).alias("high"))
    return middle.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median"))
