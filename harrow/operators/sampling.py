"""Deterministic samples: by stratum, by quota, round-robin, and within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(identifier: str, seed: str) -> Column:
    """A random-looking order that depends on seed and id only, the same on any engine."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(identifier).cast("string")))


def stratified(df: DataFrame, stratum: str, identifier: str, quota: int | dict[str, int], seed: str = "s1") -> DataFrame:
    """The first rows of each stratum in key order, up to its quota (a sampling operator: the quota is
    its meaning). The window keeps a bounded number of rows per stratum and task before the
    shuffle (a top-k per group)."""
    w = Window.partitionBy(stratum).orderBy("_k", identifier)
    limit = F.lit(quota) if isinstance(quota, int) else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(stratum)), F.lit(0))
    ranked = df.withColumn("_k", order_key(identifier, seed)).withColumn("draw", F.row_number().over(w))
    if isinstance(quota, int):
        return ranked.where(F.col("draw") <= quota).drop("_k")
    return ranked.where(F.col("draw") <= max(quota.values(), default=0)).where(F.col("draw") <= limit).drop("_k")


def round_robin(df: DataFrame, stratum: str, identifier: str, n: int, seed: str = "s1") -> DataFrame:
    """n rows, one of each stratum in turn, strata in order within a turn."""
    rows = stratified(df, stratum, identifier, n, seed)
    return rows.orderBy("draw", stratum).limit(n)


def within_budget(df: DataFrame, order: list[Column], unit_cost: float, per_block: float, block: int, budget: float) -> DataFrame:
    """The longest prefix whose cost - a price per row and one per started block - fits. The cost
    depends on the row number alone, so the prefix's length is solved for, and it is a limit."""
    n = 0
    while (n + 1) * unit_cost + -(-(n + 1) // block) * per_block <= budget:
        n += max(1, int((budget - n * unit_cost - -(-n // block) * per_block) / (unit_cost + per_block)))
    return df.orderBy(*order).limit(n)


def population_weights(sample: DataFrame, population: DataFrame, stratum: str) -> DataFrame:
    """The sample with each row's weight: its stratum's population over its sample size."""
    size = population.groupBy(stratum).agg(F.count("*").alias("pop"))
    drawn = sample.groupBy(stratum).agg(F.count("*").alias("drawn"))
    return sample.join(size.join(drawn, stratum).select(stratum, (F.col("pop") / F.col("drawn")).alias("weight")), stratum)


def weighted_ratio(df: DataFrame, keys: list[str], weight: str, hit: Column) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.when(hit, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("estimate"), F.count("*").alias("n"))
