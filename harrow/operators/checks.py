"""Data quality: each check returns the number of violations, so a gate is one comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null or blank keys, and rows beyond the first of each key."""
    per = df.groupBy(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated"))


def disallowed(df: DataFrame, columns: list[str], allowed: DataFrame) -> DataFrame:
    """Combinations that the table of allowed ones does not hold, with their counts."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).join(allowed, columns, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: rows that break each rule (a rule that is null is not broken), from one pass."""
    one = df.agg(*[F.count_if(~c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)]))
    return one.select(rows.alias("r")).select("r.*")


def drift(previous: DataFrame, current: DataFrame, key: list[str], verdict: list[str]) -> DataFrame:
    """Keys whose verdict changed though nothing it depends on (the key) did."""
    a = previous.select(*key, F.struct(*verdict).alias("before"))
    b = current.select(*key, F.struct(*verdict).alias("after"))
    return a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))


def unmatched(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """One row: ids without a partner, on either side."""
    a, b = df.select(key).distinct(), reference.select(key).distinct()
    left = a.join(b, key, "left_anti").agg(F.count("*").alias("only_left"))
    return left.crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("only_right")))  # one row each


def gates(df: DataFrame, limits: dict[str, tuple[Column, float]]) -> DataFrame:
    """gate, passed: aggregates against their least values, from one pass (a null value fails)."""
    one = df.agg(*[F.coalesce(c.cast("double") >= least, F.lit(False)).alias(f"g{i}") for i, (c, least) in enumerate(limits.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), F.col(f"g{i}").alias("passed")) for i, name in enumerate(limits)]))
    return one.select(rows.alias("r")).select("r.*")
