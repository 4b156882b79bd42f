"""A persisted inverted index: postings in folders by hash of their term, so that a request reads only its terms' folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index; a power of two.
SHARDS = 64


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def write_index(df: DataFrame, path: str, identifier: str, terms: Column, payload: Sequence[str] = (), shards: int = SHARDS) -> None:
    """term, identifier and payload columns for each distinct, filled term of a row. A term that very many rows hold is dealt
    to several writers of its folder. Rows without terms have no postings."""
    rows = df.select(F.col(identifier).alias("id"), *payload, F.explode(F.array_distinct(F.filter(terms, lambda x: F.coalesce(x, F.lit("")) != ""))).alias("term"))
    rows = rows.withColumn("shard", _shard(F.col("term"), shards))
    rows.repartition("shard", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("shard").parquet(path)


def postings(spark: SparkSession, path: str, terms: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """The postings of some terms (a request's, so few): a filter on their folders, then on the terms."""
    wanted = sorted(set(terms))
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")).alias("t")).select(_shard(F.col("t"), shards).alias("s"))
    folders = sorted({r["s"] for r in asked.collect()})
    return spark.read.parquet(path).where(F.col("shard").isin(folders) & F.col("term").isin(wanted)).drop("shard")
