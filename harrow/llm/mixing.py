"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key; within a source the documents stand in key order, and
a source's budget is cut at an exact word of that order. The order is never built in one
task: keys are dealt into ranges by their leading digits, range totals are summed first, and
each range then sums its own rows, starting from the total of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, read

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """src, source_size -> src, source_size, target.

    Sources in the order of src weigh `weights`, repeating, and share `share` times all sizes.
    No target is above `cap` times its source's size; what is cut off goes to the others by
    weight. That fixed point has a closed form: sources fill up in the order of cap / weight, so
    one prefix sum of caps and one suffix sum of weights give the level at which the rest is
    shared. One row per source takes part, never rows of documents.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("src")) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(cap))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # the first source that stays below its cap sets the level for itself and all after it
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("shared", F.first(open_level, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("src", "source_size", F.coalesce(F.col("shared") * F.col("weight"), F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix-1",
    key_digits: int = 3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, and columns of `keep`.

    Words taken are counted with repeats: whole epochs of the source, then its documents in
    key order up to the word at which the rounded target is reached; the document at the cut is
    taken in part. So a source's taken words sum to round(target), and none is taken above
    `cap` times its size. The key is md5 of seed and id, so reruns agree on any cluster.

    Sources stand in code point order. Null text has size 0 and is taken 0 times; a null source
    is a source of its own, sorted last; a null id takes the key of the empty string. Repeated
    rows count each for itself, ordered by size where keys tie (equal rows are interchangeable).
    An empty table gives an empty result. Columns not in `keep` are ignored, whatever their
    names. 16**key_digits ranges per source bound what one task sorts.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    # "a" before each name and a bare "b" for null: one key without nulls, in the wanted order
    src = F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit("b"))
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("kept")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), src.alias("src"), word_count(F.col(text_col)).alias("size"), key.alias("key"), kept)
    sized = materialize(sized.withColumn("range", F.substring("key", 1, key_digits)))
    ranges = materialize(sized.groupBy("src", "range").agg(F.sum("size").alias("in_range")))
    budget = targets(ranges.groupBy("src").agg(F.sum("in_range").alias("source_size")), weights, share, cap)
    in_order = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before_range", F.coalesce(F.sum("in_range").over(in_order), F.lit(0))).join(budget, "src").drop("in_range")
    in_range = Window.partitionBy("src", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(in_range), F.lit(0))).join(ranges, ["src", "range"])
    total = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size"))).otherwise(0).cast("long")
    rest = total - epochs * F.col("source_size") - F.col("before_range") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    own = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken")]
    return placed.select(*own, *[F.col("kept")[c].alias(c) for c in keep])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * 2.0::DOUBLE AS cap
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS BIGINT) AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lvl FROM w
), f AS (
  SELECT *, CASE WHEN lvl * weight <= cap THEN lvl END AS open_lvl FROM l
), t AS (
  SELECT source, source_size, coalesce(first_value(open_lvl IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * weight, cap) AS target FROM f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
     CAST(round(t.target) AS BIGINT) AS total,
     CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN total // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, total - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
