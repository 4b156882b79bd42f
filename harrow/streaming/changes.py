"""Structured Streaming forms of the keyed fold, of subscriptions, and of trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshots import fold_changes, merged_folds, partial_fold, settled_fold, unfolded
from ..sources.tables import exists


def net_changes(log: DataFrame, key: str, release: str, kind: str, before: str, after: str) -> DataFrame:
    """A running keyed fold for an unbounded log: first and last entry by release, per key. These are
    plain streaming aggregates (state is one row per key, and order of arrival does not matter);
    the net effect is read off with `settle`."""
    return log.groupBy(key).agg(
        F.min_by(F.struct(F.col(kind).alias("kind"), F.col(before).alias("value")), release).alias("first"),
        F.max_by(F.struct(F.col(kind).alias("kind"), F.col(after).alias("value")), release).alias("last"),
        F.max(release).alias("release"),
    )


def settle(state: DataFrame, key: str) -> DataFrame:
    """State rows -> key, kind, before, after, release; what cancels out is gone."""
    born, gone = F.col("first.kind") == "added", F.col("last.kind") == "removed"
    same = F.col("first.value").eqNullSafe(F.col("last.value"))
    net = F.when(born & gone, None).when(born, "added").when(gone, "removed").when(~same, "changed")
    return state.withColumn("kind", net).where(F.col("kind").isNotNull()).select(key, "kind", F.col("first.value").alias("before"), F.col("last.value").alias("after"), "release")


def run_fold(log: DataFrame, out: str, checkpoint: str, key: str, release: str, kind: str, before: str, after: str) -> StreamingQuery:
    """Process what has arrived and stop: each batch's changed keys are written as a table of their
    state; the newest row of a key counts."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    fold = net_changes(log, key, release, kind, before, after)
    return fold.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, out: str, key: str) -> DataFrame:
    state = spark.read.parquet(out)
    rest = [c for c in state.columns if c not in (key, "batch")]
    newest = state.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(key, "s.*")
    return settle(newest, key)


def run_fold_once(log: DataFrame, out: str, checkpoint: str, key: str, release: str, kind: str, before: str, after: str, at: str | None = None, since: Column | None = None) -> StreamingQuery:
    """Fold each release once, in whatever order releases arrive and however often, and stop when all has been read.

    Each batch writes a partial fold of its new releases and then a ledger that names them; what a batch
    may fold is judged by the ledgers of the batches before it. A batch that is run again after a failure
    overwrites its own two folders with the same rows; one without a ledger is not read. State on disk is one row for each
    key and batch; nothing is held in memory between batches.
    """
    spark = log.sparkSession
    ledger_schema = f"release {log.schema[release].dataType.simpleString()}, batch long"

    def sink(batch: DataFrame, number: int) -> None:
        known = _ledger(spark, out, ledger_schema).where(F.col("batch") < number)
        new = unfolded(batch, release, known, since).persist()
        try:
            partial_fold(new, key, release, kind, before, after, at).write.mode("overwrite").parquet(f"{out}/folds/batch={number}")
            new.select(F.col(release).alias("release")).distinct().write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")
        finally:
            new.unpersist()

    return log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger(spark: SparkSession, out: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/ledger") if exists(spark, f"{out}/ledger") else spark.createDataFrame([], schema)


def folded_once(spark: SparkSession, out: str) -> DataFrame:
    """The net effect of all releases that the ledgers name."""
    batches = spark.read.parquet(f"{out}/ledger").select("batch").distinct()
    return settled_fold(merged_folds(spark.read.parquet(f"{out}/folds").join(F.broadcast(batches), "batch", "left_semi")))  # one row a batch


def matches(events: DataFrame, subscriptions: DataFrame, column: str, term: str) -> DataFrame:
    """Stream-static join: events with the subscriptions on their value."""
    return events.join(subscriptions, events[column] == subscriptions[term])


def trailing_counts(events: DataFrame, ts: str, keys: list[str], length: str = "14 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts in sliding windows; events later than the watermark are dropped by the engine."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *keys).agg(F.count("*").alias("n"))


__all__ = ["fold_changes", "folded", "folded_once", "matches", "net_changes", "run_fold", "run_fold_once", "settle", "trailing_counts"]
