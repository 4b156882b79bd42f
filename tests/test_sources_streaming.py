"""Readers and writers round trip; the streaming fold equals the batch fold."""

import json

from pyspark.sql import functions as F

from harrow.operators.snapshots import fold_changes
from harrow.sources import tables
from harrow.streaming import changes

from . import oracle


def test_json_csv_and_first_path(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y"}]))
    assert tables.read_json(spark, str(tmp_path / "a.json"), "id string, n int", lines=False).count() == 2
    df = spark.createDataFrame([("a", ["p", "q"], None), ("b, c", [], 'say "x"')], "id string, items array<string>, t string")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = {r["id"]: r for r in tables.read_csv(spark, str(tmp_path / "csv"), "id string, items string, t string").collect()}
    assert (back["a"]["items"], back["a"]["t"], back["b, c"]["items"], back["b, c"]["t"]) == ("p; q", None, None, 'say "x"')
    df.write.parquet(str(tmp_path / "p"))
    assert tables.read_first_of(spark, [str(tmp_path / "none"), str(tmp_path / "p")], df.schema).count() == 2


def test_shards_and_lookup(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("ID"), F.col("id").cast("string")).alias("k"), "id")
    tables.write_shards(df, str(tmp_path / "s"), "k", 16)
    found = tables.lookup(spark, str(tmp_path / "s"), "k", "ID77", 16)
    assert [r["id"] for r in found.collect()] == [77]
    assert "PartitionFilters: [isnotnull(shard" in found._jdf.queryExecution().toString()


def test_exports_and_merges(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(150)], "id long, name string")
    text = tables.export_text(df, [F.desc("id")], {"release": "1"})
    assert text.startswith("# release: 1\r\nid,name\r\n149,n149\r\n") and text.count("\r\n") == 102
    assert len(json.loads(tables.export_text(df, [F.asc("id")], {}, "json"))["rows"]) == 100
    merged = tables.merge_slices([df.withColumn("y", F.lit(2)), df.where("id < 3").withColumn("name", F.lit("old")).withColumn("y", F.lit(1))], "id", "y")
    assert merged.where("name = 'old'").count() == 3 and merged.count() == 150
    assert tables.new_rows(df, df.where("id < 140"), "id").count() == 10


def log_of(e):
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("changed")
    return e.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("release"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("before"), ((F.col("event_id") + 1) % 3).cast("string").alias("after"))


def test_streaming_fold_equals_batch_fold(spark, tmp_path):
    events = spark.read.parquet(f"{oracle.DATA}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))  # out of order
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.run_fold(log_of(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "key", "release", "kind", "before", "after").awaitTermination(120)
    got = changes.folded(spark, str(tmp_path / "out"), "key")
    want = fold_changes(log_of(events), "key", "release", "kind", "before", "after")
    assert sorted(got.drop("release").collect()) == sorted(want.drop("release").collect())


def test_releases_are_folded_once_in_any_order(spark, tmp_path):
    """Releases that come shuffled, again, or after they were told change nothing: the stream gives the batch fold."""
    import random

    events = spark.read.parquet(f"{oracle.DATA}/events.parquet")
    log = log_of(events).withColumn("day", F.to_date("release.ts")).withColumnRenamed("release", "at")
    days = [r["day"] for r in log.select("day").distinct().orderBy("day").collect()]
    order = days + random.Random(1).sample(days, 12)
    random.Random(2).shuffle(order)
    for i, at in enumerate(range(0, len(order), 7)):  # a batch of whole releases
        log.where(F.col("day").isin(order[at : at + 7])).coalesce(1).write.parquet(str(tmp_path / f"in/{i:02}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    since = F.lit(days[2])
    run = lambda: changes.run_fold_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "key", "day", "kind", "before", "after", "at", since).awaitTermination(300)
    run()
    want = fold_changes(log.where(F.col("day") > since), "key", "at", "kind", "before", "after").drop("release")
    got = changes.folded_once(spark, str(tmp_path / "out"))
    assert sorted(got.drop("release").collect()) == sorted(want.collect())
    # the same releases once more, in new files
    log.where(F.col("day").isin(days[3:9])).coalesce(1).write.parquet(str(tmp_path / "in/late"))
    run()
    assert sorted(changes.folded_once(spark, str(tmp_path / "out")).collect()) == sorted(got.collect())


def test_stream_static_join_and_windows(spark, tmp_path):
    events = spark.read.parquet(f"{oracle.DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([("signup", "a"), ("error", "b")], "term string, reader string")
    q = changes.matches(stream, subs, "event_type", "term").writeStream.format("memory").queryName("matched").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("matched").count() == events.where("event_type in ('signup', 'error')").count()
    counted = changes.trailing_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    q = counted.writeStream.outputMode("update").format("memory").queryName("trailing").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("trailing").agg(F.max("n")).first()[0] > 0


def test_versions_and_scopes(spark):
    rows = spark.createDataFrame([(1, 2), (2, 2), (3, None)], "id int, version int")
    assert tables.of_version(rows.where("id < 3"), "version", 2).count() == 2
    for bad in (rows, rows.withColumn("version", F.lit(1))):
        try:
            tables.of_version(bad, "version", 2)
        except ValueError:
            continue
        raise AssertionError("rows of another version were let through")
    found = tables.scope_rows(rows, [F.col("id")], "selected", selected=[3, 9]).collect()
    assert [r["id"] for r in found] == [3] and tables.scope_rows(rows, [F.col("id")], "selected").count() == 0
