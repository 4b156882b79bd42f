"""Tables in the folder that all executors share: they cut the lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str = "landing") -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, where that is unset on a single
    machine, below its temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='harrow-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a new folder, read back."""
    path = folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task of a spread table.
SPREAD_ROWS = 50_000


def spread(df: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """df dealt out by its key in as many parts as its rows ask for, however few files hold it. A stated number of parts is
    not merged again, so what follows by key needs no further shuffle and holds as much in a task at any size."""
    return df.repartition(max(1, -(-df.count() // (rows_per_task or SPREAD_ROWS))), key)
