"""Readers with explicit schemas, and writers of the published forms."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import blank_to_null, shard_of


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | str, lines: bool = True, strict: bool = True) -> DataFrame:
    """JSON lines (plain or gzip) or one array per file. The schema is stated, never inferred; a
    strict read fails on what does not fit it, else such rows are null."""
    reader = spark.read.schema(schema).option("multiLine", not lines)
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


#: Rows of one file that holds an array.
ARRAY_ROWS = 100_000


def write_json_arrays(df: DataFrame, path: str, rows_per_file: int = ARRAY_ROWS, pretty: bool = False) -> None:
    """A folder of files, each one JSON array of some `rows_per_file` rows (optionally indented). Rows stream through a
    task that adds the brackets and commas, and Spark's text writer commits the files as a whole, in any file system;
    nothing is gathered. Nulls inside rows are written. An empty table is one empty array."""
    files = max(1, -(-df.count() // rows_per_file))
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("value"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # a row is written once it is known whether another follows
        for b in batches:
            out = []
            for line in b.column(0).to_pylist():
                if held is not None:
                    out.append(("[" if first else "") + held + ",")
                    first = False
                held = line
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if held is not None or files == 1:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first else "") + (held or "") + "]"], pa.string())], ["value"])

    dealt = lines.coalesce(1) if files == 1 else lines.repartition(files)
    dealt.mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in the file system that Spark uses for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, separator: str = ",", missing_ok: bool = False) -> DataFrame:
    """A delimited file with a header; blanks become null. A path that is not there is an error, or with
    missing_ok an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.csv(path, schema=schema, sep=separator, header=True, multiLine=separator == ",", quote='"', escape='"')
    return df.select(*[blank_to_null(F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_first_of(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """Parquet from the first path that exists, through the file system that Spark uses for it."""
    for p in paths:
        if exists(spark, p):
            return spark.read.schema(schema).parquet(p)
    raise FileNotFoundError(", ".join(paths))


def merge_slices(slices: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Slices of one scan with possibly missing columns; of rows with the same key the first by order."""
    from functools import reduce

    from ..operators.snapshots import keep_one

    return keep_one(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), slices), key, order, last=False)


def new_rows(landed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, for a resumable append."""
    return landed.join(known.select(key).distinct(), key, "left_anti")


def write_shards(df: DataFrame, path: str, identifier: str, shards: int = 256) -> None:
    """Parquet in one folder per shard of the id, so that a point lookup reads one shard."""
    sharded = df.withColumn("shard", shard_of(F.col(identifier), shards))
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def lookup(spark: SparkSession, path: str, identifier: str, value: str, shards: int = 256) -> DataFrame:
    """The rows of one id: a partition filter on its shard, then equality."""
    shard = spark.range(1).select(shard_of(F.lit(value), shards)).first()[0]
    return spark.read.parquet(path).where((F.col("shard") == shard) & (F.col(identifier) == value)).drop("shard")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; lists become "a; b", nulls are empty."""
    df.select(*[flat(F.col(c), t).alias(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", quote='"', escape='"')


def flat(c: Column, kind: str) -> Column:
    return F.array_join(c.cast("array<string>"), "; ") if kind.startswith("array") else c


def union_of(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows with the ordered union of columns."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Rows of a user's download.
EXPORT_ROWS = 100


def export_rows(df: DataFrame, order: Sequence[Column], limit: int = EXPORT_ROWS) -> DataFrame:
    """The first rows in an order - a download's limit is its meaning."""
    return df.orderBy(*order).limit(limit)


def export_text(df: DataFrame, order: Sequence[Column], metadata: dict[str, str], kind: str = "csv", limit: int = EXPORT_ROWS) -> str:
    """A download of at most `limit` rows as one text: CSV behind comment lines of metadata, or JSON with
    an envelope."""
    rows = export_rows(df, order, limit).collect()
    if kind == "json":
        return json.dumps({"metadata": metadata, "rows": [r.asDict(recursive=True) for r in rows]}, default=str, ensure_ascii=False)
    cells = lambda values: ",".join('"' + str("" if v is None else v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\r\n') else str("" if v is None else v) for v in values)
    return "\r\n".join([*(f"# {k}: {v}" for k, v in metadata.items()), cells(df.columns), *map(cells, rows)]) + "\r\n"


def release_facts(df: DataFrame, date: str, label: str, top: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row of totals (rows, latest date, labels, a digest that does not depend on order), and the
    most frequent values of a column."""
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    facts = df.agg(F.count("*").alias("n_rows"), F.max(date).alias("latest"), F.count_distinct(label).alias("labels"), digest.alias("digest"))
    return facts, df.groupBy(top).agg(F.count("*").alias("n")).orderBy(F.desc("n"), top).limit(n)


def write_slices(df: DataFrame, path: str, column: str) -> None:
    """Parquet with a folder per value; only the values that df holds are replaced."""
    df.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def digest(columns: Sequence[str]) -> Column:
    """An aggregate over rows that does not depend on their order or on how they are laid out."""
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string"))


def pinned(df: DataFrame, pin: str) -> DataFrame:
    """df, if its digest is the pinned one; otherwise an error."""
    found = df.agg(digest(df.columns)).first()[0]
    if found != pin:
        raise ValueError(f"digest {found}, wanted {pin}")
    return df


def publishable(df: DataFrame, key: str) -> DataFrame:
    """df, unless it is empty or a key is missing or repeated; otherwise an error."""
    n, missing, most = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.max("n")).first()
    if not n or missing or most > 1:
        raise ValueError(f"{n or 0} rows, {missing or 0} without {key}, at most {most or 0} of one {key}")
    return df


def capped(df: DataFrame, order: Sequence[Column], limit: int = EXPORT_ROWS) -> DataFrame:
    """The first rows, each with the whole number of rows and whether some are left out."""
    total = df.agg(F.count("*").alias("total"))
    rows = export_rows(df, order, limit).join(F.broadcast(total), F.lit(True))  # one row
    return rows.withColumn("truncated", F.col("total") > limit)


def spreadsheet_lines(df: DataFrame) -> DataFrame:
    """One column, line: header and rows as quoted CSV that ends in a carriage return (the text writer adds the
    line feed), the first with a byte order mark; nulls are empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    head = df.sparkSession.range(1).select(F.concat(F.lit("\ufeff" + ",".join(f'"{c}"' for c in df.columns)), F.lit("\r")).alias("line"))
    return head.unionByName(df.select(F.concat(F.concat_ws(",", *[cell(F.col(c)) for c in df.columns]), F.lit("\r")).alias("line")))


def read_thesaurus(spark: SparkSession, path: str, schema: str, kinds: Sequence[str]) -> DataFrame:
    """A tab-separated thesaurus with "|" between the values of `synonyms` and of `kinds`: retired concepts are
    dropped, and those of other kinds; synonyms come as a list."""
    rows = spark.read.schema(schema).csv(path, sep="\t")
    listed = lambda c: F.split(F.col(c), r"\|")
    wanted = F.arrays_overlap(listed("kinds"), F.array(*map(F.lit, kinds)))
    return rows.where((F.coalesce("status", F.lit("")) != "Retired") & wanted).withColumns({"synonyms": listed("synonyms"), "kinds": listed("kinds")})


def scope_rows(df: DataFrame, order: Sequence[Column], scope: str, keep: Column | None = None, selected: Sequence | None = None, key: str = "id", limit: int = EXPORT_ROWS) -> DataFrame:
    """The rows of a download: "all", "filtered" (where keep holds) or "selected" (of the ids that a user marked)."""
    if scope == "filtered":
        df = df.where(keep)
    elif scope == "selected":
        df = df.where(F.col(key).isin(list(selected or ())))
    elif scope != "all":
        raise ValueError(f"no scope {scope}")
    return export_rows(df, order, limit)


def of_version(df: DataFrame, version: str, wanted: int) -> DataFrame:
    """df, unless a row is of another version of its reader or of none; otherwise an error."""
    other = df.where(~F.col(version).eqNullSafe(F.lit(wanted))).limit(1).count()
    if other:
        raise ValueError(f"rows of another version than {wanted}")
    return df
