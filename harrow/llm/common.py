"""Helpers shared by the training-data operators: shared scratch tables, checked
broadcasts, and vectorised hashing of words, shingles and windows inside a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' word class, as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only
    where that is unset (single-machine tests) one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='harrow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. What a
    lost executor had written stays readable, and later plans see true sizes."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is (then a
    shuffled join, whose hot partitions adaptive execution splits). df should be materialized."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# --- vectorised text work inside a task -------------------------------------------------

#: Odd multipliers and their inverses modulo 2**64 for polynomial prefix hashes.
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
_QINV = pow(_Q, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    p = _POW.get(base)
    if p is None or len(p) < n:
        size = 1 << max(12, (n - 1).bit_length())
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        _POW[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(separators: Iterable[int], lower: bool) -> bytes:
    """A bytes.translate table: separators become a space, A-Z lower case if asked."""
    table = bytearray(range(256))
    if lower:
        for c in range(65, 91):
            table[c] = c + 32
    for c in separators:
        table[c] = 32
    return bytes(table)


#: Tab to carriage return, and the space.
SPACES = (32, *range(9, 14))
#: ASCII that is neither digit nor letter (letters are lower-cased first).
NON_ALNUM = tuple(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
SPACE_TABLE = byte_table(SPACES, lower=False)
SPACE_LOWER_TABLE = byte_table(SPACES, lower=True)
ALNUM_LOWER_TABLE = byte_table(NON_ALNUM, lower=True)


class Words:
    """The words of several texts: hash, start and end byte, and index of the text."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.data = b" ".join(texts).translate(table) + b" "
        buf = np.frombuffer(self.data, np.uint8)
        inside = np.empty(len(buf) + 1, bool)
        inside[0] = False
        np.not_equal(buf, 32, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[buf] * _powers(_R, len(buf)), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _powers(_RINV, len(buf))[self.starts]
        self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(bounds, self.starts, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are of one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        sums = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(mix(self.hashes ^ np.uint64(salt)) * _powers(_Q, len(self)), out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * _powers(_QINV, n) + np.uint64(salt)), self.text[: n] == self.text[k - 1 :]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as bytes (null: empty), in runs of about max_bytes; a longer text
    is a run of its own. Gives the index of the first row with each run."""
    run: list[bytes] = []
    size = begin = 0
    col = batch.column(column).cast(pa.large_binary())
    for i in range(len(col)):
        t = col[i].as_py() or b""
        if run and size + len(t) > max_bytes:
            yield begin, run
            run, size, begin = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield begin, run


# --- fixed-size filters ------------------------------------------------------------------


def bit_filter(hashes: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A bitmap of 2**log2_bits bits with a bit for each 64-bit hash of the column (its top
    bits). Its size is fixed, whatever the table; it only ever lets too much through."""
    bit = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    rows = (
        hashes.select(F.shiftright(bit, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
    )
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    got = rows.toArrow()
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - (len(bits).bit_length() - 1) - 6)
    bit = hashes >> shift
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0

