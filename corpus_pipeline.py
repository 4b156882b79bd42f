"""The corpus pipeline: five stages from raw documents to a mix of sources.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of documents; the last also says how often each document's words are taken. Run as a
whole, each stage's result is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import decontaminate, mixing, pii, quality_rules, simhash
from harrow.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null text counts as empty and is rejected; rows that share an id
    are judged each for itself; an empty table gives an empty one; further columns are left out."""
    return quality_rules.judge(docs, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document: the one of least id (null ids last). Null and empty texts
    are one component; repeated rows are one document; an empty table gives an empty one."""
    return simhash.deduplicate(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item's window occurs. Null and empty texts have no words and stay; rows that
    share an id are judged together; an empty table gives an empty one."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal spans replaced by their kind; n_chars follows the text. A null text stays null,
    with a null n_chars; repeated rows stay; an empty table gives an empty one."""
    out = docs.withColumn("text", pii.redact(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken (repeats counted). Texts without words are never taken; a null
    source is a source of its own; repeated rows count each for itself; an empty table gives an empty one."""
    out = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return out.where("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", benchmark), ("pii", personal), ("mixing", mix)]
#: SQL has no XXH64 and no chi-square steps in the wanted form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
