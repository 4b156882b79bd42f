"""Whole registry studies: one stated schema, a reader that keeps what does not parse, and a landed table that is read by leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

_DATE = "struct<date:string,type:string>"
#: The sections and fields of a study that anything here reads.
SCHEMA = f"""
protocolSection struct<
  identificationModule: struct<nctId:string,briefTitle:string,officialTitle:string>,
  statusModule: struct<overallStatus:string,whyStopped:string,startDateStruct:{_DATE},primaryCompletionDateStruct:{_DATE},completionDateStruct:{_DATE},lastUpdatePostDateStruct:struct<date:string>>,
  descriptionModule: struct<briefSummary:string,detailedDescription:string>,
  conditionsModule: struct<conditions:array<string>>,
  sponsorCollaboratorsModule: struct<leadSponsor:struct<name:string,class:string>,collaborators:array<struct<name:string>>>,
  designModule: struct<studyType:string,phases:array<string>,designInfo:struct<allocation:string>,enrollmentInfo:struct<count:long,type:string>>,
  armsInterventionsModule: struct<armGroups:array<struct<label:string,type:string>>,interventions:array<struct<name:string,type:string,armGroupLabels:array<string>>>>,
  contactsLocationsModule: struct<locations:array<struct<country:string>>>>,
derivedSection struct<conditionBrowseModule: struct<meshes:array<struct<id:string,term:string>>>>,
hasResults boolean
""".replace("\n", " ")
CORRUPT = "_corrupt"


def read_studies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines as studies. A line that is no study by the schema has nulls and its text in `_corrupt`."""
    schema = StructType([*spark.createDataFrame([], SCHEMA).schema.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def land_studies(spark: SparkSession, path: str | list[str], out: str) -> DataFrame:
    """Studies as a nested table, of which later reads take the named leaves only, and in it the lines that did not
    parse, marked as rejected. Gives the number of each. Lines are parsed once and written as they come: folders by mark
    would have each task sort its rows, and packed lines make large tasks."""
    rows = read_studies(spark, path).withColumn("rejected", F.col(CORRUPT).isNotNull())
    rows.write.mode("overwrite").parquet(out)
    return spark.read.schema("rejected boolean").parquet(out).groupBy("rejected").agg(F.count("*").alias("n"))


def landed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, rejected boolean").parquet(out).where("not rejected").drop("rejected")


def rejected(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{CORRUPT} string, rejected boolean").parquet(out).where("rejected").select(CORRUPT)
