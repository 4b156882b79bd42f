"""A request's subject against failed assets and mechanism classes, on persisted postings; bounded mentions of an id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import index

GENE, MECHANISM, MODALITY = "gene:", "mechanism:", "modality:"
#: Verdicts from the closest on.
VERDICTS = ("closest", "related", "weak", "distant", "unknown")


@dataclass(frozen=True)
class Subject:
    """What a request asks about: genes, mechanisms and, if it is a molecule, its modality."""

    genes: Sequence[str] = ()
    mechanisms: Sequence[str] = ()
    modality: str = ""


def write_class_index(lexicon: DataFrame, path: str, gene: str = "gene", klass: str = "class") -> None:
    """Postings from genes to the classes that they belong to, and back."""
    index.write_index(lexicon, f"{path}/by_gene", klass, F.array(F.col(gene)))
    index.write_index(lexicon, f"{path}/by_class", gene, F.array(F.col(klass)))


def classes_for(spark: SparkSession, path: str, genes: Sequence[str]) -> DataFrame:
    """class, genes (sorted): the classes that a set of genes belongs to. Reads the genes' folders only."""
    return index.postings(spark, f"{path}/by_gene", genes).groupBy(F.col("id").alias("class")).agg(F.sort_array(F.collect_set("term")).alias("genes"))


def write_asset_index(assets: DataFrame, path: str, identifier: str, genes: Column, mechanisms: Column, modalities: Column, trials: Column) -> None:
    """Postings of failed assets by gene, mechanism and modality. Each posting carries the asset's number of trials."""
    tagged = lambda tag, c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit(tag), x))
    named = F.concat(tagged(GENE, genes), tagged(MECHANISM, mechanisms))
    index.write_index(assets.withColumns({"trials": trials, "resolved": F.size(named) > 0}), path, identifier, F.concat(named, tagged(MODALITY, modalities)), ["trials", "resolved"])


def related_assets(spark: SparkSession, assets: str, classes: str, subject: Subject) -> DataFrame:
    """asset, trials, verdict, why, shared_genes, shared_mechanisms, shared_classes, same_modality: every asset that shares
    something with the subject, closest first in `place`; the others are distant (or unknown) and have no postings here.

    A shared gene is closest where the modality is shared too, or none was asked for; else related, as are a shared class
    and a shared mechanism; a shared modality alone is weak. An asset's classes come from postings too: the
    subject's classes are looked up, their genes are terms of the request, and a class that both sides hold is shared. An
    asset without genes and mechanisms is unknown, even where the modality is shared."""
    own = set(subject.genes)
    # the subject's classes and their genes: a curated lexicon has few of each
    own_classes = [r["class"] for r in classes_for(spark, classes, sorted(own)).collect()]
    members: dict[str, list[str]] = {}
    for r in index.postings(spark, f"{classes}/by_class", own_classes).select("id", "term").distinct().collect():
        members.setdefault(r["id"], []).append(r["term"])
    genes = sorted(own | set(members))
    terms = [GENE + g for g in genes] + [MECHANISM + m for m in subject.mechanisms] + ([MODALITY + subject.modality] if subject.modality else [])
    hits = index.postings(spark, assets, terms)
    of = lambda tag: F.when(F.startswith("term", F.lit(tag)), F.substring("term", len(tag) + 1, 10_000))
    rows = hits.groupBy(F.col("id").alias("asset")).agg(F.max("trials").alias("trials"), F.bool_or("resolved").alias("resolved"), F.sort_array(F.collect_set(of(GENE))).alias("g"), F.sort_array(F.collect_set(of(MECHANISM))).alias("shared_mechanisms"), F.bool_or(F.startswith("term", F.lit(MODALITY))).alias("same_modality"))
    class_of = F.create_map(*[x for g, c in members.items() for x in (F.lit(g), F.array(*map(F.lit, c)))]) if members else None
    listed = F.array(*map(F.lit, sorted(own))) if own else F.array().cast("array<string>")
    shared_classes = F.sort_array(F.array_distinct(F.flatten(F.transform("g", lambda x: F.coalesce(F.element_at(class_of, x), F.array().cast("array<string>")))))) if members else F.array().cast("array<string>")
    rows = rows.withColumns({"shared_genes": F.array_intersect("g", listed), "shared_classes": shared_classes})
    gene, klass, mechanism, modality = F.size("shared_genes") > 0, F.size("shared_classes") > 0, F.size("shared_mechanisms") > 0, F.col("same_modality")
    pathway = F.concat(F.lit("same pathway ("), F.get("shared_classes", 0), F.lit("), different target"), F.when(modality, ", same modality").otherwise(""))
    verdict = F.when(~F.col("resolved"), "unknown").when(gene & (modality | F.lit(not subject.modality)), "closest").when(gene | klass | mechanism, "related").otherwise("weak")
    why = (
        F.when(~F.col("resolved"), "this molecule's target could not be resolved, so no comparison is possible").when(gene & modality, "same target and same modality").when(gene & F.lit(not subject.modality), "same target").when(gene, "same target, different modality")
        .when(klass, pathway).when(mechanism, "different target, overlapping mechanism").otherwise("same modality only — no target in common")
    )
    order = F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)
    return rows.select("asset", "trials", verdict.alias("verdict"), why.alias("why"), "shared_genes", "shared_mechanisms", "shared_classes", "same_modality", order.cast("int").alias("place"))


#: Parts into which the rows of one key are dealt before their best are compared.
SALTS = 32


def first_per_key(df: DataFrame, key: str, identifier: str, order: Sequence[Column], k: int, salts: int = SALTS) -> DataFrame:
    """The first k rows of each key in an order (made total by the identifier), with their rank. Every task keeps k rows of a
    key before anything is shuffled; the rest meet in parts of the key first, so a key with a third of all rows is no one
    task's. Rows with a null key are left out."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(identifier), F.lit(salts)))
    total = [*order, F.asc(identifier)]
    part = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*total))).where(F.col("rank") <= k)
    return part.drop("rank", "_salt").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*total))).where(F.col("rank") <= k)


def mentions(ids: DataFrame, identifier: str, landed: DataFrame, key: str, item: str, order: Sequence[Column], fields: Sequence[str], k: int = 20) -> DataFrame:
    """Each id with up to k of its mentions in an order (a published limit), as an array of structs; empty for none."""
    best = first_per_key(landed, key, item, order, k)
    lists = best.groupBy(F.col(key).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("rank", item, *fields))).alias("mentions"))
    empty = F.array().cast(lists.schema["mentions"].dataType)
    return ids.join(lists, F.col(identifier) == F.col("_id"), "left").select(*ids.columns, F.coalesce("mentions", empty).alias("mentions"))
