"""Request-time forms: persisted postings for classes and comparisons (D), and bounded mentions of an id (A). A part is an
asset: the words of its name are genes, those of its type mechanisms, its brand a modality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison
from ..sources.scratch import folder
from .registry import query, table

#: A class holds the genes that begin with its letter; each gene is in one, those with an "e" in a second.
LEXICON = "lex AS (SELECT DISTINCT upper(substring(g, 1, 1)) || '-axis' AS class, g AS gene FROM (SELECT unnest(string_split(p_name, ' ')) AS g FROM part) UNION SELECT DISTINCT 'E-group', g FROM (SELECT unnest(string_split(p_name, ' ')) AS g FROM part) WHERE contains(g, 'e'))"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("gene")).distinct()
    axis = genes.select(F.concat(F.upper(F.substring("gene", 1, 1)), F.lit("-axis")).alias("class"), "gene")
    return axis.union(genes.where(F.contains("gene", F.lit("e"))).select(F.lit("E-group").alias("class"), "gene"))


def _subject(spark: SparkSession, sf_dir: str, modality: bool = True) -> comparison.Subject:
    row = table(spark, sf_dir, "part").where("p_partkey = 7").select(F.split("p_name", " ").alias("g"), F.split("p_type", " ").alias("m"), "p_brand").first()
    return comparison.Subject(row["g"], row["m"][:1], row["p_brand"] if modality else "")


@query("d26_indexed_classes", f"WITH {LEXICON}, s AS (SELECT unnest(string_split(p_name, ' ')) AS gene FROM part WHERE p_partkey = 7) SELECT class, array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes FROM lex JOIN s USING (gene) GROUP BY class")
def indexed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of a request's genes, from the folders of those genes."""
    path = folder(spark)
    comparison.write_class_index(lexicon(spark, sf_dir), path)
    found = comparison.classes_for(spark, path, _subject(spark, sf_dir).genes)
    return found.select("class", F.array_join("genes", ",").alias("genes"))


#: Assets without a type word are those whose key is a multiple of 9; without a name and type, of 50.
ASSETS = """a AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN [] ELSE list_distinct(string_split(p_name, ' ')) END AS g, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 50 = 0 THEN [] ELSE list_distinct(string_split(p_type, ' ')) END AS m, p_brand, p_size AS trials FROM part),
  su AS (SELECT string_split(p_name, ' ') AS g, string_split(p_type, ' ')[1] AS m, p_brand FROM part WHERE p_partkey = 7),
  mates AS (SELECT DISTINCT class FROM lex, su WHERE list_contains(su.g, gene)), mg AS (SELECT gene, class FROM lex JOIN mates USING (class)),
  x AS (SELECT a.p_partkey AS asset, a.trials, list_sort(list_intersect(a.g, su.g)) AS sg, list_sort(list_filter(a.m, lambda v: v = su.m)) AS sm, a.p_brand = su.p_brand AS sb, len(a.g) + len(a.m) > 0 AS resolved,
        coalesce((SELECT list_sort(list(DISTINCT class)) FROM mg WHERE list_contains(a.g, mg.gene)), []) AS sc FROM a, su),
  y AS (SELECT * FROM x WHERE len(sg) + len(sm) + len(sc) > 0 OR sb)"""


@query(
    "d18_indexed_comparison",
    f"""WITH {LEXICON}, {ASSETS} SELECT asset, trials, CASE WHEN NOT resolved THEN 'unknown' WHEN len(sg) > 0 AND sb THEN 'closest' WHEN len(sg) > 0 OR len(sc) > 0 OR len(sm) > 0 THEN 'related' ELSE 'weak' END AS verdict,
    CASE WHEN NOT resolved THEN 'this molecule''s target could not be resolved, so no comparison is possible' WHEN len(sg) > 0 AND sb THEN 'same target and same modality' WHEN len(sg) > 0 THEN 'same target, different modality'
      WHEN len(sc) > 0 THEN 'same pathway (' || sc[1] || '), different target' || CASE WHEN sb THEN ', same modality' ELSE '' END WHEN len(sm) > 0 THEN 'different target, overlapping mechanism' ELSE 'same modality only — no target in common' END AS why,
    array_to_string(sg, ',') AS genes, array_to_string(sm, ',') AS mechanisms, array_to_string(sc, ',') AS classes, sb AS same_modality FROM y""",
)
def indexed_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed assets that share something with a subject, read from the folders of its terms."""
    assets, classes = folder(spark), folder(spark)
    comparison.write_class_index(lexicon(spark, sf_dir), classes)
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    genes = F.when(k % 50 == 0, none).otherwise(F.split("p_name", " "))
    mechanisms = F.when((k % 9 == 0) | (k % 50 == 0), none).otherwise(F.split("p_type", " "))
    comparison.write_asset_index(table(spark, sf_dir, "part"), assets, "p_partkey", genes, mechanisms, F.array("p_brand"), F.col("p_size"))
    found = comparison.related_assets(spark, assets, classes, _subject(spark, sf_dir))
    joined = {a: F.array_join(b, ",") for a, b in (("genes", "shared_genes"), ("mechanisms", "shared_mechanisms"), ("classes", "shared_classes"))}
    return found.withColumns(joined).select("asset", "trials", "verdict", "why", "genes", "mechanisms", "classes", "same_modality")


@query(
    "a14_mentions",
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 20),
    g AS (SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY rank) AS items FROM e GROUP BY 1)
    SELECT c_custkey, coalesce(n, 0)::INTEGER AS n, coalesce(items, '') AS items FROM customer LEFT JOIN g ON user_id = c_custkey""",
)
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty events of each customer, by value; none for most."""
    found = comparison.mentions(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "events"), "user_id", "event_id", [F.desc("value")], ["event_type", "ts"])
    return found.select("c_custkey", F.size("mentions").alias("n"), F.array_join(F.transform("mentions", lambda m: m["event_id"].cast("string")), ",").alias("items"))
