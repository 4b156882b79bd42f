"""Families D11-D14 and L (resolution) on parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution
from .registry import query, table

DIMS = """names AS (SELECT lower(p_name) AS name, p_brand AS entity FROM part WHERE p_partkey % 3 > 0),
  mech AS (SELECT DISTINCT p_brand AS entity, 'makes' AS mechanism, CASE WHEN p_size % 2 = 0 THEN p_size END AS target FROM part WHERE p_brand < 'Brand#4'),
  tg AS (SELECT DISTINCT p_size AS target, 'G' || (p_size % 7) AS gene FROM part WHERE p_size % 4 = 0)"""


@query(
    "d11_component_status",
    f"""WITH {DIMS}, e AS (SELECT name, count(DISTINCT entity) AS k, min(entity) AS e FROM names GROUP BY name),
      r AS (SELECT entity, count(mechanism) AS m, count(mech.target) AS t, list_sort(list(DISTINCT gene) FILTER (gene IS NOT NULL)) AS genes FROM mech LEFT JOIN tg ON mech.target = tg.target GROUP BY entity)
      SELECT p_partkey, CASE WHEN k IS NULL THEN 'UNKNOWN' WHEN k > 1 THEN 'AMBIGUOUS' WHEN coalesce(m, 0) = 0 THEN 'NO_MECHANISM' WHEN t = 0 THEN 'NO_TARGET' WHEN genes IS NULL OR len(genes) = 0 THEN 'NO_GENE' ELSE 'RESOLVED' END AS status,
        CASE WHEN k = 1 THEN e END AS entity, CASE WHEN k = 1 THEN coalesce(array_to_string(genes, ','), '') ELSE '' END AS genes
      FROM part LEFT JOIN e ON lower(p_name) = name LEFT JOIN r ON r.entity = e""",
)
def component_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.where("p_partkey % 3 > 0").select(F.lower("p_name").alias("name"), F.col("p_brand").alias("entity"))
    mech = part.where("p_brand < 'Brand#4'").select(F.col("p_brand").alias("entity"), F.lit("makes").alias("mechanism"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("target")).distinct()
    targets = part.where("p_size % 4 = 0").select(F.col("p_size").alias("target"), F.concat(F.lit("G"), (F.col("p_size") % 7).cast("string")).alias("gene")).distinct()
    out = resolution.component_status(part.select("p_partkey", "p_name"), "p_partkey", "p_name", names, mech, targets)
    return out.select("p_partkey", "status", "entity", F.array_join("genes", ",").alias("genes"))


@query("d14_unique_prefix", "WITH i AS (SELECT lower(replace(s_name, '#', ' ')) AS n, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) SELECT s_name, e.s_suppkey AS cik, CASE WHEN e.s_suppkey IS NOT NULL THEN 'exact' END AS method FROM supplier s LEFT JOIN i e ON lower(replace(s_name, '#', ' ')) = e.n")
def unique_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    issuers = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("issuer"), F.col("s_suppkey").alias("cik"))
    return resolution.unique_prefix(s.select("s_name"), "s_name", issuers, "issuer", "cik")


@query("l04_components", "SELECT p_partkey, unnest(list_distinct(string_split(lower(p_type), ' '))) AS component FROM part")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = resolution.expand_regimen(F.replace("p_type", F.lit(" "), F.lit(" + ")), {"R-CHOP": ["rituximab"]})
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(parts).alias("component"))


@query("l02_modality", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'HARD' WHEN contains(lower(p_type), 'tin') THEN 'SOFT' ELSE 'UNKNOWN' END AS modality FROM part")
def modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", resolution.modality(F.col("p_type"), F.col("p_name"), [("steel", "HARD"), ("tin", "SOFT")]).alias("modality"))


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a design: its line statuses are arms, its parts the interventions in them."""
    lines = table(spark, sf_dir, "lineitem")
    drugs = lines.groupBy("l_orderkey", F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string")).alias("name")).agg(F.collect_set("l_linestatus").alias("arms"))
    iv = drugs.groupBy("l_orderkey").agg(F.collect_list(F.struct("name", F.lit("DRUG").alias("kind"), "arms")).alias("interventions"))
    arm = F.struct(F.col("l_linestatus").alias("label"), F.when(F.col("l_linestatus") == "O", "EXPERIMENTAL").otherwise("ACTIVE_COMPARATOR").alias("type"))
    return iv.join(lines.groupBy("l_orderkey").agg(F.collect_set(arm).alias("arms")), "l_orderkey")


DESIGN = """d AS (SELECT l_orderkey, 'P' || (l_partkey % 3) AS name, bool_or(l_linestatus = 'O') AS x, bool_or(l_linestatus = 'F') AS c FROM lineitem GROUP BY ALL)"""


@query("l06_roles", f"WITH {DESIGN} SELECT l_orderkey, name, CASE WHEN x AND c THEN 'BACKGROUND' WHEN x THEN 'EXPERIMENTAL' ELSE 'COMPARATOR' END AS role FROM d")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = designs(spark, sf_dir).select("l_orderkey", F.explode(resolution.arm_types(F.col("interventions"), F.col("arms"))).alias("i"))
    return iv.select("l_orderkey", F.col("i.name").alias("name"), resolution.role(F.col("i")).alias("role"))


@query("l07_backbone", f"WITH {DESIGN} SELECT l_orderkey, CASE WHEN bool_or(c) AND bool_or(x AND NOT c) THEN coalesce(string_agg(name, ',' ORDER BY name) FILTER (x AND c), '') ELSE '' END AS backbone FROM d GROUP BY l_orderkey")
def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs(spark, sf_dir).select("l_orderkey", F.array_join(resolution.shared_backbone(F.col("interventions"), F.col("arms")), ",").alias("backbone"))


@query("l05_arm_types", f"WITH {DESIGN} SELECT l_orderkey, name, concat_ws(',', CASE WHEN c THEN 'ACTIVE_COMPARATOR' END, CASE WHEN x THEN 'EXPERIMENTAL' END) AS types FROM d")
def arm_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = designs(spark, sf_dir).select("l_orderkey", F.explode(resolution.arm_types(F.col("interventions"), F.col("arms"))).alias("i"))
    return iv.select("l_orderkey", F.col("i.name").alias("name"), F.array_join("i.types", ",").alias("types"))


RESOLVED = f"""WITH {DESIGN}, f AS (SELECT l_orderkey, string_agg(name, ',' ORDER BY name) FILTER (x AND NOT c) AS drugs, string_agg('E' || name[2:], ',' ORDER BY name) FILTER (x AND NOT c AND name < 'P2') AS entities,
  bool_or(x AND NOT c AND name = 'P0') AS p0, count(*) FILTER (x AND NOT c) AS n FROM d GROUP BY l_orderkey)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P0 resolves to a gene, P1 to an entity without one, P2 is unknown."""
    r = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("target"))
    named = lambda letter: F.concat(F.lit(letter), F.col("target"))
    names = r.select(F.lower(named("P")).alias("name"), named("E").alias("entity"))
    mech = r.select(named("E").alias("entity"), F.lit("acts").alias("mechanism"), "target")
    return resolution.resolve_records(designs(spark, sf_dir), "l_orderkey", names, mech, r.where("target = 0").select("target", named("G").alias("gene")))


@query("l08_resolved_records", f"{RESOLVED} SELECT l_orderkey, CASE WHEN n = 0 THEN 'NO_FOCUS' WHEN NOT p0 THEN 'UNRESOLVED' WHEN n = 1 THEN 'RESOLVED' ELSE 'PARTIAL' END AS status, coalesce(entities, '') AS entities, CASE WHEN p0 THEN 'G0' ELSE '' END AS genes FROM f")
def resolved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("l_orderkey", "status", F.array_join("entities", ",").alias("entities"), F.array_join("genes", ",").alias("genes"))


@query("b23_experimental_drugs", f"{RESOLVED} SELECT l_orderkey, coalesce(replace(drugs, ',', '; '), '') AS drugs FROM f")
def experimental_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("l_orderkey", F.array_join("drugs", "; ").alias("drugs"))
