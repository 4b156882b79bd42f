"""Family A: landed snapshots, caches, shards and exports, each written to the shared folder and read back, so
that what a query returns has passed the sink and the source it is named after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import resolution, snapshots
from ..sources import tables
from ..sources.scratch import folder
from .registry import query, table

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


ALL = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


@query("a04_year_slices", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders")
def year_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with a partition per year; one year is fetched again and replaces its own slice only."""
    path = folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    tables.write_slices(o.where("year <> 1996 or o_orderkey % 2 = 0"), path, "year")
    tables.write_slices(o.where("year = 1996"), path, "year")
    return spark.read.schema("o_orderkey long, year int").parquet(path)


@query("a08_resumable_append", "SELECT p_partkey, p_name FROM part")
def resumable_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known already is not appended again."""
    path = folder(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    part.where("p_partkey % 3 = 0").write.parquet(path)
    known = spark.read.schema(part.schema).parquet(path)
    tables.new_rows(part, known, "p_partkey").write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


@query("a16_json_arrays", ALL)
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one JSON array each, written and read as such."""
    path = folder(spark)
    tables.write_json_arrays(customers(spark, sf_dir), path, rows_per_file=1000)
    return tables.read_json(spark, path, CUSTOMER, lines=False)


@query("a24_pretty_arrays", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 2 END::INTEGER AS n_tags FROM orders")
def pretty_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table as indented JSON arrays of bounded size, with nulls and lists, read back."""
    path = folder(spark)
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(k % 3 > 0, F.col("o_totalprice")).alias("price"), F.when(k % 3 > 0, F.array("o_orderstatus", F.lit('say "x"\n'))).alias("tags"))
    tables.write_json_arrays(rows, path, pretty=True)
    back = tables.read_json(spark, path, "o_orderkey long, o_orderpriority string, price double, tags array<string>", lines=False)
    return back.select("o_orderkey", "o_orderpriority", "price", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"))


@query("a17_json_lines", ALL)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    customers(spark, sf_dir).write.json(path)
    return tables.read_json(spark, path, CUSTOMER)


@query("a18_gzip_json_lines", "SELECT c_custkey, lower(c_mktsegment) AS area, c_nationkey % 2 = 0 AS even, length(c_name)::INTEGER AS name_chars FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def gzip_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed lines, filtered by area, with derived columns."""
    path = folder(spark)
    customers(spark, sf_dir).write.option("compression", "gzip").json(path)
    rows = tables.read_json(spark, path, CUSTOMER).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return rows.select("c_custkey", F.lower("c_mktsegment").alias("area"), (F.col("c_nationkey") % 2 == 0).alias("even"), F.length("c_name").alias("name_chars"))


@query("a19_csv_overrides", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 'DEFAULT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def csv_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with ragged blanks and empty fields: trimmed, empty is null, null gets the default."""
    path = folder(spark)
    ragged = customers(spark, sf_dir).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))))
    ragged.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_csv(spark, path, CUSTOMER).na.fill("DEFAULT", ["c_mktsegment"])


@query("a20_csv_or_empty", "SELECT c_custkey, nullif(trim(c_name), '') AS c_name, 'landed' AS origin FROM customer WHERE c_custkey % 2 = 0")
def csv_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is there and one that is not, which is an empty table of the same columns."""
    there, columns = folder(spark), "c_custkey long, c_name string"
    customers(spark, sf_dir).where("c_custkey % 2 = 0").select("c_custkey", "c_name").write.csv(there, header=True)
    parts = [tables.read_csv(spark, p, columns, missing_ok=True).withColumn("origin", F.lit(o)) for p, o in ((there, "landed"), (folder(spark), "missing"))]
    return parts[0].union(parts[1])


@query("a21_pinned_lines", ALL)
def pinned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is read only if the digest of its rows is the pinned one."""
    path = folder(spark)
    rows = customers(spark, sf_dir)
    rows.write.json(path)
    pin = rows.agg(tables.digest(rows.columns)).first()[0]
    return tables.pinned(tables.read_json(spark, path, CUSTOMER), pin)


@query("a22_csv_sink", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    tables.write_csv(customers(spark, sf_dir).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment"))), path)
    return tables.read_csv(spark, path, CUSTOMER)


@query("a23_union_header", "SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def union_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    tables.write_csv(tables.union_of([a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))]), path)
    return tables.read_csv(spark, path, "id long, name string, brand string")


@query("a26_detail_shards", "SELECT page_id, (page_id % 256)::INTEGER AS shard FROM pages")
def detail_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards refuse empty tables and ids that are missing or repeated."""
    path = folder(spark)
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("NCT"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("id"))
    tables.write_shards(tables.publishable(rows, "id"), path, "id")
    return spark.read.parquet(path).select("page_id", F.col("shard").cast("int").alias("shard"))


@query("a27_digit_chunks", "SELECT (page_id % 10)::INTEGER AS chunk, page_id, lower(url) AS blob FROM pages")
def digit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).cast("int").alias("chunk"), "page_id", F.lower("url").alias("blob"))
    tables.write_slices(rows, path, "chunk")
    return spark.read.schema("page_id long, blob string, chunk int").parquet(path)


@query("a28_fallback_paths", ALL)
def fallback_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    customers(spark, sf_dir).write.parquet(path)
    return tables.read_first_of(spark, [f"{path}-gone", f"{path}-also", path], CUSTOMER)


@query("a29_point_lookup", "SELECT page_id, url FROM pages WHERE page_id = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard is read for one id."""
    path = folder(spark)
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("NCT"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("id"))
    tables.write_shards(rows, path, "id")
    return tables.lookup(spark, path, "id", "NCT00000017").select("page_id", "url")


@query("a30_published_facts", "SELECT count(*) AS n_rows, max(o_orderdate)::DATE AS latest, count(DISTINCT o_orderstatus) AS labels FROM orders")
def published_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.publishable(table(spark, sf_dir, "orders"), "o_orderkey")
    facts, _ = tables.release_facts(rows, "o_orderdate", "o_orderstatus", "o_orderpriority")
    return facts.select("n_rows", F.col("latest").cast("date").alias("latest"), "labels")


@query("a33_capped_export", "SELECT least(count(*), 100) AS n_rows, count(*) > 100 AS truncated, count(*) AS total FROM part WHERE p_size > 10")
def capped_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A download's limit, with the whole number and whether it was cut."""
    return tables.capped(table(spark, sf_dir, "part").where("p_size > 10"), [F.col("p_partkey")]).agg(F.count("*").alias("n_rows"), F.max("truncated").alias("truncated"), F.max("total").alias("total"))


@query("a34_spreadsheet_csv", "SELECT chr(65279) || '\"c_custkey\",\"c_mktsegment\"' || chr(13) AS line FROM range(1) UNION ALL SELECT '\"' || c_custkey || '\",\"' || CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END || '\"' || chr(13) FROM customer")
def spreadsheet_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV with a byte order mark, CRLF ends and empty nulls."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return tables.spreadsheet_lines(rows)


@query("a38_index_scan", "SELECT c_custkey, upper(regexp_replace(trim(c_mktsegment), '[\\s/-]+', '_', 'g')) AS code FROM customer")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    customers(spark, sf_dir).write.json(path)
    return tables.read_json(spark, path, CUSTOMER).select("c_custkey", text.code_of(F.col("c_mktsegment")).alias("code"))


@query("a07_batched_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 7 = 0")
def batched_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of a list of ids from a landed table; ids without one are left out."""
    wanted = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select("p_partkey").union(spark.range(-5, -1).toDF("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(wanted, "p_partkey", "left_semi")


@query("a15_registrants", "SELECT lower(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g')) AS name, max(s_suppkey) AS cik FROM supplier GROUP BY 1")
def registrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary by normalised name; of several the latest number."""
    s = table(spark, sf_dir, "supplier").select(text.organisation_key(F.col("s_name")).alias("name"), F.col("s_suppkey").alias("cik"))
    return snapshots.keep_one(s, "name", "cik", last=True)


# --- downloads and publishing --------------------------------------------------------------------------


def lines_of(spark: SparkSession, whole: str) -> DataFrame:
    """A download's text (at most EXPORT_ROWS rows) by lines."""
    return spark.createDataFrame(list(enumerate(whole.split("\r\n")[:-1])), "place long, line string")


@query(
    "a31_csv_download",
    '''WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n, '"' || p_brand || ', ""' || p_size || '"""' AS label FROM part)
    SELECT 0::BIGINT AS place, '# title: parts' AS line UNION ALL SELECT 1, '# scope: all' UNION ALL SELECT 2, 'p_partkey,label' UNION ALL SELECT n + 2, p_partkey || ',' || label FROM r WHERE n <= 100''',
)
def csv_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of metadata, a header, and quoted rows up to a download's limit."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(', "'), "p_size", F.lit('"')).alias("label"))
    return lines_of(spark, tables.export_text(rows, [F.col("p_partkey")], {"title": "parts", "scope": "all"}))


@query("a32_json_download", "SELECT 'parts' AS title, p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 100")
def json_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope of metadata and rows, parsed again."""
    whole = tables.export_text(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), [F.col("p_partkey")], {"title": "parts"}, "json")
    read = spark.createDataFrame([(whole,)], "whole string").select(F.from_json("whole", "metadata struct<title: string>, rows array<struct<p_partkey: long, p_brand: string>>").alias("w"))
    return read.select(F.col("w.metadata.title").alias("title"), F.inline("w.rows"))


@query(
    "a37_download_scopes",
    """SELECT * FROM (SELECT 'all' AS scope, p_partkey FROM part ORDER BY p_partkey LIMIT 100) UNION ALL SELECT * FROM (SELECT 'filtered', p_partkey FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 100)
    UNION ALL SELECT 'selected', p_partkey FROM part WHERE p_partkey IN (3, 5, 8)""",
)
def download_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, order = table(spark, sf_dir, "part"), [F.col("p_partkey")]
    scopes = [tables.scope_rows(part, order, s, F.col("p_size") > 25, [3, 5, 8, -1], "p_partkey").select(F.lit(s).alias("scope"), "p_partkey") for s in ("all", "filtered", "selected")]
    return tables.union_of(scopes)


@query("a39_published_verdicts", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def published_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of stopped records, all from the reader's present version."""
    o = table(spark, sf_dir, "orders")
    verdicts = o.select("o_orderkey", "o_orderpriority", F.lit(2).alias("version"))
    return tables.of_version(verdicts, "version", 2).join(o.where("o_orderstatus = 'F'"), "o_orderkey", "left_semi").drop("version")


# --- landed thesauri and molecules ---------------------------------------------------------------------


@query(
    "a10_thesaurus",
    "SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS synonym FROM part WHERE p_size % 5 > 0 AND (contains(p_type, 'STEEL') OR contains(p_type, 'TIN'))",
)
def thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    barred = lambda c: F.replace(c, F.lit(" "), F.lit("|"))
    part = table(spark, sf_dir, "part")
    part.select("p_partkey", barred("p_name"), F.when(F.col("p_size") % 5 == 0, "Retired"), barred("p_type")).write.csv(path, sep="\t")
    return tables.read_thesaurus(spark, path, "id long, synonyms string, status string, kinds string", ["STEEL", "TIN"]).select("id", F.explode("synonyms").alias("synonym"))


LANDED = """syn AS (SELECT split_part(p_name, ' ', 1) AS name, p_partkey AS id FROM part WHERE p_partkey % 40 = 0), par AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_partkey % 10 END AS parent FROM part)"""


@query(
    "a40_one_parent",
    f"""WITH {LANDED}, g AS (SELECT name, count(DISTINCT coalesce(parent, id)) AS k, min(coalesce(parent, id)) AS p FROM syn LEFT JOIN par USING (id) GROUP BY name), t AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS term FROM part)
    SELECT term, CASE WHEN k = 1 THEN p END AS molecule FROM t LEFT JOIN g ON term = name""",
)
def one_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term's molecule, by its exact synonyms folded to parents; null unless there is one."""
    part = table(spark, sf_dir, "part")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    synonyms = part.where("p_partkey % 40 = 0").select(word(1).alias("name"), F.col("p_partkey").alias("id"))
    parents = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey") % 10).alias("parent"))
    return resolution.one_parent(part.select(word(2).alias("term")).distinct(), "term", synonyms, parents, "molecule")


@query(
    "a41_mechanisms",
    "SELECT p_brand AS molecule, p_type AS mechanism, array_to_string(list_sort(list(DISTINCT 'G' || (p_size % 7)) FILTER (p_size % 3 > 0)), ',') AS genes FROM part WHERE p_size % 2 = 0 GROUP BY ALL",
)
def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanisms of molecules, each with the genes of its targets (none: null)."""
    part = table(spark, sf_dir, "part")
    acts = part.where("p_size % 2 = 0").select(F.col("p_brand").alias("molecule"), F.col("p_type").alias("mechanism"), F.col("p_size").alias("target"))
    genes = part.where("p_size % 3 > 0").select(F.col("p_size").alias("target"), F.concat(F.lit("G"), F.col("p_size") % 7).alias("gene"))
    return resolution.mechanisms_with_genes(acts, genes).select("molecule", "mechanism", F.when(F.size("genes") > 0, F.array_join("genes", ",")).alias("genes"))


RX = """con AS (SELECT p_name AS name, p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'PIN' ELSE 'BN' END AS kind FROM part),
  rel AS (SELECT p_partkey AS id, p_partkey % 10 AS ingredient FROM part WHERE p_size % 3 > 0 UNION ALL SELECT p_partkey, 100 + p_partkey % 7 FROM part WHERE p_size % 5 = 0)"""


@query(
    "a11_single_ingredient",
    f"""WITH {RX}, r AS (SELECT id, count(DISTINCT ingredient) AS k, min(ingredient) AS i FROM rel GROUP BY id), c AS (SELECT name, CASE WHEN kind <> 'BN' THEN id WHEN k = 1 THEN i END AS ingredient FROM con LEFT JOIN r USING (id))
    SELECT name, CASE WHEN count(DISTINCT ingredient) = 1 THEN min(ingredient) END AS ingredient FROM c GROUP BY name""",
)
def single_ingredient(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "IN").when(F.col("p_size") % 4 == 1, "PIN").otherwise("BN")
    concepts = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), kind.alias("kind"))
    related = part.where("p_size % 3 > 0").selectExpr("p_partkey AS id", "p_partkey % 10 AS ingredient").union(part.where("p_size % 5 = 0").selectExpr("p_partkey", "100 + p_partkey % 7"))
    return resolution.single_ingredient(concepts, related)


@query("a12_class_names", "SELECT p_brand AS ingredient, array_to_string(list_sort(list(DISTINCT p_type)), '; ') AS classes FROM part WHERE p_size % 3 < 2 GROUP BY 1")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of an ingredient, of two of the kinds of class."""
    kind = F.element_at(F.array(F.lit("MOA"), F.lit("EPC"), F.lit("PK")), (F.col("p_size") % 3 + 1).cast("int"))
    classes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ingredient"), kind.alias("kind"), F.col("p_type").alias("name"))
    return resolution.class_names(classes, ["MOA", "EPC"]).select("ingredient", F.array_join("classes", "; ").alias("classes"))


@query(
    "a13_marketed",
    """WITH base AS (SELECT p_partkey AS id, p_partkey % 100 AS base FROM part WHERE p_size % 2 = 0), prod AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45)
    SELECT p_partkey AS id, p_partkey IN (SELECT id FROM prod) OR coalesce(base IN (SELECT id FROM prod), false) AS marketed FROM part LEFT JOIN base ON p_partkey = id""",
)
def marketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an ingredient, or the base that it is a form of, has a product."""
    part = table(spark, sf_dir, "part")
    base = part.where("p_size % 2 = 0").selectExpr("p_partkey AS id", "p_partkey % 100 AS base")
    products = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return resolution.marketed(part.select(F.col("p_partkey").alias("id")), base, products)
