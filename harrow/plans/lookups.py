"""Families D (joins beyond snapshots) and L (resolution)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins
from .registry import query, table


@query("d06_text_match_counts", "WITH d AS (SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '))) AS k FROM documents), a AS (SELECT k, count(*) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY k), b AS (SELECT k, count(*) AS m FROM d WHERE doc_id % 2 = 1 GROUP BY k) SELECT k, n, m FROM a JOIN b USING (k)")
def text_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("k"))
    side = lambda r, n: d.where(F.col("doc_id") % 2 == r).groupBy("k").agg(F.count("*").alias(n))
    return side(0, "n").join(side(1, "m"), "k")


@query("d10_interval_self_join", "SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND (epoch(a.ts)::BIGINT < epoch(b.ts)::BIGINT OR (epoch(a.ts)::BIGINT = epoch(b.ts)::BIGINT AND a.event_id < b.event_id)) AND epoch(b.ts)::BIGINT - epoch(a.ts)::BIGINT <= 7200")
def interval_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times count in whole seconds, rounded (halves to even), as the SQL's cast does."""
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    e = table(spark, sf_dir, "events").withColumn("ts", F.timestamp_seconds(seconds))
    return joins.within_interval(e, "user_id", "ts", "event_id", 7200)


@query(
    "d13_longest_prefix",
    """WITH a AS (SELECT * FROM (VALUES ('STANDARD', 'std'), ('STANDARD POLISHED', 'std-pol'), ('PROMO', 'promo'), ('PROMO BURNISHED COPPER', 'pbc'), ('ECONOMY ANODIZED STEEL', 'eas')) v(alias, target)),
       n AS (SELECT DISTINCT p_type FROM part)
       SELECT p_type, coalesce(arg_max(target, length(alias)), p_type) AS target, CASE WHEN max(length(alias)) IS NULL THEN 'self' WHEN max(length(alias)) = length(p_type) THEN 'exact' ELSE 'prefix' END AS method
       FROM n LEFT JOIN a ON p_type = alias OR starts_with(p_type, alias || ' ') GROUP BY p_type""",
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("STANDARD", "std"), ("STANDARD POLISHED", "std-pol"), ("PROMO", "promo"), ("PROMO BURNISHED COPPER", "pbc"), ("ECONOMY ANODIZED STEEL", "eas")], "alias string, target string")
    return joins.longest_prefix(table(spark, sf_dir, "part"), "p_type", aliases)


TERMS = [(1, "permission"), (2, "licen"), (3, "token"), (4, "@mail"), (5, "the")]


@query("d15_first_term", "WITH t AS (SELECT * FROM (VALUES (1, 'permission'), (2, 'licen'), (3, 'token'), (4, '@mail'), (5, 'the')) v(p, t)) SELECT doc_id, arg_min(t, p) AS matched FROM documents JOIN t ON contains(lower(text), t) GROUP BY doc_id")
def first_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame(TERMS, "position int, term string")
    return joins.first_term(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", terms).select("doc_id", "matched")


LEXICON = "lex AS (SELECT DISTINCT p_brand AS class, string_split(p_name, ' ')[1] AS item FROM part)"


@query("d16_class_overlap", f"WITH {LEXICON}, r AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS item FROM part) SELECT p_partkey, array_to_string(list_sort(list(DISTINCT class)), ',') AS classes FROM r JOIN lex USING (item) GROUP BY p_partkey")
def class_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lex = part.select(F.col("p_brand").alias("class"), F.get(F.split("p_name", " "), 0).alias("item")).distinct()
    return joins.class_members(part, "p_partkey", F.split("p_name", " "), lex).select("p_partkey", F.array_join("classes", ",").alias("classes"))


@query("d17_set_similarity_verdict", "WITH s AS (SELECT string_split(p_name, ' ') AS w FROM part WHERE p_partkey = 0), r AS (SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), (SELECT w FROM s))) AS shared, len(list_distinct(string_split(p_name, ' '))) AS own FROM part) SELECT p_partkey, CASE WHEN shared = own THEN 'closest' WHEN shared >= 2 THEN 'related' WHEN shared = 1 THEN 'weak' ELSE 'distant' END AS verdict FROM r")
def set_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    subject = part.where("p_partkey = 0").select(F.split("p_name", " ").alias("w"))
    rows = part.crossJoin(F.broadcast(subject)).withColumn("shared", F.size(F.array_intersect(F.split("p_name", " "), "w")))  # one subject
    own = F.size(F.array_distinct(F.split("p_name", " ")))
    return rows.select("p_partkey", F.when(F.col("shared") == own, "closest").when(F.col("shared") >= 2, "related").when(F.col("shared") == 1, "weak").otherwise("distant").alias("verdict"))


@query("d20_left_join_verdicts", "SELECT CASE WHEN l.doc_id IS NULL THEN 'undecided' WHEN quality = 1 THEN 'met' ELSE 'missed' END AS verdict, lang, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy(F.when(F.col("quality").isNull(), "undecided").when(F.col("quality") == 1, "met").otherwise("missed").alias("verdict"), "lang").agg(F.count("*").alias("n"))


@query("d29_zip_positions", "WITH z AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part), u AS (SELECT p_partkey, unnest(range(1, len(a) + 1)) AS i, a, b FROM z WHERE len(a) = len(b)) SELECT p_partkey, i::BIGINT AS place, a[i] AS name, b[i] AS kind FROM u")
def zip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b")).where(F.size("a") == F.size("b"))
    return z.select("p_partkey", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("p_partkey", (F.col("i") + 1).cast("long").alias("place"), F.col("z.a").alias("name"), F.col("z.b").alias("kind"))


@query("g09_ring_neighbours", "WITH p AS (SELECT p_brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS m FROM part), o AS (SELECT * FROM (VALUES (1, 1), (2, -1), (3, 2), (4, -2)) v(place, step)) SELECT a.p_brand, a.id, b.id AS neighbour, place FROM p a JOIN o ON place <= a.m - 1 JOIN p b ON a.p_brand = b.p_brand AND b.p = (a.p + step + a.m) % a.m")
def ring_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ring_neighbours(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 4)


NAMES = """names AS (SELECT DISTINCT lower(p_name) AS name, p_brand AS target FROM part UNION SELECT DISTINCT lower(string_split(p_name, ' ')[1]), p_brand FROM part)"""


@query(
    "l12_ordered_lookup",
    f"""WITH {NAMES}, c AS (SELECT p_partkey, unnest([replace(lower(p_name), ' ', ''), lower(p_name), lower(string_split(p_name, ' ')[1])]) AS cand, unnest([1, 2, 3]) AS pos FROM part),
        u AS (SELECT name, count(DISTINCT target) AS n, min(target) AS t FROM names GROUP BY name),
        b AS (SELECT p_partkey, arg_min({{'t': t, 'n': n, 'c': cand}}, pos) AS m FROM c JOIN u ON cand = name GROUP BY p_partkey)
        SELECT part.p_partkey, CASE WHEN m IS NULL THEN 'none' WHEN m.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN m.n = 1 THEN m.t END AS target FROM part LEFT JOIN b ON part.p_partkey = b.p_partkey""",
)
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = F.lower(F.get(F.split("p_name", " "), 0))
    names = part.select(F.lower("p_name").alias("name"), F.col("p_brand").alias("target")).union(part.select(first, "p_brand")).distinct()
    cands = F.array(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")), F.lower("p_name"), first)
    return joins.ordered_lookup(part, "p_partkey", cands, names).drop("matched_name")


@query("l09_first_writer_wins", f"WITH t AS (SELECT p_brand AS term, min(p_partkey) AS k, 1 AS pr FROM part GROUP BY ALL UNION ALL SELECT p_type, min(p_partkey), 2 FROM part GROUP BY ALL UNION ALL SELECT lower(p_brand), max(p_partkey), 3 FROM part GROUP BY ALL) SELECT lower(term) AS term, arg_min(k, pr) AS k FROM t GROUP BY lower(term)")
def first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    t = part.groupBy(F.col("p_brand").alias("term")).agg(F.min("p_partkey").alias("k")).withColumn("pr", F.lit(1))
    t = t.union(part.groupBy("p_type").agg(F.min("p_partkey")).withColumn("pr", F.lit(2))).union(part.groupBy(F.lower("p_brand")).agg(F.max("p_partkey")).withColumn("pr", F.lit(3)))
    return t.groupBy(F.lower("term").alias("term")).agg(F.min_by("k", "pr").alias("k"))


@query("a09_synonym_index", "WITH s AS (SELECT regexp_replace(lower(unnest([p_name, p_type])), '[^a-z0-9]', '', 'g') AS name, p_brand FROM part) SELECT name, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS parents FROM s GROUP BY name")
def synonym_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", "p_type")).alias("name"), "p_brand").withColumn("name", text.key_of(F.col("name")))
    return s.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("parents"))
