"""Reports over a cohort: signal rates by membership, profiles, hubs, coverage and drug-style pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import spread, written

#: Item sets that one task compares with classes.
SET_ROWS = 10_000


def membership_counts(df: DataFrame, members: Column, hits: dict[str, Column], order: Sequence[str] = (), missing: str = "UNKNOWN") -> DataFrame:
    """member, total and one column per hit; a row counts once for each of its members, and as
    `missing` if it has none. With `order`, every listed member has a row, in that place."""
    one = F.when(F.size(F.coalesce(members, F.array().cast("array<string>"))) > 0, F.array_distinct(members)).otherwise(F.array(F.lit(missing)))
    rows = df.select(F.explode(one).alias("member"), *[c.alias(n) for n, c in hits.items()])
    out = rows.groupBy("member").agg(F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in hits])
    if not order:
        return out
    listed = df.sparkSession.createDataFrame([(m, i) for i, m in enumerate(order)], "member string, place int")
    zero = F.lit(0).cast("long")
    return F.broadcast(listed).join(out, "member", "left").select("member", "place", *[F.coalesce(c, zero).alias(c) for c in ("total", *hits)])


def profile(df: DataFrame, unit: str, hits: dict[str, Column]) -> DataFrame:
    """One row per unit: total, hits, and the share of the first hit."""
    out = df.groupBy(unit).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in hits.items()])
    first = next(iter(hits))
    return out.withColumn("share", F.try_divide(F.col(first), F.col("total")))


def hubs(df: DataFrame, kinds: dict[str, tuple[Column, int]]) -> DataFrame:
    """kind, label, slug, n for each kind (its label column and least count); of labels that share a slug
    within a kind the most frequent one stays, ties alphabetical."""
    from ..functions.text import slug

    laid = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("label"), F.lit(m).alias("least")) for k, (c, m) in kinds.items()]))
    counts = df.select(laid.alias("h")).select("h.*").where("label is not null").groupBy("kind", "label", "least").agg(F.count("*").alias("n")).where("n >= least")
    counts = counts.withColumn("slug", slug(F.col("label")))
    best = counts.groupBy("kind", "slug").agg(F.min(F.struct((-F.col("n")).alias("minus_n"), "label")).alias("b"))
    return best.select("kind", F.col("b.label").alias("label"), "slug", (-F.col("b.minus_n")).alias("n"))


def share_ranking(df: DataFrame, unit: str, hit: Column, least: int) -> DataFrame:
    """Units with enough rows and at least one hit, by exact share, then hits, then name."""
    out = df.groupBy(unit).agg(F.count("*").alias("total"), F.count_if(hit).alias("hits")).where((F.col("total") >= least) & (F.col("hits") > 0))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("hits") / F.col("total")), F.desc("hits"), unit)).cast("long"))  # one row per unit


def one_per_asset(df: DataFrame, key: str, assets: Column, attributes: Sequence[str]) -> DataFrame:
    """asset, n, ids and sorted attribute sets: a row counts for each of its assets; a row without one
    is an asset of its own."""
    asset = F.explode(F.when(F.size(F.coalesce(assets, F.array().cast("array<string>"))) > 0, F.array_distinct(assets)).otherwise(F.array(F.concat(F.lit("unresolved:"), F.col(key).cast("string")))))
    rows = df.select(asset.alias("asset"), key, *attributes)
    return rows.groupBy("asset").agg(F.count_distinct(key).alias("n"), *[F.sort_array(F.collect_set(a)).alias(a) for a in attributes])


def shared_value(values: Column) -> Column:
    """The single value of a set, else null."""
    return F.when(F.size(values) == 1, F.get(values, 0))


def disclosure_gap(df: DataFrame, keys: Sequence[str], completed: Column, has_results: Column, today: Column, months: int = 13) -> DataFrame:
    """Per key: rows completed more than `months` calendar months before `today`, and those of them
    without results."""
    age = (F.year(today) - F.year(completed)) * 12 + F.month(today) - F.month(completed)
    due = F.coalesce(age > months, F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(due).alias("due"), F.count_if(due & ~has_results).alias("silent"))


def coverage(df: DataFrame, classes: DataFrame, key: str, items: Column, order_hit: Column) -> DataFrame:
    """classes (class, item) x rows: per class the rows that share an item, and their hits. A row counts once per class.

    Rows with the same items are counted first, and only the distinct item sets meet the classes, in an equi-join on items;
    both are dealt out by number, so a task holds as much at any size. A key on several rows has the items of all of
    them, and hits by the items of those that do."""
    rows = spread(df.select(key, F.array_distinct(items).alias("items"), order_hit.alias("hit")), key)
    rows = rows.select(key, F.explode("items").alias("item"), "hit").where(F.col("item").isNotNull())
    per = rows.groupBy(key).agg(F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("item")))).alias("hits"))
    sets = written(per.groupBy("items", "hits").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()))
    told = F.transform("items", lambda i: F.struct(i.alias("item"), F.array_contains("hits", i).alias("hit")))
    met = spread(sets, "id", SET_ROWS).select("id", "m", F.explode(told).alias("i")).select("id", "m", "i.*").join(classes, "item")
    met = met.groupBy("id", "m", "class").agg(F.bool_or("hit").alias("hit"))
    return met.groupBy("class").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("hit"), F.col("m")).otherwise(0)).alias("hits"))


def agreement_groups(df: DataFrame, group: Column, label: str) -> DataFrame:
    """group, rows, labels (histogram as "label=n" sorted) and whether all rows agree. Counts per label
    are combined before they meet."""
    per = df.groupBy(group.alias("g"), F.coalesce(label, F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    entry = F.concat_ws("=", "label", F.col("n").cast("string"))
    return per.groupBy("g").agg(F.sum("n").alias("n_rows"), F.array_join(F.sort_array(F.collect_list(entry)), ";").alias("histogram"), (F.count("*") == 1).alias("agrees"))


def any_all(df: DataFrame, key: str, hit: Column) -> DataFrame:
    """Over keys: how many have any hit, and how many have only hits."""
    per = df.groupBy(key).agg(F.bool_or(hit).alias("a"), F.bool_and(hit).alias("b"))
    return per.agg(F.count("*").alias("keys"), F.count_if("a").alias("any_hit"), F.count_if("b").alias("all_hit"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an order (a limit that is the feature); the order must break every tie."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def suggestions(df: DataFrame, name: str, typed: str, limit: int) -> DataFrame:
    """Names that begin with what was typed, then names that contain it, alphabetical within."""
    low = F.lower(name)
    found = df.where(F.contains(low, F.lit(typed.lower()))).select(name).distinct()
    return found.orderBy((~F.startswith(F.lower(name), F.lit(typed.lower()))).cast("int"), name).limit(limit)


def distinct_sets(df: DataFrame, key: str, members: Column, order: Sequence[Column]) -> DataFrame:
    """Of rows with the same member set the first by order."""
    rows = df.withColumn("_set", F.array_join(F.sort_array(F.array_distinct(members)).cast("array<string>"), "\u0001"))
    first = F.row_number().over(Window.partitionBy("_set").orderBy(*order))
    return rows.withColumn("_r", first).where("_r = 1").select(key)


def fresh_batch(pool: DataFrame, taken: DataFrame, text: str, identifier: str, stratum: str, quota: int, seed: str = "s1") -> DataFrame:
    """Distinct texts that no earlier batch has, and of these a quota per stratum in key order."""
    from .sampling import stratified

    one = pool.groupBy(text).agg(F.min(F.struct(identifier, stratum)).alias("r")).select(text, "r.*")
    return stratified(one.join(taken.select(text).distinct(), text, "left_anti"), stratum, identifier, quota, seed)
