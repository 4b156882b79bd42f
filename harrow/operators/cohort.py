"""Cohorts: filters, facets, funnels, segment rates, shares, cubes and portfolios.

All take a DataFrame and column names and return a DataFrame; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson, rate, wilson


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def overlaps(values: Column, wanted: Sequence) -> Column:
    """Whether an array column shares a value with the list."""
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def select_cohort(
    df: DataFrame,
    *,
    equals: dict[str, object] | None = None,
    any_of: dict[str, Sequence] | None = None,
    has_any: dict[str, Sequence] | None = None,
    has_none: dict[str, Sequence] | None = None,
    years: tuple[str, int | None, int | None] | None = None,
) -> DataFrame:
    """Rows that meet every given predicate: equality, membership, overlap of an array column, no
    overlap, and an inclusive range of years of a date column. Predicates that are not given
    do not appear in the plan."""
    p = [F.col(c) == v for c, v in (equals or {}).items()]
    p += [F.col(c).isin(list(v)) for c, v in (any_of or {}).items()]
    p += [overlaps(F.col(c), v) for c, v in (has_any or {}).items()]
    p += [~F.coalesce(overlaps(F.col(c), v), F.lit(False)) for c, v in (has_none or {}).items()]
    if years:
        c, low, high = years
        p += [F.year(c) >= low] if low is not None else []
        p += [F.year(c) <= high] if high is not None else []
    return df.where(all_of(p))


def faceted(df: DataFrame, text: str | None = None, text_columns: Sequence[str] = (), facets: dict[str, Sequence] | None = None, date: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """AND across facets, OR within; a substring over several columns; a date range by text
    comparison that keeps rows without a date."""
    p = []
    if text:
        p.append(reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in text_columns]))
    p += [F.col(c).isin(list(v)) for c, v in (facets or {}).items() if v]
    if date:
        c, low, high = date
        d = F.coalesce(F.col(c), F.lit(""))
        p += [(d == "") | (d >= low)] if low else []
        p += [(d == "") | (d <= high)] if high else []
    return df.where(all_of(p))


def facet_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n for several columns from one pass: each row is laid out once per facet and
    combined before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, position, n: rows that meet this predicate and all before it, from one pass."""
    sums, so_far = [], F.lit(True)
    for name, predicate in steps:
        so_far = so_far & F.coalesce(predicate, F.lit(False))
        sums.append(F.count_if(so_far).alias(name))
    one = df.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("step"), F.col(n).alias("n")) for i, (n, _) in enumerate(steps)]))
    return one.select(rows.alias("r")).select("r.*")


def segment_rates(df: DataFrame, keys: Sequence[str], closed: Column, event: Column, min_closed: int = 0) -> DataFrame:
    """Per segment: n, closed, events among the closed, rate and its Wilson interval."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(closed).alias("closed"), F.count_if(closed & event).alias("events")).where(F.col("closed") >= min_closed)
    low, high = wilson(F.col("events"), F.col("closed"))
    return g.withColumns({"rate": rate(F.col("events"), F.col("closed")), "low": low, "high": high})


def concentration(df: DataFrame, keys: Sequence[str], programme: Sequence[str], closed: Column, event: Column) -> DataFrame:
    """Per segment: programmes with events, the largest programme's events, and the rate without
    the largest programme (by events, then closed, then programme)."""
    per = df.groupBy(*keys, *programme).agg(F.count_if(closed).alias("c"), F.count_if(closed & event).alias("e"))
    name = F.concat_ws("|", *programme)
    out = per.groupBy(*keys).agg(
        F.count_if(F.col("e") > 0).alias("programmes"),
        F.sum("e").alias("events"),
        F.sum("c").alias("closed"),
        F.min(F.struct((-F.col("e")).alias("e"), (-F.col("c")).alias("c"), name.alias("name"))).alias("top"),
    )
    rest_e, rest_c = F.col("events") + F.col("top.e"), F.col("closed") + F.col("top.c")
    return out.select(*keys, "programmes", "events", "closed", F.col("top.name").alias("largest"), (-F.col("top.e")).alias("largest_events"), rate(rest_e, rest_c).alias("rate_without"))


def share_table(df: DataFrame, key: Column | str, hit: Column, min_total: int = 1) -> DataFrame:
    """key, total, hits, share for keys with enough rows."""
    g = df.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"))
    return g.where(F.col("total") >= min_total).withColumn("share", rate(F.col("hits"), F.col("total")))


def top_counts(df: DataFrame, key: str, limit: int, within: Sequence[str] = ()) -> DataFrame:
    """The most frequent values (ties alphabetical), overall or within groups; null keys are out."""
    counts = df.where(F.col(key).isNotNull()).groupBy(*within, key).agg(F.count("*").alias("n"))
    if not within:
        return counts.orderBy(F.desc("n"), F.asc(key)).limit(limit)
    w = Window.partitionBy(*within).orderBy(F.desc("n"), F.asc(key))
    return counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def top_with_ties(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys whose count ranks among the first `limit`, with all that tie with the last. The rank is
    found from the histogram of counts, which is short, not by ordering all keys in one task."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("n").agg(F.count("*").alias("keys"))
    ahead = F.coalesce(F.sum("keys").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("ahead", ahead).where(F.col("ahead") < limit).select("n")
    return counts.join(kept, "n").select(key, "n")


def cube_counts(df: DataFrame, scope: Column, group: str, multi: Column, bucket: str, buckets: Sequence[str]) -> DataFrame:
    """scope x multi-valued key (with "all") x group: n and one column per bucket. A row counts in
    each of its keys and in "all"."""
    keys = F.array_distinct(F.concat(F.array(F.lit("all")), multi))
    rows = df.select(scope.alias("scope"), F.col(group).alias("grp"), F.explode(keys).alias("key"), F.col(bucket).alias("bucket"))
    return rows.groupBy("scope", "key", "grp").agg(F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in buckets])


def dense_matrix(df: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """row, one column per given value with its count, zero where none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(f"n_{c}") for c in columns])


def observed_expected(df: DataFrame, unit: str, strata: Sequence[str], hit: Column, min_total: int) -> DataFrame:
    """Per unit: total, observed hits, hits expected from its strata's rates, and the ratio. Strata
    rates are joined to counts per unit and stratum, never to rows."""
    cells = df.groupBy(unit, *strata).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    rates = cells.groupBy(*strata).agg((F.sum("k") / F.sum("n")).alias("p"))
    out = cells.join(rates, list(strata)).groupBy(unit).agg(F.sum("n").alias("total"), F.sum("k").alias("observed"), F.sum(F.col("n") * F.col("p")).alias("expected"))
    return out.where(F.col("total") >= min_total).withColumn("ratio", F.try_divide("observed", "expected"))


def size_share_correlation(df: DataFrame, unit: str, hit: Column) -> DataFrame:
    """One row: Pearson correlation of a unit's size with its share of hits."""
    u = df.groupBy(unit).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    return u.agg(F.count("*").alias("units"), pearson(F.col("n").cast("double"), F.col("k") / F.col("n")).alias("correlation"))


def best_example(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order. Taken as an aggregate (min of a struct), so a
    large group is combined before the shuffle. order: columns whose least is wanted first."""
    rest = [c for c in df.columns if c != group]
    pick = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(group).agg(pick.alias("p")).select(group, "p.*")


def trailing_days(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the last `days` calendar days up to the latest date in the data."""
    last = df.agg(F.max(F.to_date(date)).alias("last"))
    return df.join(F.broadcast(last), (F.to_date(date) > F.date_sub("last", days)) & (F.to_date(date) <= F.col("last")))  # one row


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the least."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))
