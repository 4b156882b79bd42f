"""Snapshots: difference of two releases, first or last row wins, set comparison, and the keyed
fold of a change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, key: str, position: str, last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by position. An aggregate, not a window."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(pick(F.struct(*rest), F.col(position)).alias("r")).select(key, "r.*")


def changed_fields(fields: Sequence[str], before: str = "a", after: str = "b", unordered: Sequence[str] = ()) -> Column:
    """Names of the fields that differ, null-safe; fields in `unordered` are compared as sorted lists."""
    ordered = lambda side, f: F.sort_array(F.col(f"{side}.{f}")) if f in unordered else F.col(f"{side}.{f}")
    return F.array_compact(F.array(*[F.when(~ordered(before, f).eqNullSafe(ordered(after, f)), F.lit(f)) for f in fields]))


def diff(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str], unordered: Sequence[str] = ()) -> DataFrame:
    """key, kind (new, removed, changed), changed_fields, previous values and current values as
    text maps. Rows that differ in other fields only - a restamped version, say - are no change."""
    a = previous.select(F.col(key).alias("k"), *fields).alias("a")
    b = current.select(F.col(key).alias("k"), *fields).alias("b")
    both = a.join(b, F.col("a.k") == F.col("b.k"), "full_outer")
    kind = F.when(F.col("a.k").isNull(), "new").when(F.col("b.k").isNull(), "removed").otherwise("changed")
    both = both.withColumn("kind", kind).withColumn("changed_fields", F.when(F.col("kind") == "changed", changed_fields(fields, unordered=unordered)).otherwise(F.array().cast("array<string>")))
    both = both.where((F.col("kind") != "changed") | (F.size("changed_fields") > 0))
    values = lambda side: F.map_from_arrays(F.col("changed_fields"), F.transform("changed_fields", lambda f: F.element_at(F.create_map(*[x for n in fields for x in (F.lit(n), F.col(f"{side}.{n}").cast("string"))]), f)))
    return both.select(F.coalesce("a.k", "b.k").alias(key), "kind", "changed_fields", values("a").alias("before"), values("b").alias("after"))


def origin(fields: Column, registry: Sequence[str], labels: Sequence[str], mapping: Sequence[str]) -> Column:
    """What caused a change: registry_event, reclassification, remapping, mixed; null for none."""
    hit = lambda names: F.arrays_overlap(fields, F.array(*map(F.lit, names)))
    kinds = F.array_compact(F.array(F.when(hit(registry), "registry_event"), F.when(hit(labels), "reclassification"), F.when(hit(mapping), "remapping")))
    return F.when(F.size(kinds) > 1, "mixed").otherwise(F.get(kinds, 0))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows only in a, and only in b, with multiplicity."""
    left = a.exceptAll(b).agg(F.count("*").alias("n")).withColumn("side", F.lit("only_a"))
    return left.unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).withColumn("side", F.lit("only_b")))


def fold_changes(log: DataFrame, key: str, release: str, kind: str, before: str, after: str, since: str | None = None) -> DataFrame:
    """The net effect of a change log per key: first "before", last "after".

    An addition makes later changes part of itself; an edit that is undone vanishes; an addition
    that is removed vanishes; removing and adding again is a change. Order of arrival does not
    matter: the fold is by release. Releases up to `since` have been folded before and are out."""
    rows = log if since is None else log.where(F.col(release) > since)
    g = rows.groupBy(key).agg(
        F.min_by(kind, release).alias("first_kind"), F.max_by(kind, release).alias("last_kind"),
        F.min_by(before, release).alias("before"), F.max_by(after, release).alias("after"),
        F.max(release).alias("release"),
    )
    born, gone = F.col("first_kind") == "added", F.col("last_kind") == "removed"
    net = F.when(born & gone, None).when(born, "added").when(gone, "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return g.withColumn("kind", net).where(F.col("kind").isNotNull()).select(key, "kind", "before", "after", "release")


def partial_fold(log: DataFrame, key: str, release: str, kind: str, before: str, after: str, at: str | None = None) -> DataFrame:
    """key, first (release, at, kind, value), last (the same): what a fold needs of some releases. Partial folds of disjoint
    releases merge in any order. `at` orders entries of a key within a release; ties go by kind and value."""
    entry = lambda value: F.struct(F.col(release).alias("release"), (F.col(at) if at else F.lit(None).cast("int")).alias("at"), F.col(kind).alias("kind"), F.col(value).alias("value"))
    return log.groupBy(F.col(key).alias("key")).agg(F.min(entry(before)).alias("first"), F.max(entry(after)).alias("last"))


def merged_folds(parts: DataFrame) -> DataFrame:
    """Partial folds of any releases -> one per key."""
    return parts.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def settled_fold(state: DataFrame) -> DataFrame:
    """key, kind, before, after, release: the net effect. What is added and removed, or changed and changed back, is gone."""
    born, gone = F.col("first.kind") == "added", F.col("last.kind") == "removed"
    net = F.when(born & gone, None).when(born, "added").when(gone, "removed").when(~F.col("first.value").eqNullSafe(F.col("last.value")), "changed")
    out = state.withColumn("kind", net).where(F.col("kind").isNotNull())
    return out.select("key", "kind", F.col("first.value").alias("before"), F.col("last.value").alias("after"), F.col("last.release").alias("release"))


def unfolded(log: DataFrame, release: str, ledger: DataFrame, since: Column | None = None) -> DataFrame:
    """Rows of releases that were not folded before: not in the ledger, and after the mark up to which all has been
    told. A release arrives as a whole; one that comes again, or too late, is dropped as a whole. A null release is dropped."""
    rows = log.where(F.col(release).isNotNull() if since is None else F.col(release) > since)
    return rows.join(ledger.select(F.col("release").alias("_folded")), F.col(release) == F.col("_folded"), "left_anti")


def drops(previous: DataFrame, current: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """metric, before, after for one-row metric tables: metrics that fell by more than their limit,
    ("points", x) absolute or ("share", x) relative."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("double").alias("before"), F.col(f"b.{m}").cast("double").alias("after"), F.lit(k).alias("how"), F.lit(x).alias("limit")) for m, (k, x) in limits.items()]))
    out = previous.alias("a").crossJoin(current.alias("b")).select(rows.alias("r")).select("r.*")  # one row each
    fall = F.col("before") - F.col("after")
    return out.where(F.when(F.col("how") == "points", fall).otherwise(F.try_divide(fall, F.col("before"))) > F.col("limit")).select("metric", "before", "after")
