"""Published reports over segment tables and record frames: publication rules, overlap suppression, strict joins,
proposals, related records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.scratch import written
from .survival import false_discovery


def published(segments: DataFrame, unit: str, n: str, k: str, units: str, least: int, stops: int, small: tuple[int, int]) -> DataFrame:
    """segments (unit, n, k, units) -> rate, interval, p, q_by over the whole family, and publish: enough
    closed records and stops; or few, but of several programmes and an interval above the baseline."""
    base = segments.agg((F.sum(k) / F.sum(n)).alias("baseline"))
    rows = segments.join(F.broadcast(base), F.lit(True))  # one row
    low, high = stats.wilson(F.col(k), F.col(n))
    rows = rows.withColumns({"rate": stats.rate(F.col(k), F.col(n)), "low": low, "high": high, "p": stats.binomial_tail(k, n, "baseline")})
    rows = false_discovery(rows, "p")
    enough = (F.col(n) >= least) & (F.col(k) >= stops)
    certain = (F.col(k) >= small[0]) & (F.col(units) >= small[1]) & (F.col("low") > F.col("baseline"))
    return rows.withColumn("publish", F.coalesce(enough | certain, F.lit(False)))


def featured(segments: DataFrame, unit: str, n: str, k: str, least: int, stops: int) -> DataFrame:
    """The segment of highest rate whose interval clears the baseline: one row or none."""
    rows = published(segments.withColumn("_u", F.lit(1)), unit, n, k, "_u", least, stops, (1 << 30, 1)).where(F.col("publish") & (F.col("low") > F.col("baseline")))
    return rows.orderBy(F.desc("rate"), unit).limit(1)


def suppress_overlaps(members: DataFrame, term: str, item: str, share: float = 0.85) -> DataFrame:
    """members (term, item) -> the terms kept: largest first (then shortest, then by name), a term falls if a kept one before
    it holds `share` of its items.

    A term of n items of which c = ceil(share n) must be held shares one of any n - c + 1 of them with what covers it, so only its
    rarest ones look for candidates: an item that very many terms have pairs few of them. Candidates are verified on whole
    sets. What is kept is settled in rounds over narrow written tables until no term is undecided; in each
    round at least the first of them is."""
    own = written(members.select(F.col(term).alias("t"), F.col(item).alias("i")).where("t IS NOT NULL AND i IS NOT NULL").distinct())
    sizes = written(own.groupBy("t").agg(F.count("*").alias("n")))
    rarity = own.groupBy("i").agg(F.count("*").alias("df"))
    ranked = own.join(rarity, "i").withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy("df", "i"))).join(sizes, "t")
    probes = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1).select("t", "n", "i")
    held = own.join(sizes, "t").select(F.col("t").alias("of"), "i", F.col("n").alias("m"))
    before = F.struct(-F.col("m"), F.length("of"), "of") < F.struct(-F.col("n"), F.length("t"), "t")
    candidates = written(probes.join(held, "i").where(before).select("t", "of", "n").distinct())
    shared = candidates.join(own, "t").join(own.select(F.col("t").alias("of"), "i"), ["of", "i"]).groupBy("t", "of", "n").agg(F.count("*").alias("both"))
    pairs = written(shared.where(F.col("both") >= F.col("n") * share - 1e-9).select("t", "of"))
    kept: list[DataFrame] = []
    left = sizes.select("t")
    while not left.isEmpty():
        # terms without an undecided term before them stand; what they cover falls
        blocked = pairs.join(left.withColumnRenamed("t", "of"), "of", "left_semi").join(left, "t", "left_semi").select("t").distinct()
        stand = written(left.join(blocked, "t", "left_anti"))
        kept.append(stand)
        fallen = pairs.join(stand.withColumnRenamed("t", "of"), "of", "left_semi").select("t").distinct()
        left = written(left.join(stand, "t", "left_anti").join(fallen, "t", "left_anti"))
    return reduce(DataFrame.union, kept).withColumnRenamed("t", term) if kept else sizes.select(F.col("t").alias(term))


def strict_join(left: DataFrame, right: DataFrame, key: str, both: bool = False) -> DataFrame:
    """An inner join that fails, when it runs, on a left key without a match (with `both`, also on a right
    key without one)."""
    marked = left.join(right.withColumn("_there", F.lit(True)), key, "full" if both else "left")
    lost = F.col("_there").isNull()
    if both:
        marked = left.withColumn("_here", F.lit(True)).join(right.withColumn("_there", F.lit(True)), key, "full")
        lost = F.col("_there").isNull() | F.col("_here").isNull()
    bad = F.when(lost, F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string"))))
    checked = marked.withColumn("_bad", bad.cast("string")).where(F.col("_bad").isNull())
    return checked.drop("_there", "_here", "_bad")


def apply_proposals(rows: DataFrame, proposals: DataFrame, key: str, column: str) -> DataFrame:
    """Proposals (key, value, retired) put into a column; retired ones change nothing, unknown keys are an error."""
    known = strict_join(proposals.where(~F.col("retired")).select(key, F.col("value").alias("_value")), rows.select(key).distinct(), key)
    return rows.join(known, key, "left").withColumn(column, F.coalesce("_value", column)).drop("_value")


def related(rows: DataFrame, key: str, group: str, order: Sequence[Column], n: int = 6) -> DataFrame:
    """key, neighbours: up to n other keys of its group that stand next in the order, before and behind.
    A row sees n rows each way, so a group of any size is one sorted pass."""
    w = Window.partitionBy(group).orderBy(*order)
    near = [F.lag(key, i).over(w) for i in range(1, n + 1)], [F.lead(key, i).over(w) for i in range(1, n + 1)]
    mixed = [c for pair in zip(near[1], near[0], strict=True) for c in pair]
    return rows.select(key, F.slice(F.array_compact(F.array(*mixed)), 1, n).alias("neighbours"))


def display_name(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """key -> its most frequent spelling; ties by name."""
    votes = rows.groupBy(key, raw).agg(F.count("*").alias("n"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(raw).alias("name"))).alias("v")).select(key, F.col("v.name").alias("name"))


def flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, n: how many rows are left after each predicate in turn, from one aggregate."""
    upto, counts = F.lit(True), []
    for i, (_, p) in enumerate(steps):
        upto = upto & F.coalesce(p, F.lit(False))
        counts.append(F.count_if(upto).alias(f"_{i}"))
    laid = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("step"), F.col(f"_{i}").alias("n")) for i, (name, _) in enumerate(steps)])
    return df.agg(*counts).select(F.explode(laid).alias("s")).select("s.*")


def top_counts(df: DataFrame, label: Column, hits: dict[str, Column], n: int, least: int = 1) -> DataFrame:
    """The n most frequent labels with at least `least` rows (a report's limit), ties by label."""
    out = df.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in hits.items()])
    return out.where(F.col("total") >= least).orderBy(F.desc("total"), "label").limit(n)
