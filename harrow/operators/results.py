"""Reading posted results: three-valued verdicts, where null means that the record does not settle it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MET, MISSED, MIXED, UNREADABLE = "MET", "MISSED", "MIXED", "UNREADABLE"


def significant(value: Column, op: Column, alpha: Column) -> Column:
    """Whether a p-value with its operator lies at or below alpha: "< x" settles it only where x is
    not above alpha, "> x" only where x is not below it."""
    return F.when((op == "=") & value.isNotNull(), value <= alpha).when((op == "<") & (value <= alpha), True).when((op == ">") & (value >= alpha), False)


def interval_excludes(low: Column, high: Column, null_value: Column) -> Column:
    """Whether a two-sided interval excludes the null value; null if a bound is missing or they cross."""
    return F.when(low <= high, (low > null_value) | (high < null_value))


def stated_threshold(comment: Column) -> Column:
    """The smallest threshold that a comment states ("alpha = 0.025", "5% level"), else null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(comment, F.lit(""))), F.lit(r"(?:alpha|significance|level|threshold)[^0-9]{0,20}([0-9]*\.?[0-9]+%?)"), F.lit(1))
    # text.fraction in steps: each number is read once
    read = F.transform(found, lambda x: F.struct(F.rtrim(x, F.lit("%")).try_cast("double").alias("n"), F.endswith(x, F.lit("%")).alias("percent")))
    shares = F.transform(read, lambda r: F.when(r["percent"], r["n"] / 100).otherwise(r["n"]))
    return F.array_min(F.filter(shares, lambda v: v.between(0.0005, 0.3)))


def one_sided(comment: Column) -> Column:
    return F.lower(F.coalesce(comment, F.lit(""))).rlike(r"\b(?:one|1)[- ]sided\b")


def judge(value: Column, op: Column, stated: Column, single: Column, usual: Sequence[float] = (0.01, 0.025, 0.05)) -> Column:
    """struct(met, bar, rule). A stated threshold decides; a one-sided test is held to half the usual
    two-sided level; otherwise only what all usual thresholds agree on is read."""
    strict, loose = min(usual), max(usual)
    bar = F.when(stated.isNotNull(), stated).when(single, loose / 2)
    at = lambda a: significant(value, op, F.lit(a))
    agreed = F.when(at(strict) & at(loose), True).when(~at(strict) & ~at(loose), False)
    met = F.when(bar.isNotNull(), significant(value, op, bar)).otherwise(agreed)
    rule = F.when(stated.isNotNull(), "stated").when(single, "one-sided").otherwise("all agree")
    return F.struct(met.alias("met"), bar.alias("bar"), rule.alias("rule"))


def with_judgement(df: DataFrame, value: Column, op: Column, comment: Column, name: str = "j") -> DataFrame:
    """df with judge(...) as a column. What the comment states is a column first: the verdict names it often, and it is read
    once a row."""
    out = df.withColumns({"_stated": stated_threshold(comment), "_single": one_sided(comment), "_v": value, "_op": op})
    return out.withColumn(name, judge(F.col("_v"), F.col("_op"), F.col("_stated"), F.col("_single"))).drop("_stated", "_single", "_v", "_op")


def contradicted(met: Column, excludes: Column) -> Column:
    """A verdict against its own interval; null intervals contradict nothing."""
    return F.coalesce(met != excludes, F.lit(False))


def verdict(met: str = "met") -> Column:
    """An aggregate over considered analyses: all met, all missed, both, or nothing readable."""
    some_met, some_missed = F.coalesce(F.bool_or(met), F.lit(False)), F.coalesce(F.bool_or(~F.col(met)), F.lit(False))
    return F.when(some_met & some_missed, MIXED).when(some_met, MET).when(some_missed, MISSED).otherwise(UNREADABLE)


def read_analyses(studies: DataFrame, key: str, outcomes: str = "outcomes") -> DataFrame:
    """key, verdict, n_considered and counters of what was left out, from a nested array
    outcomes<type, analyses<nonInferiorityType, pValue, pValueComment>>.

    Only primary outcomes count. A non-inferiority analysis voids the whole study; studies without
    any analysis stay, as unreadable. Rows are exploded and folded back with partial sums."""
    a = studies.select(key, F.explode_outer(F.filter(outcomes, lambda o: F.upper(o["type"]) == "PRIMARY")).alias("o"))
    a = a.select(key, F.explode_outer("o.analyses").alias("x")).select(key, F.col("x").isNotNull().alias("there"), "x.*")
    a = text.with_p_value(a, F.coalesce("pValue", F.lit(""))).withColumn("ni", F.coalesce(F.upper("nonInferiorityType").rlike("NON_?INFERIORITY|EQUIVALENCE"), F.lit(False)))
    a = with_judgement(a, F.col("p.value"), F.col("p.op"), F.col("pValueComment"), "j")
    a = a.withColumn("met", F.when(F.col("there") & ~F.col("ni"), F.col("j.met")))
    g = a.groupBy(key).agg(
        F.bool_or("ni").alias("voided"),
        verdict().alias("v"),
        F.count("met").alias("n_considered"),
        F.count_if(F.col("there") & ~F.col("ni") & F.col("p.value").isNull()).alias("n_no_value"),
        F.count_if(F.col("there") & ~F.col("ni") & F.col("p.value").isNotNull() & F.col("met").isNull()).alias("n_undecided"),
        F.count_if("ni").alias("n_non_inferiority"),
    )
    return g.withColumn("verdict", F.when(F.col("voided"), UNREADABLE).otherwise(F.col("v"))).drop("voided", "v")


def first_statement(places: Sequence[Column], pattern: str) -> Column:
    """struct(place, sentence) of the first sentence that matches, over places in their order."""
    hits = [F.get(F.filter(text.sentences(p), lambda s: s.rlike(pattern)), 0) for p in places]
    tagged = F.array(*[F.when(h.isNotNull(), F.struct(F.lit(i).alias("place"), h.alias("sentence"))) for i, h in enumerate(hits)])
    return F.get(F.array_compact(tagged), 0)


def evidence_line(label: Column, value: Column, op: Column) -> Column:
    return F.concat(label, F.lit(": p "), op, F.lit(" "), F.format_number(value, 4))


def implied_z(low: Column, high: Column, null_value: Column, z: float = 1.959964) -> Column:
    """The normal deviate that a two-sided 95 % interval implies; null for one that is crossed or empty."""
    return F.when(low < high, ((low + high) / 2 - null_value) / ((high - low) / 2 / z))


def stated_miss(said: Column, miss: str, other: str) -> Column:
    """The first sentence that states a miss and does not speak of another study; null without one."""
    return F.get(F.filter(text.sentences(said), lambda s: s.rlike(miss) & ~s.rlike(other)), 0)
