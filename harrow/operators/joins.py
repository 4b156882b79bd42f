"""Joins with a twist: intervals within a key, prefixes, terms in texts, set overlap, ordered
lookups, neighbours in a ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import spread, written
from .ordered import joined, running_sums, with_ranges

#: Rows up to which a curated table may be broadcast into a join without an equality key.
CURATED_ROWS = 50_000


def curated(table: DataFrame, max_rows: int = CURATED_ROWS) -> DataFrame:
    """The table with a broadcast hint, after its size is checked."""
    if table.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"a curated table has more than {max_rows} rows; give it an equality key")
    return F.broadcast(table)


def within_interval(df: DataFrame, key: str, at: str, identifier: str, seconds: int) -> DataFrame:
    """Pairs (id, other) of a key at most `seconds` apart. Times are cut into cells of that width;
    a row meets its own cell and the next, so a key with many rows is spread over its cells and
    only rows that can match meet."""
    t = F.unix_timestamp(at)
    rows = df.select(F.col(key).alias("k"), F.col(identifier).alias("i"), t.alias("t"), F.floor(t / seconds).alias("cell"))
    left = rows.withColumn("cell", F.explode(F.array("cell", F.col("cell") + 1))).withColumnsRenamed({"i": "a", "t": "ta"})
    # a pair meets in the later row's cell only: the earlier row looks at its own and the next
    right = rows.withColumnsRenamed({"i": "b", "t": "tb"})
    pairs = left.join(right, ["k", "cell"]).where((F.col("ta") <= F.col("tb")) & (F.col("tb") - F.col("ta") <= seconds) & ((F.col("ta") < F.col("tb")) | (F.col("a") < F.col("b"))))
    return pairs.select(F.col("k").alias(key), "a", "b")


def longest_prefix(df: DataFrame, name: str, aliases: DataFrame, alias: str = "alias", target: str = "target", how: str = "name") -> DataFrame:
    """Each distinct name with the target of its exact alias, else of the longest alias that is a
    prefix at a word boundary, else itself. A name is cut into its word prefixes, and these are
    joined by equality."""
    names = df.select(F.col(name).alias("n")).where(F.col(name).isNotNull()).distinct()
    words = F.split("n", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    cut = names.select("n", F.explode(prefixes).alias("p"))
    hit = cut.join(aliases.select(F.col(alias).alias("p"), F.col(target).alias("t")), "p").groupBy("n").agg(F.max_by("t", F.length("p")).alias("t"), F.max(F.length("p")).alias("len"))
    out = names.join(hit, "n", "left")
    method = F.when(F.col("t").isNull(), "self").when(F.col("len") == F.length("n"), "exact").otherwise("prefix")
    return out.select(F.col("n").alias(name), F.coalesce("t", "n").alias(target), method.alias("method"))


def first_term(texts: DataFrame, text: str, terms: DataFrame, term: str = "term", position: str = "position") -> DataFrame:
    """Texts with the first (by position) of a curated list of terms that they contain."""
    packed = curated(terms).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.lower(term).alias("t")))).alias("terms"))
    hit = F.filter("terms", lambda x: F.lower(F.col(text)).contains(x["t"]))
    return texts.crossJoin(F.broadcast(packed)).withColumn("matched", F.get(hit, 0)["t"]).drop("terms").where(F.col("matched").isNotNull())  # one row of terms


def class_members(df: DataFrame, identifier: str, items: Column, lexicon: DataFrame, item: str = "item", klass: str = "class") -> DataFrame:
    """identifier, classes (sorted): classes of a lexicon (class, item) that share an item. df is dealt out by its id first."""
    df = spread(df.select(identifier, items.alias("_items")), identifier)
    rows = df.select(identifier, F.explode(F.array_distinct("_items")).alias(item))
    return rows.join(lexicon.select(item, F.col(klass).alias("c")), item).groupBy(identifier).agg(F.sort_array(F.collect_set("c")).alias("classes"))


def ordered_lookup(df: DataFrame, identifier: str, candidates: Column, names: DataFrame, name: str = "name", target: str = "target") -> DataFrame:
    """The first candidate (by place) that names exactly one target; status matched, ambiguous (a
    candidate names several, none before it names one) or none. df is dealt out by its id first, so that a task holds as
    much at any size, though few files hold the table."""
    df = spread(df.select(identifier, candidates.alias("_cands")), identifier)
    unique = names.groupBy(F.col(name).alias("cand")).agg(F.count_distinct(target).alias("n"), F.min(target).alias("t"))
    rows = df.select(identifier, F.posexplode("_cands").alias("pos", "cand")).join(unique, "cand")
    best = rows.groupBy(identifier).agg(F.min_by(F.struct("t", "n", "cand"), F.struct("pos")).alias("m"))
    out = df.select(identifier).join(best, identifier, "left")
    status = F.when(F.col("m").isNull(), "none").when(F.col("m.n") > 1, "ambiguous").otherwise("matched")
    return out.select(identifier, status.alias("status"), F.when(status == "matched", F.col("m.t")).alias("target"), F.col("m.cand").alias("matched_name"))


def ring_neighbours(df: DataFrame, group: str, order: str, count: int) -> DataFrame:
    """Up to `count` neighbours of each row in its group sorted by a number, alternating right and left, around the end: id,
    neighbour, place. Places in a group are running counts over ranges of the number, so a group of any size is dealt to
    many tasks; the numbers of a group are distinct."""
    rows = with_ranges(written(df.select(F.col(group).alias("g"), F.col(order).alias("id"))), "id")
    size = rows.groupBy("g").agg(F.count("*").alias("m"))
    pos = running_sums(rows, ["g"], "id", {"p": F.lit(1)}).select("g", "id", (F.col("p") - 1).alias("p"))
    pos = written(joined(pos, size, ["g"]))
    steps = [(i // 2 + 1) * (1 if i % 2 == 0 else -1) for i in range(count)]
    offsets = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(s).alias("step")) for i, s in enumerate(steps)]))
    want = pos.select("g", "id", "p", "m", offsets.alias("o")).where(F.col("o.place") <= F.col("m") - 1).withColumn("q", F.pmod(F.col("p") + F.col("o.step"), F.col("m")))
    got = want.join(pos.select("g", F.col("p").alias("q"), F.col("id").alias("neighbour")), ["g", "q"])
    return got.select(F.col("g").alias(group), "id", "neighbour", F.col("o.place").alias("place"))
