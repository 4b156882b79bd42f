"""Quality rules: base limits, then robust multivariate outliers (DataFrame functions only).

Statistic vectors are transformed so that clean text is about normal. For each language and
source the minimum covariance determinant gives location and scatter. Concentration steps take
the share `support` of rows nearest by Mahalanobis distance and estimate mean and covariance of
these, until the determinant settles; they run from each of three deterministic starts (medians
with median deviations; mean and covariance of all rows; those of the half nearest to the
medians), and the start that ends at the least determinant stands. One reweighting step follows:
mean and covariance of all rows within the 0.975 quantile. Rows beyond a chi-square limit are
rejected. Groups with few rows share the estimate of their language, and languages with few rows
that of all such rows.

Statistics are rounded to 1/1000, and equal vectors of a group become one cell with a count; all
steps work on cells. A step is one aggregate into fixed-width bins of the distance, combined
before the shuffle; so no group's rows ever meet in one task, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, checked_broadcast, let, materialize, read

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: Limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of rows that a concentration step keeps, and the most steps that it may take to settle.
SUPPORT, MAX_STEPS = 0.75, 40
#: Change of the logarithm of the determinant below which a start has settled.
SETTLED = 1e-6
#: Rows from which a group gets an estimate of its own.
MIN_GROUP = 100
#: Squared distance above which a row is rejected: the 1 - 1e-6 quantile of chi-square, 4 degrees.
LIMIT = 33.38
#: Consistency factors (normal model, 4 dimensions) of the covariance of the nearest 0.75 and 0.975,
#: and the 0.975 quantile of chi-square, 4 degrees.
CONSISTENCY, REWEIGHTED, NEAR = 1.486, 1.0644, 11.143
#: Standard deviation that each transformed statistic has at least; it keeps columns that are
#: constant in clean text (no symbols, no repeats) from being judged at zero width.
FLOORS = (0.08, 0.10, 0.10, 0.10)
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
#: Groups up to which the table of estimates is broadcast (under 1 kB each).
BROADCAST_GROUPS = 20_000


def repeat_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of `window` words that occur twice or more in the array."""

    def of_hashes(hashes: Column) -> Column:
        # windows sorted by hash: a repeat stands next to its like
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                return F.when((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"])

            return F.sort_array(F.filter(F.transform(p, twin), lambda x: x.isNotNull()))

        def covered(s: Column) -> Column:
            return F.aggregate(
                s,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
                lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).cast("long").alias("n"), x.alias("last")),
                lambda a: a["n"],
            )

        return let(pairs, lambda p: let(starts(p), covered))

    def of_words(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))
        some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), of_hashes(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) >= window, some).otherwise(F.lit(0).cast("long"))

    return of_words(words)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (null text: zeros).
    Columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = docs.withColumn("n_repeat_words", let(F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))))
    return out.withColumns(
        {
            "n_words": F.col("n_repeat_words.n"),
            "word_chars": F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": F.col("n_repeat_words.r"),
        }
    )


def _features() -> dict[str, Column]:
    """About normal and comparable between short and long texts: rates with a prior of 20 words."""
    n = F.col("n_words") + 20.0
    values = {
        "f_length": F.log((F.col("word_chars") + 20 * 5.5) / n),
        "f_symbols": F.sqrt(F.col("n_symbols") / n),
        "f_lines": F.sqrt(F.col("n_dup_lines") * 10.0 / n),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    return {k: F.round(v, 3) for k, v in values.items()}


_BIN = 0.01


def _share_bins(bins: DataFrame, by: list[str], share: float) -> DataFrame:
    """bins (by, bin, n, ...) -> those up to the one in which each group reaches the share of its rows."""
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy(*by))
    return bins.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("total", total).where(F.col("before") < F.ceil(F.col("total") * F.lit(share)))


def _medians(values: DataFrame) -> DataFrame:
    """values (g, i, v, n) -> g, i, q: upper edge of the bin with the weighted median."""
    bins = values.groupBy("g", "i", F.floor(F.col("v") / _BIN).alias("bin")).agg(F.sum("n").alias("n"))
    return _share_bins(bins, ["g", "i"], 0.5).groupBy("g", "i").agg(((F.max("bin") + 1) * _BIN).alias("q"))


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _sums() -> list[Column]:
    n, x = F.col("n"), [F.col(f) for f in FEATURES]
    return [F.sum("n").alias("n"), *(F.sum(n * x[i]).alias(f"m_{i}") for i in range(len(x))), *(F.sum(n * x[i] * x[j]).alias(f"s_{i}{j}") for i, j in _PAIRS)]


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Sums over the rows taken (g, k, n, m_i, s_ij, was) -> mean m_i, the lower triangle w_ij of the inverse
    Cholesky factor of the covariance, log_det, and was (the log_det before the step)."""
    p, out = len(FEATURES), sums
    out = out.withColumns({f"m_{i}": F.col(f"m_{i}") / F.col("n") for i in range(p)})
    for i, j in _PAIRS:
        cov = (F.col(f"s_{i}{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor
        # the floor's variance is added to each diagonal entry, so the matrix is positive definite
        out = out.withColumn(f"c_{i}{j}", F.greatest(cov, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else cov)
    # covariance = L L'; distances need L's inverse, and the diagonal of L has the determinant
    for i, j in _PAIRS:
        rest = F.col(f"c_{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
        out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l_{j}{j}"))
    for i, j in _PAIRS:
        w = F.lit(1.0) if i == j else F.lit(0.0)
        for k in range(j, i):
            w = w - F.col(f"l_{i}{k}") * F.col(f"w_{k}{j}")
        out = out.withColumn(f"w_{i}{j}", w / F.col(f"l_{i}{i}"))
    log_det = 2 * sum((F.log(f"l_{i}{i}") for i in range(1, p)), F.log("l_00"))
    return out.select("g", "k", *[f"m_{i}" for i in range(p)], *[f"w_{i}{j}" for i, j in _PAIRS], log_det.alias("log_det"), "was")


def _distance() -> Column:
    """Squared Mahalanobis distance from the joined estimate."""
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w_{i}{j}") * (F.col(FEATURES[j]) - F.col(f"m_{j}"))
        total = total + y * y
    return total


def _concentrated(cells: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """Sums over the share of each group's rows that is nearest to each of its estimates. The scale
    of the bins fits small and large distances."""
    near = cells.join(estimates, "g").withColumn("bin", F.floor(F.log1p(_distance()) / _BIN))
    binned = near.groupBy("g", "k", "bin").agg(*_sums(), F.max("log_det").alias("was"))
    parts = ["n", *(f"m_{i}" for i in range(len(FEATURES))), *(f"s_{i}{j}" for i, j in _PAIRS)]
    taken = _share_bins(binned, ["g", "k"], share)
    return taken.groupBy("g", "k").agg(*(F.sum(c).alias(c) for c in parts), F.max("was").alias("was"))


def _starts(cells: DataFrame, small) -> DataFrame:
    """The three estimates from which each group's concentration steps begin."""
    none = F.lit(None).cast("double")
    values = cells.select("g", F.posexplode(F.array(*FEATURES)).alias("i", "v"), "n")
    median = materialize(_medians(values))
    away = values.join(small(median), ["g", "i"]).select("g", "i", F.abs(F.col("v") - F.col("q")).alias("v"), "n")
    scale = F.greatest(F.col("mad") * 1.4826, F.element_at(F.array(*map(F.lit, FLOORS)), F.col("i") + 1))
    both = median.join(_medians(away).withColumnRenamed("q", "mad"), ["g", "i"]).select("g", "i", "q", (1 / scale).alias("w"))
    one = both.groupBy("g").agg(
        *(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"m_{i}") for i in range(len(FEATURES))),
        *(F.max(F.when(F.col("i") == i, F.col("w"))).alias(f"w_{i}{j}") if i == j else F.lit(0.0).alias(f"w_{i}{j}") for i, j in _PAIRS),
    )
    first = materialize(one.withColumn("k", F.lit(0)).withColumn("log_det", none).withColumn("was", none))
    all_rows = _estimates(cells.groupBy("g").agg(*_sums()).withColumn("k", F.lit(1)).withColumn("was", none), 1.0)
    half = _estimates(_concentrated(cells, small(first), 0.5).withColumn("k", F.lit(2)), CONSISTENCY)
    return first.unionByName(all_rows).unionByName(half)


def robust_estimates(rows: DataFrame, groups: int) -> DataFrame:
    """rows (g, features) -> for each g the reweighted estimate of least determinant."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if groups <= BROADCAST_GROUPS else df

    cells = materialize(rows.groupBy("g", *FEATURES).agg(F.count("*").alias("n")))
    estimates = materialize(_starts(cells, small))
    for _ in range(MAX_STEPS):
        estimates = materialize(_estimates(_concentrated(cells, small(estimates), SUPPORT), CONSISTENCY))
        moved = estimates.agg(F.max(F.coalesce(F.abs(F.col("log_det") - F.col("was")), F.lit(1.0)))).first()[0]
        if moved is None or moved < SETTLED:
            break
    least = estimates.groupBy("g").agg(F.min(F.struct("log_det", "k")).alias("least")).select(F.col("g").alias("of"), F.col("least.k").alias("best"))
    best = materialize(estimates.join(small(least), (F.col("g") == F.col("of")) & (F.col("k") == F.col("best"))).drop("of", "best"))
    near = cells.join(small(best), "g").where(_distance() <= NEAR).groupBy("g", "k").agg(*_sums(), F.max("log_det").alias("was"))
    again = materialize(_estimates(near, REWEIGHTED))
    # a group none of whose rows is that near keeps its raw estimate
    return again.unionByName(best.join(small(again.select("g")), "g", "left_anti"))


def robust_distances(rows: DataFrame, groups: int) -> DataFrame:
    """rows (g, features, ...) -> with d2, the squared distance from their group's estimate."""
    estimates = materialize(robust_estimates(rows.select("g", *FEATURES), groups)).drop("k", "log_det", "was")
    joined = rows.join(F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates, "g")
    return joined.withColumn("d2", _distance())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the five counts, base_failed, kept, and columns of `keep`.

    Null text counts as empty and fails the base rule. A null language or source is a value of
    its own. Repeated rows are judged each for itself and alike; an empty table gives an
    empty result; other columns are ignored. Where fewer than MIN_GROUP rows are left to
    estimate from, even over all, the floors alone set the scale around their medians.
    """
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("kept")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), kept)
    rows = statistics(rows).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed).withColumns(_features()))
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    both = F.concat_ws("\u0001", lang, F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    fine = rows.groupBy(lang.alias("l"), both.alias("b")).agg(F.count("*").alias("n"))
    coarse = fine.withColumn("of_rest", F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)).over(Window.partitionBy("l")))
    group = F.when(F.col("n") >= MIN_GROUP, F.col("b")).when(F.col("of_rest") >= MIN_GROUP, F.col("l")).otherwise(F.lit("*"))
    groups = materialize(coarse.select("b", group.alias("g")))
    rows = rows.withColumn("b", both).join(checked_broadcast(groups, BROADCAST_GROUPS), "b").drop("b")
    judged = robust_distances(rows, groups.select("g").distinct().count())
    own = [F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    ok = (~F.col("base_failed") & (F.col("d2") <= LIMIT)).alias("kept")
    return judged.select(*own, ok, *[F.col("kept")[c].alias(c) for c in keep])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
