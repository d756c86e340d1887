"""Quality rules by robust multivariate outliers, in DataFrame functions alone.

Each text is described by a vector of transformed statistics. For each language and source, a minimum-covariance-
determinant estimate of centre and covariance is worked out over the group's distinct vectors (so copies count once)
by concentration steps: the half that is nearest by Mahalanobis distance gives the next estimate. Of a few starts the
one with the smallest determinant is taken, and the vectors near it give the final estimate. Texts far from that are
rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, kept

GRAM = 5
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STEPS = 4
#: The quantiles at which the starts are centred.
STARTS = (0.5, 0.25, 0.75)
#: Squared distances above this are rejected: far beyond any usual quantile of 4 degrees of freedom (18.5 has one
#: text in a thousand), as statistics of clean texts have longer tails than a normal distribution.
CUT = 60.0
#: Median of the chi-square distribution with 4 degrees of freedom, to which distances are scaled.
MEDIAN = 3.3567
#: Scaled squared distances up to this (the 97.5 % quantile of that distribution) give the final estimate.
NEAR = 11.1433
#: Groups with fewer distinct vectors have no estimate of their own, and are judged by the next wider group's.
LEAST_TEXTS = 50
#: Standard deviations that an estimate never goes below, by statistic.
FLOOR = (0.10, 0.035, 0.08, 0.08)
#: Estimates of at most so many groups are broadcast; more are joined by shuffling.
BROADCAST_GROUPS = 20_000
STATISTICS = ("s0", "s1", "s2", "s3")
#: What the texts of an estimate have in common, from the narrowest to the whole table.
LEVELS = (("lang", "source"), ("lang",), ())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, and only if this expression is."""
    return F.transform(F.array(value), use)[0]


def _covered(grams: Column) -> Column:
    """How many words lie in windows that occur twice or more: window numbers are sorted by hash to find those with
    an equal neighbour, then by number to add up what each covers that the one before does not."""
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def twice(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(x["g"] == F.get(rows, k)["g"], F.lit(False))
        marked = F.transform(rows, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def added(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get(at, k + 1) - p, F.lit(GRAM))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(ordered, lambda rows: let(twice(rows), added))


def statistics(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word), all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    blank = F.translate(body, SPACES, " " * len(SPACES))
    words = F.array_remove(F.split(blank, " ", -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")

    def repeated(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)])
        )
        return F.when(F.size(w) < GRAM, 0).otherwise(
            let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_covered(g)))
        )

    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("repeat")))
    return {
        "words": word_counts,
        "lines": line_counts,
        "word_chars": F.length(F.translate(blank, " ", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
    }


def _vector() -> list[Column]:
    """Mean word length (log), and the roots of the shares of symbols, repeated lines and repeated words. Constants
    in the denominators keep short texts, whose shares are chancy, near the middle."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log((chars + 300) / (n + 50)),
        F.sqrt(F.col("n_symbols") / (chars + 100)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        F.sqrt(F.col("n_repeat_words") / (n + 50)),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's statistics from the estimate beside them: the inverse of the Cholesky
    factor (columns f_jk) applied to the difference from the centre (columns m_j)."""
    p = range(len(STATISTICS))
    parts = [sum((F.col(f"f{j}{k}") * (F.col(f"s{k}") - F.col(f"m{k}")) for k in range(j + 1)), F.lit(0.0)) for j in p]
    return sum((x * x for x in parts), F.lit(0.0))


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and inverse Cholesky factor of the covariance for each group with enough rows."""
    p = range(len(STATISTICS))
    means = [F.avg(f"s{j}").alias(f"m{j}") for j in p]
    covariances = [F.covar_pop(f"s{j}", f"s{k}").alias(f"c{j}{k}") for j in p for k in range(j + 1)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *means, *covariances).where(F.col("n") >= LEAST_TEXTS / 2)
    floor = {j: F.lit(FLOOR[j] ** 2) for j in p}
    for j in p:  # Cholesky factor l_jk, row by row
        for k in range(j):
            known = sum((F.col(f"l{j}{i}") * F.col(f"l{k}{i}") for i in range(k)), F.lit(0.0))
            out = out.withColumn(f"l{j}{k}", (F.col(f"c{j}{k}") - known) / F.col(f"l{k}{k}"))
        known = sum((F.col(f"l{j}{i}") * F.col(f"l{j}{i}") for i in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") + floor[j] - known, floor[j])))
    for j in p:  # its inverse f_jk
        out = out.withColumn(f"f{j}{j}", 1 / F.col(f"l{j}{j}"))
        for k in range(j - 1, -1, -1):
            known = sum((F.col(f"l{j}{i}") * F.col(f"f{i}{k}") for i in range(k, j)), F.lit(0.0))
            out = out.withColumn(f"f{j}{k}", -known / F.col(f"l{j}{j}"))
    return kept(out.select(*keys, *[f"m{j}" for j in p], *[f"f{j}{k}" for j in p for k in range(j + 1)]))


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    names = {k: fresh(rows, f"{k}_beside") for k in keys}
    right = groups.withColumnsRenamed(names)
    right = F.broadcast(right) if groups.count() <= BROADCAST_GROUPS else right
    on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    joined = rows.join(right, reduce(Column.__and__, on), how).drop(*names.values())
    return joined


def _scaled() -> Column:
    """The distance from the estimate beside a row, scaled so that the median of the group is that of the chi-square
    distribution, unless the floors keep it below that. This makes up for what the nearest half lacks in spread."""
    return _distance() * F.least(F.lit(1.0), MEDIAN / F.col("half"))


def _halves(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates with the median of the distances from them."""
    return kept(placed.groupBy(*keys).agg(F.greatest(F.percentile_approx("d", 0.5, 1000), F.lit(1e-6)).alias("half")))


def _robust(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate of each group of distinct vectors, with the median of its distances as ``half``."""
    p = range(len(STATISTICS))
    middle = kept(
        vectors.groupBy(*keys)
        .agg(F.count("*").alias("n"), *[F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(f"q{j}") for j, s in enumerate(STATISTICS)])
        .where(F.col("n") >= LEAST_TEXTS)
    )
    # Less than half of the vectors, all on one side, cannot widen the narrower of both quarters beside the median.
    spread = [F.greatest(F.least(F.col(f"q{j}")[2] - F.col(f"q{j}")[1], F.col(f"q{j}")[1] - F.col(f"q{j}")[0]) / 0.6745, F.lit(FLOOR[j])) for j in p]
    at = {0.25: 0, 0.5: 1, 0.75: 2}
    starts = F.array(*[
        F.struct(F.lit(k).alias("start"), sum((((F.col(s) - F.col(f"q{j}")[at[q]]) / spread[j]) ** 2 for j, s in enumerate(STATISTICS)), F.lit(0.0)).alias("d"))
        for k, q in enumerate(STARTS)
    ])
    beside = _beside(vectors, middle, keys)
    placed = beside.select(*keys, "n", *STATISTICS, F.explode(starts).alias("x")).select(*keys, "n", *STATISTICS, "x.start", "x.d")
    trial = [*keys, "start"]
    everyone = beside.select(*keys, "n", *STATISTICS, F.explode(F.array(*[F.lit(k) for k in range(len(STARTS))])).alias("start"))
    # (n + p + 1) / 2 of n, in steps of half a hundredth
    shares = [0.5 + k / 200 for k in range(12)]
    step = F.ceil(100 * (len(STATISTICS) + 1) / F.first("n")).cast("int")
    for _ in range(STEPS):
        limits = kept(placed.groupBy(*trial).agg(F.get(F.percentile_approx("d", shares, 1000), F.least(step, F.lit(11))).alias("limit")))
        estimate = _estimate(_beside(placed, limits, trial).where("d <= limit"), trial)
        placed = _beside(everyone, estimate, trial).select(*trial, "n", *STATISTICS, _distance().alias("d"))
    # the inverse factor's diagonal is the greater, the smaller the determinant
    size = sum((F.log(F.col(f"f{j}{j}")) for j in p), F.lit(0.0))
    best = kept(estimate.groupBy(*keys).agg(F.max_by("start", F.struct(size, -F.col("start"))).alias("start")))
    halves = _halves(_beside(placed, best, trial), keys)
    chosen = kept(_beside(_beside(estimate, best, trial).drop("start"), halves, keys))
    near = _beside(vectors, chosen, keys).where(_scaled() <= NEAR).select(*keys, *STATISTICS)
    final = _estimate(near, keys)
    halves = _halves(_beside(vectors, final, keys).select(*keys, _distance().alias("d")), keys)
    return kept(_beside(final, halves, keys))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance), a row for
    every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A text fails the base rules with fewer than 10 words or if more than 20 % of
    them lie in 5-word windows that occur twice or more. Those that pass are kept unless their scaled squared
    distance from their language's and source's estimate is above ``cut``; null languages and sources are values of
    their own. A group too small for an estimate is judged by its language's over all sources, and if that is too
    small as well by the whole table's; ``distance`` is null in the last case, as it is no distance among texts of the
    same language. Only a table too small as a whole is judged by the base rules alone.
    Estimates use the distinct vectors of the texts that pass the base rules. Null texts have no words. Rows do not depend on their number
    of copies; an empty table gives no rows; other columns play no part.
    """
    stats = statistics(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), *[c.alias(n) for n, c in stats.items()])
    rows = rows.select(
        "doc_id", "lang", "source", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.repeat").cast("long").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = kept(rows.select("*", failed.alias("base_failed"), *[c.alias(s) for c, s in zip(_vector(), STATISTICS, strict=True)]))
    keys = ["lang", "source"]
    levels = F.array(*[
        F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in own else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in keys])
        for k, own in enumerate(LEVELS)
    ])
    passed = rows.where("not base_failed").select(F.explode(levels).alias("g"), *STATISTICS).select("g.*", *STATISTICS)
    scaled = _robust(kept(passed.distinct()), ["level", *keys])
    far = rows
    for k, own in enumerate(LEVELS):
        groups = scaled.where(F.col("level") == k).drop(*set(keys) - set(own))
        far = _beside(far.withColumn("level", F.lit(k)), groups, ["level", *own], "left").select(*far.columns, _scaled().alias(f"d{k}"))
    far = far.withColumn("distance", F.coalesce("d0", "d1"))
    measured = F.coalesce("distance", "d2")
    fine = ~F.col("base_failed") & (measured.isNull() | (measured <= cut))
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", fine.alias("kept"), "distance"
    )
