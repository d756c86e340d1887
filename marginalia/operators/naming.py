"""Numbers within groups, and the names of summaries made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import paths
from marginalia.plans.workspace import kept

#: The end of a stem that another family's number could make: no sign, no leading zero, and fit for a long.
_NUMBERED = r"\A(?s:(.*))-([1-9][0-9]{0,17})\z"


def running_sums(frame: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``frame`` with the sum of ``value`` over the row and all before it in its group, in the order of ``order``.

    Rows are laid out by ranges of (group, order), so a group that holds most rows lies in many ranges. Each range
    sums its own rows, and the sums of the ranges before it are added. The layout is written to the shared folder, as
    both steps have to see the same one. Rows without a group are left out.
    """
    laid = frame.where(F.col(group).isNotNull()).withColumn("_value", value.cast("long"))
    laid = kept(laid.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = laid.groupBy(group, "_range").agg(F.sum("_value").alias("_own")).select(
        group, "_range", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_before")
    )
    within = W.partitionBy(group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = laid.withColumn("_sum", F.sum("_value").over(within))
    return summed.join(before, [group, "_range"]).select(*frame.columns, (F.col("_before") + F.col("_sum")).alias(name))


def number_in_group(frame: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``group``, ``order`` and ``name`` = 0, 1, 2, ... within each ``group`` in the order of ``order``."""
    numbered = running_sums(frame.select(group, order), group, [order], F.lit(1), "_count")
    return numbered.select(group, order, (F.col("_count") - 1).cast("int").alias(name))


def _contests(files: DataFrame) -> DataFrame:
    """Names that two families claim: (parent, number, child, first).

    The files of a stem are a family. ``X-3`` is what the family ``X`` calls number 3 and the family ``X-3`` calls its
    first, and no third one can claim it. ``first`` is the path at which the child's family asks for it.
    """
    families = files.groupBy("_stem").agg(F.min("path").alias("first"))
    ending = F.regexp_extract("_stem", _NUMBERED, 2)
    children = families.where(ending != "").select(
        F.regexp_extract("_stem", _NUMBERED, 1).alias("parent"), ending.cast("long").alias("number"), F.col("_stem").alias("child"), "first"
    )
    return children.join(families.select(F.col("_stem").alias("parent")), "parent", "left_semi")


def _settled(contests: DataFrame) -> DataFrame:
    """Who gets a contested name: (parent, number, child, taken), ``taken`` if it is the parent.

    ``contests`` has ``rank``, the number of the parent's files before the child's first. A parent whose own name was
    free (``start`` 0) and that has skipped s names comes to number k with its file k - start - s, so it takes the name
    if that is less than ``rank``, and else skips it. Both start and s lie between bounds that each round narrows: what
    holds at both bounds is settled. A round settles the first open name of every family at least, and nearly always
    all of them.
    """
    state = contests.withColumns({"taken": F.lit(False), "skipped": F.lit(False)})
    while True:
        least = running_sums(state, "parent", ["number"], F.col("skipped").cast("int"), "_least")
        both = running_sums(least, "parent", ["number"], (~F.col("taken")).cast("int"), "_most")
        own = state.select(F.col("child").alias("parent"), F.col("taken").cast("int").alias("_low"), (~F.col("skipped")).cast("int").alias("_high"))
        bounds = both.join(own, "parent", "left").na.fill(0, ["_low", "_high"])
        # sums run through the row itself, which does not count for it
        least_skips, most_skips = F.col("_least") - F.col("skipped").cast("int"), F.col("_most") - (~F.col("taken")).cast("int")
        state = kept(
            bounds.select(
                "parent", "number", "child", "rank",
                (F.col("number") - F.col("_low") - least_skips < F.col("rank")).alias("taken"),
                (F.col("number") - F.col("_high") - most_skips >= F.col("rank")).alias("skipped"),
            )
        )
        if state.where("not taken and not skipped").isEmpty():
            return state.select("parent", "number", "child", "taken")


def summary_names(files: DataFrame) -> DataFrame:
    """path and ``summary_name``: in the order of paths each file gets the first of ``stem.json``, ``stem-1.json``,
    ``stem-2.json``, ... that no file before it has. No two files of a run have the same name; a null path has none.

    A family of files with one stem is numbered in parallel. Families meet only in names such as ``X-3``; which of the
    two has such a name is settled first, among the contested names alone, and moves the numbers behind it.
    """
    known = files.select("path", paths.stem(paths.file_name(F.col("path"))).alias("_stem"))
    named = known.where("path is not null")
    contests = kept(_contests(named))
    if contests.isEmpty():
        numbered = number_in_group(named, "_stem", "path", "_number")
    else:
        numbered = _numbered_around(named, contests)
    suffix = F.when(F.col("_number") > 0, F.concat(F.lit("-"), F.col("_number").cast("string"))).otherwise("")
    nameless = known.where("path is null").select("path", F.lit(None).cast("string").alias("summary_name"))
    return numbered.select("path", F.concat("_stem", suffix, F.lit(".json")).alias("summary_name")).unionAll(nameless)


def _numbered_around(named: DataFrame, contests: DataFrame) -> DataFrame:
    """_stem, path and ``_number`` where other families claim some of a family's names."""
    # A child's first path is laid among its parent's files: how many of these come before it is its rank.
    nothing = F.lit(None).cast("long")
    asked = contests.select("first", F.col("parent").alias("_stem"), "number", "child")
    rows = named.select("path", "_stem", nothing.alias("number"), F.lit(None).cast("string").alias("child"))
    laid = running_sums(rows.unionAll(asked), "_stem", ["path"], F.col("child").isNull().cast("int"), "_count")
    laid = kept(laid)
    ranked = laid.where("child is not null").select(F.col("_stem").alias("parent"), "number", "child", F.col("_count").alias("rank"))
    settled = kept(_settled(ranked))
    starts = settled.where("taken").select(F.col("child").alias("_stem"), F.lit(1).alias("_start"))
    own = laid.where("child is null").join(starts, "_stem", "left").select(
        "_stem", "path", F.coalesce("_start", F.lit(0)).alias("_start"), (F.col("_count") - 1).alias("_at")
    )
    # The i-th skipped name stands behind number - start - (i - 1) files, which moves all later ones by one.
    skips = running_sums(settled.where("not taken"), "parent", ["number"], F.lit(1), "_nth").select(F.col("parent").alias("_stem"), "number", "_nth")
    skips = skips.join(starts, "_stem", "left")
    gaps = skips.select("_stem", F.lit(None).cast("string").alias("path"), F.lit(0).alias("_start"), (F.col("number") - F.coalesce("_start", F.lit(0)) - F.col("_nth") + 1).alias("_at"))
    gapped = gaps.select("_stem").distinct()
    plain = own.join(gapped, "_stem", "left_anti").select("_stem", "path", (F.col("_at") + F.col("_start")).alias("_number"))
    moved = own.join(gapped, "_stem", "left_semi").unionAll(gaps)
    # nulls come first: a gap stands before the file at its place
    moved = running_sums(moved, "_stem", ["_at", "path"], F.col("path").isNull().cast("int"), "_gaps").where("path is not null")
    return plain.unionAll(moved.select("_stem", "path", (F.col("_at") + F.col("_start") + F.col("_gaps")).alias("_number")))
