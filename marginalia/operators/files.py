"""Scanning and rewriting tables of files.

``sources`` has a unique ``path`` and a ``text`` column.  All work on one file
happens inside its row, so none of these plans needs an exchange unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import paths, preview, rewrite, scan
from marginalia.functions.text import LINE_BLOCK, line_blocks, line_in_block
from marginalia.rules import CommentRules, JobConfig

# What the index says about a file.
FILE_REMOVED = "file removed"
ONE_REMOVED = "1 comment removed"
MANY_REMOVED = " comments removed"


def select_files(sources: DataFrame, config: JobConfig) -> DataFrame:
    """Files that pass the path rules and have a wanted ending."""
    return sources.where(wanted(F.col("path"), config))


def wanted(path: Column, config: JobConfig) -> Column:
    return paths.passes(path, config.base, config.paths) & has_ending(path, config)


def has_ending(path: Column, config: JobConfig) -> Column:
    return paths.ends_with_any(paths.relative(path, config.base), config.endings)


def find_occurrences(sources: DataFrame, rules: CommentRules) -> DataFrame:
    """One row per occurrence: path, pos, lines, comment_text."""
    text = F.col("text")
    # The scan sits inside the generator: as a column of its own it would be
    # pushed into the filter Spark infers for generators, and run twice.
    found = sources.where(scan.has_start_tag(text, rules)).select(
        "path", F.inline(scan.located(scan.cut(text, rules)))
    )
    # Offsets are worked out per row, in generated code.
    return found.select("path", *scan.occurrence_columns(F.col("before"), F.col("text")))


def flatten(occurrences: DataFrame) -> DataFrame:
    """Occurrences with plain columns in place of structs."""
    return occurrences.select(
        "path",
        F.col("pos.first").alias("first"),
        F.col("pos.last").alias("last"),
        F.col("lines.first").alias("line_first"),
        F.col("lines.last").alias("line_last"),
        "comment_text",
    )


def commented_files(sources: DataFrame, rules: CommentRules) -> DataFrame:
    """Files that have an occurrence, with ``segments`` in place of ``text``."""
    text = F.col("text")
    found = F.array(F.struct(scan.cut(text, rules).alias("segments")))
    # A generator that gives one row or none: unlike a filter it is not pushed
    # below the scan, which would run the scan twice.
    return sources.where(scan.has_start_tag(text, rules)).select(
        *(c for c in sources.columns if c != "text"),
        F.inline(F.filter(found, lambda f: F.size(f["segments"]) > 1)),
    )


def group_by_file(files: DataFrame) -> DataFrame:
    """Scanned files with their occurrences in text order, as an array."""
    return files.select(
        *(c for c in files.columns if c != "segments"), scan.occurrences(F.col("segments")).alias("items")
    )


def collect_by_file(occurrences: DataFrame) -> DataFrame:
    """The same from a table of occurrences, which needs one exchange.

    A group is as large as the occurrences of one file, which came from one row.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "lines", "comment_text")))
    return occurrences.groupBy("path").agg(items.alias("items"))


def clean_files(files: DataFrame) -> DataFrame:
    """Scanned files with ``cleaned`` text, number of comments and ``label``."""
    cleaned = files.withColumn("cleaned", rewrite.cleaned(F.col("segments")))
    counted = cleaned.withColumn("comments", scan.occurrence_count(F.col("segments")))
    return counted.withColumn("label", removal_label(F.col("cleaned"), F.col("comments")))


def clean_listed(sources: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Cleaned text for occurrences that come as a table of their own, one exchange of each side."""
    return sources.join(collect_by_file(occurrences), "path").select(
        "path", rewrite.remove_comments(F.col("text"), F.col("items")).alias("cleaned")
    )


def clean_all(sources: DataFrame, rules: CommentRules) -> DataFrame:
    """Every file without its occurrences; files that were nothing but comments are left out."""
    text = F.col("text")
    cleaned = F.when(scan.has_start_tag(text, rules), rewrite.cleaned(scan.cut(text, rules))).otherwise(text)
    kept = F.filter(F.array(F.struct(cleaned.alias("cleaned"))), lambda f: (f["cleaned"] != "") | (text == ""))
    return sources.select(*(c for c in sources.columns if c != "text"), F.inline(kept))


def cleaned_tree(sources: DataFrame, config: JobConfig) -> DataFrame:
    """path, rel_path and text of the whole tree after a run: selected files without their comments, those that were
    nothing but comments gone, and all other files as they were.  One scan of each text, no exchange."""
    path, text = F.col("path"), F.col("text")
    touched = wanted(path, config) & scan.has_start_tag(text, config.comments)
    cleaned = F.when(touched, rewrite.cleaned(scan.cut(text, config.comments))).otherwise(text)
    stays = F.filter(F.array(F.struct(cleaned.alias("text"))), lambda f: f["text"].isNull() | (f["text"] != "") | (text == ""))
    rel_path = paths.forward_slashes(paths.relative(path, config.base))
    return sources.select("path", rel_path.alias("rel_path"), F.inline(stays))


def line_numbers_of(sources: DataFrame, offsets: DataFrame, pos: str = "pos", name: str = "line") -> DataFrame:
    """``offsets`` (path, an offset and any other columns) with the 1-based line of each offset as ``name``.

    Each text is read once, whatever the number of its offsets, and gives a narrow row for every 1,024 characters;
    offsets meet those rows by (path, block), so the work for an offset depends neither on where it stands nor on how
    many others its text has, and the offsets of a hot file are spread over its blocks. No text is shuffled.

    An offset belongs to a character of the text or is its length; for any other, and where the path or the offset is
    null or the path or its text is unknown, the line is null. Offsets given twice are answered twice.
    """
    if name.lower() in {c.lower() for c in offsets.columns}:
        raise ValueError(f"the table of offsets already has a column {name}")
    blocks = sources.select("path", F.inline(line_blocks(F.col("text")))).select("path", F.struct("block", "size", "lines", "starts").alias("at"))
    at, own = F.col("o.path"), F.col(f"o.`{pos}`")
    block = F.when(own >= 0, F.floor(own.cast("long") / LINE_BLOCK))
    met = offsets.alias("o").join(blocks.alias("b"), (at == F.col("b.path")) & (block == F.col("b.at.block")), "left")
    line = F.when(own % LINE_BLOCK < F.col("b.at.size"), line_in_block(F.col("b.at"), own))
    return met.select(*(F.col(f"o.`{c}`") for c in offsets.columns), line.alias(name))


def is_emptied(cleaned: Column) -> Column:
    """True for a file that holds nothing but comments; white space left over keeps it."""
    return cleaned == ""


def removal_label(cleaned: Column, comments: Column) -> Column:
    return (
        F.when(is_emptied(cleaned), FILE_REMOVED)
        .when(comments == 1, ONE_REMOVED)
        .otherwise(F.concat(comments.cast("string"), F.lit(MANY_REMOVED)))
    )


def run_totals(sources: DataFrame, config: JobConfig) -> DataFrame:
    """One row: files under the path rules, of these the ones with a wanted ending, and their occurrences."""
    path, text = F.col("path"), F.col("text")
    found = scan.occurrence_count(scan.segments(text, config.comments))
    checked = sources.where(paths.passes(path, config.base, config.paths)).select(
        has_ending(path, config).alias("matching"),
        F.when(has_ending(path, config), found).otherwise(0).alias("occurrences"),
    )
    return checked.agg(
        F.count("*").alias("files"),
        F.count_if("matching").alias("matching_files"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
    )


def distinct_paths(frame: DataFrame) -> DataFrame:
    """Every path once; copies are dropped before the exchange."""
    return frame.select("path").distinct()


def file_sections(files: DataFrame) -> DataFrame:
    """Scanned files as plain and highlighted sections: path, seq, text, highlight."""
    return files.select("path", F.inline(preview.sections(F.col("segments"))))


def file_markup(files: DataFrame) -> DataFrame:
    """Scanned files as markup: path, html."""
    return files.select("path", preview.file_markup(F.col("path"), F.col("segments")).alias("html"))
