"""Preview run: what would be removed."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import paths, preview
from marginalia.operators import files
from marginalia.rules import JobConfig

Format = Literal["one_line", "multi_line", "markup"]


def preview_run(sources: DataFrame, config: JobConfig, fmt: Format = "one_line") -> DataFrame:
    """Preview lines of the selected files: path, first (offset, for ordering) and line.

    The markup format gives one row per file, or a single one with a message if there is no comment.
    """
    chosen = files.select_files(sources, config)
    if fmt == "markup":
        scanned = files.commented_files(chosen.select("path", "text"), config.comments)
        shown = files.file_markup(scanned).unionByName(nothing_found(scanned))
        return shown.select("path", F.lit(0).alias("first"), F.col("html").alias("line"))
    found = files.find_occurrences(chosen, config.comments)
    rel_path = paths.relative(F.col("path"), config.base)
    first_line, last_line, text = F.col("lines.first"), F.col("lines.last"), F.col("comment_text")
    if fmt == "one_line":
        line = preview.one_line(rel_path, first_line, text)
    elif fmt == "multi_line":
        line = preview.multi_line(rel_path, first_line, last_line, text)
    else:
        raise ValueError(f"unknown preview format: {fmt}")
    return found.select("path", F.col("pos.first").alias("first"), line.alias("line"))


def nothing_found(scanned: DataFrame) -> DataFrame:
    """The row that says so if ``scanned`` is empty; no task looks further than its first scanned file."""
    return (
        scanned.select("path")
        .limit(1)
        .agg(F.count("*").alias("n"))
        .where("n = 0")
        .select(F.lit(None).cast("string").alias("path"), F.lit(preview.NO_COMMENTS).alias("html"))
    )


def write_preview(lines: DataFrame, target: str) -> None:
    """Preview lines as text files, in the order of paths and offsets (a range exchange)."""
    lines.orderBy("path", "first").select("line").write.mode("overwrite").text(target)
