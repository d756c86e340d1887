"""Texts from any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def from_table(frame: DataFrame, path: Column, text: Column, *keep: str, partitions: int | None = None) -> DataFrame:
    """``sources`` from a table: a unique path, the text, and columns to keep.

    Rows stay in the tasks that read them. ``partitions`` deals them out to so many tasks by their paths, which sends
    all texts over the network: worth it only for a small table in a file with one row group.
    """
    sources = frame.select(path.alias("path"), text.alias("text"), *keep)
    return sources if partitions is None else sources.repartition(partitions, "path")
