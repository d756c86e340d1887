"""Texts from a directory tree.

The tree is listed by tasks (see ``listing``). No name is left out, whatever it begins with, and no empty file; links are
not followed. Path rules are applied to the list; only what passes is opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import paths
from marginalia.operators.files import wanted
from marginalia.rules import JobConfig, root_path
from marginalia.sources.listing import file_system, listed, local

#: Bytes that a task reads, about, and bytes that it holds at a time (at least one file).
_TASK_BYTES, _BATCH_BYTES = 128 << 20, 16 << 20


def _named(files: DataFrame, root: str) -> DataFrame:
    path = F.when(F.col("rel_path") == "", F.lit(root_path(root))).otherwise(F.concat(F.lit(root_path(root) + "/"), "rel_path"))
    return files.select("place", path.alias("path"), "rel_path", "length", "modified")


def inventory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Files under ``root`` with length and time of change; contents are not read.

    With ``recursive=False`` only the direct children.
    """
    return _named(listed(spark, root, recursive), root).drop("place")


def read_tree(spark: SparkSession, root: str, config: JobConfig | None = None) -> DataFrame:
    """``sources`` under ``root``: path, rel_path, text, length, modified.

    Bytes that are not UTF-8 become U+FFFD; line ends stay as they are.  With ``config``
    only files that pass its rules are opened.  A file that is gone when it is read fails the job.
    """
    files = _named(listed(spark, root), root)
    if config is not None:
        files = files.where(wanted(F.col("path"), config))
    known = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(known.n, max(spark.sparkContext.defaultParallelism, ceil(known.bytes / _TASK_BYTES))))
    root, open_fs, batch_bytes = local(root), file_system, _BATCH_BYTES

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, _ = open_fs(root)

        def batch(rows: list, contents: list, like):
            picked = like.take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*picked.columns, pa.array(contents, pa.large_binary()).cast(pa.binary())], names=[*like.schema.names, "content"])

        for b in batches:
            rows, contents, held = [], [], 0
            for i, place in enumerate(b.column("place").to_pylist()):
                with system.open_input_stream(place) as f:
                    contents.append(f.read())
                rows.append(i)
                held += len(contents[-1])
                if held >= batch_bytes:
                    yield batch(rows, contents, b)
                    rows, contents, held = [], [], 0
            if rows:
                yield batch(rows, contents, b)

    spread = files.repartition(tasks, "path")
    loaded = spread.mapInArrow(read, "place string, path string, rel_path string, length long, modified timestamp, content binary")
    return loaded.select(
        "path", "rel_path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "length", "modified"
    )
