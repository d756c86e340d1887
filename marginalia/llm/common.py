"""Helpers that several of these operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A-Z to a-z; every other ASCII character but a digit or a-z to a blank; bytes above 0x7F stay.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

#: Rows that a task works on, and hands on, at once.
PORTION = 1000


def utf8(text: str | None) -> bytes:
    """The text in UTF-8; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return utf8(text).translate(WORD_TABLE).split()


def hash_pair(*cols: Column) -> list[Column]:
    """Two 64-bit hashes of the same columns: 128 bits, so that equal keys mean equal values at any corpus size."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2")]


def ready_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
            base = tempfile.mkdtemp(prefix="marginalia-")
        sc.setCheckpointDir(base)


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder; executors may be lost without computing them anew."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint()


def portions(batches: Iterator[pa.RecordBatch], rows: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, a few at a time: what a task makes of them then never fills a whole batch of Spark's,
    in the worker or in the executor that reads it. What the batches took goes back at the end."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        b = None
        _hand_back()


def _hand_back() -> None:
    """Memory that is not used any more goes back to the system; a worker lives on after its task and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own, where it has one
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the tasks, once for each application; Spark hands the archive out."""
    sc = spark.sparkContext
    if not getattr(sc, "_marginalia_sent", False):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="marginalia-code-")) / "marginalia_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._marginalia_sent = True


def first_rows(frame: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order, as ``orderBy(*order).limit(n)`` gives them.

    That would send ``n`` rows of every task to the driver. Here rows are laid out by ranges of the order; how many of
    each range are wanted follows from the ranges' sizes, and only those leave the tasks.
    """
    laid = kept(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = laid.groupBy("_part").count().collect()  # a row a range
    before, whole, rest = 0, [], None
    for r in sorted(sizes, key=lambda r: r["_part"]):
        if before + r["count"] <= n:
            whole.append(r["_part"])
        elif before < n:
            rest = r["_part"], n - before
        before += r["count"]
    first = laid.where(F.col("_part").isin(whole))
    if rest:  # within one range the first rows come from one sort
        last = laid.where(F.col("_part") == rest[0]).withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
        first = first.unionByName(last.where(F.col("_rank") <= rest[1]).drop("_rank"))
    return first.drop("_part")


def scratch(spark: SparkSession) -> str:
    """A new, unused path in the shared folder, for a table that is read again."""
    ready_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder through Spark's file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
