"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new, unused path in the folder named by ``spark.checkpoint.dir``."""
    return f"{_base(spark)}/marginalia-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: whatever reads them sees the same ones."""
    sc = frame.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_base(frame.sparkSession))
    return frame.checkpoint()


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


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder through Spark's file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
