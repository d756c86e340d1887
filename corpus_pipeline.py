"""A corpus from documents to packed sequences. Each stage works on what the one before wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import lines, packing, secrets, simhash, toxicity
from marginalia.llm.common import drop, fresh, ready_checkpoints


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; null and empty texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = tuple(fresh(docs, n) for n in ("toxic_score", "toxic_predicted", "toxic_evidence"))
    return toxicity.score(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more sources have, and passages of over 50 words that two or more have, go, but for the
    first document with each."""
    return _counted(lines.remove_spread_lines(docs, long_words=50), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: those linked by a Jaccard similarity of 0.8 or more of
    their five-word shingles."""
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    names = tuple(fresh(docs, n) for n in ("n_candidates", "secrets", "top_score", "redacted"))
    found = secrets.scan(docs, secrets.fit_on(docs), names=names)
    masked = found.select(*[F.col(names[3]).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return _counted(masked, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences of at most 2048, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("simhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Merge rounds, forests and neighbour votes are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, and those of
    the stage before are removed."""
    ready_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop(spark, before)
        before = path
    return docs
