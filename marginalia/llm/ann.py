"""Approximate nearest neighbours by cosine: adaptive dimension scans within probed lists.

Every vector belongs to the list of its nearest centre. Within a probed list, unit vectors are rotated and scanned
in blocks of columns; after each block a hypothesis test compares the distance so far with the best found and
abandons the candidates that are most unlikely to come in. Survivors get the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import first_rows, kept, ship

#: Bounds: vectors that the centres are fitted on, and the number of lists.
SAMPLE, MAX_LISTS = 20_000, 1024
#: The recall that the number of probed lists is set for, measured against brute force within the sample, and the
#: number of queries that measure it.
RECALL, TRIALS = 0.96, 256
#: Vectors and queries of a task's cell at most, about.
CELL = 4096
COLUMNS = 16
#: Of the test: a candidate goes if its partial distance, carried on to all columns, is above the bound by this.
EPSILON = 2.1


def _valid(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def fit_centres(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit vectors; centres that lose all vectors start anew at one that is far from its own."""
    rng = np.random.default_rng(17)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        own, far = near.argmax(axis=1), np.argsort(near.max(axis=1), kind="stable")
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        lost = np.flatnonzero(np.abs(sums).max(axis=1) < 1e-12)
        sums[lost] = x[far[: len(lost)]]
        centres = unit(sums)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> int:
    """How many lists to probe so that this share of the k nearest within the sample, whose rows come in no order
    that matters, lies in them."""
    asked = x[:trials]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not best.size:
        return 1
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    own = (x @ centres.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed), ceil(recall * len(needed))) - 1]) + 1


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(23).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its squares neither overflow nor vanish; directions stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def scan_cell(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, cosine) of each query's k best in a cell."""
    turn = rotation(x.shape[1])
    x, queries = scaled(x), scaled(queries)
    blocks = [np.ascontiguousarray(b) for b in np.array_split(unit(x) @ turn, range(COLUMNS, x.shape[1], COLUMNS), axis=1)]
    asked = np.array_split(unit(queries) @ turn, range(COLUMNS, x.shape[1], COLUMNS), axis=1)
    long_x, long_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    size = x.shape[1]
    out = []
    for j in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[j])
        if not len(alive):
            continue
        part = ((blocks[0][alive] - asked[0][j]) ** 2).sum(axis=1)
        seen = blocks[0].shape[1]
        # the k nearest by the first columns set the bound
        lead = alive[np.argpartition(part, k - 1)[:k]] if len(alive) > k else alive
        bound = max(sum(((b[lead] - a[j]) ** 2).sum(axis=1) for b, a in zip(blocks, asked, strict=True))) if len(alive) > k else np.inf
        for b, a in zip(blocks[1:], asked[1:], strict=True):
            stay = part * size / seen <= bound * (1 + EPSILON / np.sqrt(seen)) ** 2 + 1e-9
            alive, part = alive[stay], part[stay]
            part = part + ((b[alive] - a[j]) ** 2).sum(axis=1)
            seen += b.shape[1]
        stay = part <= bound + 1e-9
        alive = alive[stay]
        # sums along a row come out alike for like rows, so equal vectors tie
        cosine = (x[alive] * queries[j]).sum(axis=1) / (long_x[alive] * long_q[j])
        best = np.lexsort((ids[alive], -cosine))[:k]
        out.append((np.full(len(best), j), alive[best], cosine[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(
    table: DataFrame,
    queries: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine for each row of ``table`` that ``queries`` holds for.

    Candidates are all rows with another id; ties go to the smaller id. If fewer than k candidates exist, all come.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id,
    nor vectors of another length than most (of equals, the longer). Of rows that repeat an id the smallest vector
    takes part. An empty table gives no rows. Other columns play no part.

    The centres are fitted on at most ``SAMPLE`` vectors, and so is the number of lists to probe, which grows until
    ``recall`` of the neighbours within the sample are in them; all vectors are indexed. Lists are cut into cells of some
    ``CELL`` vectors, and the queries of a list likewise, so no list, however many vectors it has, is one task's.
    """
    spark = table.sparkSession
    ship(spark)
    rows = (
        table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
        .where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    )
    rows = kept(rows)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size, n = (sizes[0]["size"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == size)
    order = F.xxhash64("vec_id")
    drawn = first_rows(rows.select("vec_id", "v"), SAMPLE, order, F.col("vec_id")).select(order.alias("order"), "vec_id", "v").collect()
    sample = [r["v"] for r in sorted(drawn, key=lambda r: (r["order"], r["vec_id"]))]
    lists = max(1, min(MAX_LISTS, round(n**0.5)))
    seen = unit(np.array(sample)) if sample else np.ones((1, size))
    centres = fit_centres(seen, lists)
    probes = probes_for(seen, centres, k, recall)
    shared = spark.sparkContext.broadcast(centres)

    def listed(batches: Iterator) -> Iterator:
        for b in batches:
            if b.num_rows:
                near = unit(np.stack(b.column("v").to_numpy(zero_copy_only=False))) @ shared.value.T
                yield b.append_column("list", pa.array(near.argmax(axis=1).astype(np.int32)))

    indexed = kept(rows.mapInArrow(listed, "vec_id long, v array<double>, asks boolean, list int"))
    counts = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # lists at most
    filled = np.array([counts.get(c, 0) for c in range(len(centres))])

    def probing(batches: Iterator) -> Iterator:
        for b in batches:
            if b.num_rows:
                near = unit(np.stack(b.column("v").to_numpy(zero_copy_only=False))) @ shared.value.T
                order = np.argsort(-near, axis=1, kind="stable")
                enough = (np.cumsum(filled[order], axis=1) <= k).sum(axis=1) + 1  # lists until k and the query itself are in
                chosen = [o[: max(probes, e)].astype(np.int32) for o, e in zip(order, enough.tolist(), strict=True)]
                yield b.select(["vec_id", "v"]).append_column("lists", pa.array(chosen, pa.list_(pa.int32())))

    asked = kept(
        indexed.where("asks")
        .select("vec_id", "v")
        .mapInArrow(probing, "vec_id long, v array<double>, lists array<int>")
    )
    wanted = {r["list"]: r["n"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(c, max(1, ceil(m / CELL)), max(1, ceil(wanted.get(c, 0) / CELL))) for c, m in sorted(counts.items())], "list int, cells int, parts int"
    )
    left = indexed.join(F.broadcast(plan), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v"
    )
    right = asked.select("vec_id", "v", F.explode("lists").alias("list")).join(F.broadcast(plan), "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v"
    )

    def cell(vectors: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(vectors) or not len(questions):
            return empty
        ids, asking = vectors["vec_id"].to_numpy(), questions["vec_id"].to_numpy()
        j, i, score = scan_cell(ids, np.stack(vectors["v"].to_numpy()), asking, np.stack(questions["v"].to_numpy()), k)
        return pd.DataFrame({"query_id": asking[j], "vec_id": ids[i], "score": score})

    keys = ["list", "cell", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
