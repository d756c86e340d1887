import numpy as np
import pytest
from marginalia.llm import ann
from pyspark.sql import functions as F


def brute(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for j in np.flatnonzero(ids % every == 0):
        s = u @ u[j]
        s[j] = -np.inf
        out[int(ids[j])] = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 12)))][: min(k, len(ids) - 1)]]
    return out


def found(table, every=50):
    out = {}
    for r in ann.nearest(table, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_recall_on_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in table.collect()]), found(table)
    assert want.keys() == got.keys()
    assert all([r["rank"] for r in g] == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len(set(want[q]) & {r.vec_id for r in g}) for q, g in got.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_scores_ties_and_cells(spark, monkeypatch):
    """Many copies of one vector, cut into cells: ties go to the smaller id."""
    monkeypatch.setattr(ann, "CELL", 32)
    rng = np.random.default_rng(3)
    one = rng.normal(size=24)
    rows = [(k, (one * 2.0 ** (k % 4)).tolist()) for k in range(300)] + [(300 + k, rng.normal(size=24).tolist()) for k in range(200)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100)
    assert [r.vec_id for r in got[0]] == [1, 2, 3, 4, 5]
    assert [r.vec_id for r in got[200]] == [0, 1, 2, 3, 4]
    assert all(abs(r.score - 1) < 1e-12 for r in got[0])


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (100, None)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, list string")
    got = {q: [(r.vec_id, round(r.score, 6)) for r in g] for q, g in found(table).items()}
    assert got == {0: [(1, 1.0), (50, 0.707107)], 50: [(0, 0.707107), (1, 0.707107)]}
    assert ann.nearest(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(table.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(800, 64)), rng.normal(size=(20, 64))
    j, i, s = ann.scan_cell(np.arange(800), x, np.arange(1000, 1020), q, 5)
    want = (x @ q.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(q, axis=1)
    best = np.argsort(-want, axis=0)[:5]
    assert np.mean([len(set(best[:, k]) & set(i[j == k])) for k in range(20)]) >= 4.8
    assert s == pytest.approx(want[i, j])
