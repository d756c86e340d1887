import zlib

import numpy as np
import pytest
from marginalia.llm import toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    words, bad = [f"w{k}" for k in range(400)], ["idiot", "scum", "moron", "trash"]
    rows, labels = [], []
    for i in range(900):
        own = rng.choice(words, 40).tolist()
        toxic = i % 6 == 0
        if toxic:
            own += rng.choice(bad, 3).tolist()
        rows.append((i, " ".join(rng.permutation(own)), toxic))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth boolean")
    labels = spark.createDataFrame(labels + [(3, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_documents(fitted):
    docs, _, model = fitted
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200
    assert np.mean([r.predicted == r.truth for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    used = {int(i) for i in model.ids}
    assert not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in used)


def test_search_is_exact(fitted):
    _, _, model = fitted
    rng = np.random.default_rng(2)
    names = list(model.words)
    dense = np.zeros((len(model.labels), len(names)))
    for w in range(len(names)):
        s = slice(model.starts[w], model.starts[w + 1])
        dense[model.rows[s], w] = model.weights[s]
    for _ in range(60):
        text = b" ".join(rng.choice(names, rng.integers(1, 12))).decode()
        at, x = model.vector(text)
        found, cosines = model.nearest(at, x)
        scores = np.minimum(dense[:, at] @ x, 1).round(9)
        want = [r for r in np.lexsort((np.arange(len(scores)), -scores))[: toxicity.NEIGHBOURS] if scores[r] > 0]
        assert found.tolist() == want
        assert cosines == pytest.approx(scores[want])


def test_every_word_counts(fitted):
    """No word of an example is left out: a text of clean words alone has neighbours, and class weights are bounded."""
    _, _, model = fitted
    assert {f"w{k}".encode() for k in range(400)} <= set(model.words)
    found, cosines = model.nearest(*model.vector("w1 w2 w3 w4 w5"))
    assert len(found) == toxicity.NEIGHBOURS and (cosines > 0).all()
    weights = toxicity._class_weights(3, [(0, 1, np.array([0, 1]), None), (1, 0, np.array([1, 2]), None), (2, 0, np.array([1, 2]), None)], [7, 8, 8])
    assert weights[0] > weights[1] > weights[2] == 1
    assert weights.max() <= 1 + toxicity.CLASS_WEIGHT


def test_the_whole_text_counts_in_the_length(fitted):
    _, _, model = fitted
    near = [model.nearest(*model.vector("idiot" + " ".join(["", *(f"w{k}" for k in range(n))])))[1][0] for n in (0, 100, 400)]
    assert near[0] > near[1] and near[0] > 1.5 * near[2]


def test_examples_within_a_bound_of_postings(fitted):
    docs, labels, _ = fitted
    small = toxicity.fit(docs, labels, max_examples=200, max_postings=3000)
    assert 0 < len(small.labels) <= 200 and 2900 < len(small.rows) <= 3000


def test_labels_of_held_out_rows_play_no_part(fitted):
    docs, labels, model = fitted
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert again.words == model.words and np.array_equal(again.labels, model.labels)


def test_awkward_rows(awkward, nothing, spark, fitted):
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 100)], "doc_id long, toxic int")
    names = ("tox_score", "tox", "tox_evidence")
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, model, names=names).collect()
    assert len(rows) == awkward.count()
    assert all(r.tox == (r.tox_score >= 0.7) for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.tox_score) == r.tox_score  # copies score alike
    assert toxicity.score(nothing, model, names=names).count() == 0
    for empty in (labels.where("false"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        bare = toxicity.fit(awkward, empty)
        assert all(r.tox_score <= 0.5 for r in toxicity.score(awkward, bare, names=names).collect())
    assert toxicity.fit(nothing, labels).words == {}
