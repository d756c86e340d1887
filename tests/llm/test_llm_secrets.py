from collections import Counter

import numpy as np
import pytest
from marginalia.llm import secrets
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Row


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(1)
    parts = ["er", "en", "the", "ing", "ach", "lich", "tion", "on", "ver", "que"]
    return Counter({"".join(rng.choice(parts, rng.integers(2, 4))): int(rng.integers(2, 90)) for _ in range(500)})


@pytest.fixture(scope="module")
def model(spark, words):
    rows = secrets.planted(np.random.default_rng(3), list(words), ["a/b", None], 3000)
    return secrets.fit(spark, rows, words)


def test_held_out_findings(model, words):
    rows = secrets.planted(np.random.default_rng(99), list(words), ["a/b", None], 1500)
    x = np.array([model.features(r.value, r.before, r.after, r.path) for r in rows])
    assert x.shape[1] == len(secrets.FEATURES)
    guess = model.probability(x) >= secrets.THRESHOLD
    assert np.mean(guess == np.array([r.label for r in rows])) > 0.95


def test_trees_as_arrays_score_as_the_forest_does(spark, model, words):
    rows = secrets.planted(np.random.default_rng(7), list(words), [None], 300)
    x = np.array([model.features(r.value, r.before, r.after, r.path) for r in rows])
    table = spark.createDataFrame([Row(label=float(r.label), features=Vectors.dense(v)) for r, v in zip(rows, x.tolist(), strict=True)])
    forest = RandomForestClassifier(numTrees=7, maxDepth=5, seed=1).fit(table)
    own = secrets.Model(set(), model.transitions, {}, {}, [secrets._flat(t) for t in forest.trees])
    want = [r.probability[1] for r in forest.transform(table).collect()]
    assert own.probability(x) == pytest.approx(want)


def test_scan_masks_what_it_finds(spark, model):
    key = "9f8a77c1d2e3b4a5968778695a4b3c2d1e0f9a8b"
    docs = spark.createDataFrame(
        [(1, f'the token = "{key}" ends, token = "{key}"', "s"), (2, "call 4539488012345678 now", "s"), (3, "nothing", None)],
        "doc_id long, text string, source string",
    )
    got = {r.doc_id: r for r in secrets.scan(docs, model).collect()}
    assert got[1].redacted == 'the token = "[SECRET]" ends, token = "[SECRET]"'
    assert [got[1].text[s.start : s.end] for s in got[1].secrets] == [key, key]
    assert got[2].redacted == got[2].text and got[2].n_candidates == 1
    assert got[3].n_candidates == 0 and got[3].top_score == 0.0


def test_awkward_rows(awkward, nothing):
    names = ("sec_n", "sec", "sec_top", "sec_text")
    model = secrets.fit_on(awkward)
    rows = secrets.scan(awkward, model, names=names).collect()
    assert len(rows) == awkward.count()
    planted = [r for r in rows if "token = " in (r.text or "")]
    assert planted and all("[SECRET]" in r.sec_text for r in planted)
    assert all(r.sec_text == r.text for r in rows if not r.sec)
    assert secrets.scan(nothing, model, names=names).count() == 0
    assert secrets.scan(awkward, secrets.fit_on(nothing), names=names).count() == len(rows)


def test_candidates_in_long_texts():
    assert secrets.candidates("a" * 200_000) == []
    assert len(secrets.candidates("k9" * 100_000)) == 1
    assert secrets.candidates(None) == secrets.candidates("") == []
    assert secrets.candidates('password: "hunterhunter"') == [(11, 23)]


def test_words_are_counted_over_all_documents(spark):
    rows = [(k, f"common words everywhere and quxword{chr(97 + k % 26)}{chr(97 + k // 26)} quxword{chr(97 + k % 26)}{chr(97 + k // 26)}", "s") for k in range(300)]
    model = secrets.fit_on(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=5)
    assert sum(w.startswith("quxword") for w in model.dictionary) == 300
    row = model.transitions[ord("q")]
    assert row.argmax() == ord("u") and row[ord("u")] > np.log(0.6)


def test_short_and_odd_passwords(spark, model, words):
    a, b, c = [w for w in words if 8 <= len(w) <= 14][:3]
    texts = {
        "password=hunter2024 here": "hunter2024", 'password: "Tr0ub4dor&3" and': "Tr0ub4dor&3", "pwd = p@ssw0rd!23, then": "p@ssw0rd!23",
        "see https://user:s3cr3t!pw9@host.example/x": "s3cr3t!pw9",
    }
    clean = [f"password: {a}", f"the key: {b}", f'token = "{c}"', "at https://host.example:8080/a@b", f"password: ${{{a.upper()}}}"]
    rows = [(k, t, "a/b") for k, t in enumerate([*texts, *clean])]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), model).collect()}
    for k, (t, value) in enumerate(texts.items()):
        assert [t[s:e] for s, e in secrets.candidates(t)] == [value]
        assert got[k].redacted == t.replace(value, "[SECRET]"), t
    assert [got[len(texts) + k].redacted for k in range(len(clean))] == clean


def test_named_candidates_in_long_texts():
    for unit in ("key=", "key", "pass:", "://a:", "token ", "://", "a:", "passwd-"):
        secrets.candidates(unit * 100_000)
    found = secrets.candidates('{"api_key": "9f8a77c1d2e3b4a59687", "ref": "abcdefghijk1"}')
    assert [b - a for a, b in found] == [20, 12]
