import re
from collections import Counter

import duckdb
import pytest
from marginalia.llm import phrases, queries


def plain(rows, least=10, held=50, top=2000):
    """Phrases of (text, lang) rows, straight from the definition."""
    langs = {}
    for text, lang in rows:
        raw = (text or "").encode("utf-8").lower()
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", raw):
            words = [w.decode() for w in re.split(rb"[\x20\x09]+", piece) if w]
            counts = langs.setdefault(lang or "und", Counter())
            for n in (1, 2, 3):
                counts.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in langs.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        found = []
        for g, a in counts.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(100 * f >= held * a for x, f in counts.items() if len(x) == 3 and f >= least and g in (x[:2], x[1:])):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_awkward_rows(awkward):
    want = plain([(r.text, r.lang) for r in awkward.select("text", "lang").collect()])
    assert len(want) > 50
    assert rows_of(phrases.collocations(awkward)) == want


def test_runs_and_buckets_of_any_size(awkward):
    """Many small runs, and buckets that part the grams of one word."""
    want = plain([(r.text, r.lang) for r in awkward.select("text", "lang").collect()], least=5, held=30, top=40)
    assert rows_of(phrases.collocations(awkward.repartition(9), least=5, held=30, top=40, run_bytes=500, bucket_bytes=3000)) == want


def test_ranges_cut_between_the_grams_of_a_word(spark):
    """One word that begins and ends nearly all phrases, over many ranges."""
    text = ". ".join(f"the w{i % 40} the v{i % 23} the" for i in range(4000))
    frame = spark.createDataFrame([(text, "en"), (text.replace("w1", "x\x01"), "en"), ("the the the the", None), ("a\tb  c", "und")], "text string, lang string")
    kept_partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(phrases.collocations(frame)) == plain([(r.text, r.lang) for r in frame.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept_partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_vocabularies_take_the_other_sort():
    import numpy as np

    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 5, 300) for _ in range(3)]
    counts = rng.integers(1, 9, 300)
    for own in (None, counts):
        small, large = phrases._tally(columns, own, 6), phrases._tally(columns, own, 1 << 22)
        assert all((a == b).all() for a, b in zip(small, large, strict=True))


def test_empty_table(nothing):
    assert phrases.collocations(nothing).count() == 0


def test_against_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(connection.execute(queries.ORACLES["op11_phrases"]).fetchall())
    assert rows_of(queries.op11_phrases(spark, sf_dir)) == want


@pytest.mark.parametrize("text", [None, "", " \t\n.,;", "one"])
def test_texts_without_phrases(text):
    assert [len(p) for p in phrases.pieces_of(text)] == ([1] if text == "one" else [])
