from collections import defaultdict

import pytest
from marginalia.llm import lines
from pyspark.sql import functions as F


def plain(rows, min_sites):
    sites, owner = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            b = line.strip(" \t\r")
            if b and site is not None:
                sites[b].add(site)
                if i is not None:
                    owner[b] = min(i, owner.get(b, i))
    gone = {b for b, s in sites.items() if len(s) >= min_sites}
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None))
            continue
        out.append((i, "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in gone or (i is not None and owner.get(x.strip(" \t\r")) == i))))
    return out


@pytest.mark.parametrize("min_sites", [3, 10])
def test_awkward_rows(awkward, min_sites):
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    cleaned = lines.remove_spread_lines(awkward, min_sites=min_sites)
    assert cleaned.columns == awkward.columns
    got = [(r.doc_id, r.text) for r in cleaned.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, min_sites)))


def test_counts_and_sketch_far_from_the_threshold(spark):
    rows = [(k, f"everywhere\n only {k}\n\tsome\r" if k % 40 == 0 else f"everywhere\nonly {k}", f"s{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.remove_spread_lines(docs, min_sites=20, counts=("n", "out")).orderBy("doc_id").collect()
    assert [r.text for r in got[:2]] == [rows[0][1], "only 1"]
    assert [(r.n, r.out) for r in got[:2]] == [(3, 0), (2, 1)]
    assert sum(r.out for r in got) == 399


def test_shuffled_joins_give_the_same(awkward, monkeypatch):
    want = sorted(map(str, lines.remove_spread_lines(awkward).select("doc_id", "text").collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    monkeypatch.setattr(lines, "BROADCAST_POSITIONS", 0)
    assert sorted(map(str, lines.remove_spread_lines(awkward).select("doc_id", "text").collect())) == want


def test_empty_table_and_nulls_only(nothing, awkward):
    assert lines.remove_spread_lines(nothing).count() == 0
    bare = awkward.limit(5).withColumn("text", F.lit(None).cast("string"))
    assert [r.text for r in lines.remove_spread_lines(bare).collect()] == [None] * 5


def test_native_plan(awkward):
    plan = lines.remove_spread_lines(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_long_passages_go_from_two_sites_on(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    once = " ".join(f"v{k}" for k in range(60))
    short = " ".join(f"u{k}" for k in range(50))
    copy = " ".join(f"x{k}" for k in range(60))
    rows = [(1, f"{passage}\none\n{short}", "a"), (2, f"two\n {passage}\r\n{short}", "b"), (3, f"{passage}\none\n{short}", "c")]
    rows += [(4, once, "a"), (5, f"{once}\nmore", "a"), (6, copy, "a"), (7, copy, "b"), (None, passage, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in lines.remove_spread_lines(docs, long_words=50).collect()]
    want = [(i, {2: f"two\n{short}", None: ""}.get(i, x)) for i, x, _ in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert lines.remove_spread_lines(docs).where("doc_id = 2").first().text == rows[1][1]
