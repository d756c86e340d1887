import random

import pyarrow as pa
import pytest
from marginalia.functions.chunks import Lexer
from marginalia.operators import files, large_files
from marginalia.rules import CommentRules, JobConfig, PathRules
from pyspark.sql import functions as F

RULES = [
    CommentRules.parse(["/*...*/"], ["/**...*/"], ["//"], ["//:", "//*"]),
    CommentRules.parse(["<!--...-->", "{...}"], [], ["#"], []),
]
ALPHABET = ["/*", "*/", "/**", "//", "//:", "<!--", "-->", "{", "}", "#", '"', '"""', "\\", "\n", " ", "\t", "a", "b ", "\r\n", "é", "  "]


def rows_of(frame):
    return sorted(tuple(r) for r in files.flatten(frame).collect())


@pytest.mark.parametrize("rules", RULES)
@pytest.mark.parametrize("size", [1, 3, 7])
def test_chunks_give_what_the_whole_text_gives(spark, rules, size):
    rng = random.Random(size)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, text string").select(F.col("n").cast("string").alias("path"), "text").repartition(5)
    chunks = large_files.cut_texts(frame, rules, size)
    whole = chunks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), "").alias("text"))
    assert sorted(map(tuple, whole.collect())) == sorted((str(k), t) for k, t in enumerate(texts))
    want = rows_of(files.find_occurrences(frame, rules))
    assert len(want) > 100
    assert rows_of(large_files.find_occurrences(chunks, rules)) == want


def test_transitions_are_what_a_walk_gives():
    rng = random.Random(2)
    for rules in RULES:
        lexer = Lexer(rules)
        for _ in range(2000):
            text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 25)))
            for state, step in enumerate(lexer.transition(text)):
                walk = list(lexer.walk(text, 0, state))
                assert step == 2 * walk[-1][2] + (state > 0 and len(walk) > 1)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    body = "".join(f"val x{k} = \"// no\" // é {k}\n" + ("/* open\n" * 30 + "*/\n" if k % 50 == 0 else "") for k in range(4000))
    (tmp_path / "Large.kt").write_text(body, encoding="utf-8")
    (tmp_path / "Small.kt").write_text("// one\n\n// two", encoding="utf-8")
    (tmp_path / "Empty.kt").write_text("")
    (tmp_path / "Other.txt").write_text("// no")
    config = JobConfig(str(tmp_path), "", RULES[0], PathRules(), (".kt",))
    chunks = large_files.read_chunks(spark, str(tmp_path), config, size=4096)
    assert chunks.where("path like '%Large.kt'").select(F.spark_partition_id()).distinct().count() > 4
    assert chunks.agg(F.max(F.length("text"))).first()[0] < 5000
    whole = spark.createDataFrame([(str(tmp_path / "Large.kt"), body), (str(tmp_path / "Small.kt"), "// one\n\n// two")], "path string, text string")
    assert rows_of(large_files.find_occurrences(chunks, RULES[0])) == rows_of(files.find_occurrences(whole, RULES[0]))


def test_an_occurrence_over_many_chunks_and_one_that_never_ends(spark):
    long = "/* " + "word\n" * 4000 + "*/"
    texts = [long, f"x {long} // y\n \n{long} z", long[:-2], f'"{long}', f"// a\n{long[:-2]}", " " * 500 + "// a" + "\n" * 500 + "// b"]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "n long, text string").select(F.col("n").cast("string").alias("path"), "text")
    assert rows_of(large_files.find_occurrences(large_files.cut_texts(frame, RULES[0], 100), RULES[0])) == rows_of(files.find_occurrences(frame, RULES[0]))


def test_no_texts(spark):
    nothing = spark.createDataFrame([], "path string, text string")
    assert large_files.find_occurrences(large_files.cut_texts(nothing, RULES[0]), RULES[0]).count() == 0


def test_many_small_files_are_no_groups_or_batches_of_their_own(spark, monkeypatch):
    texts = [(str(k), f"a /* {k} */ b // c\n" * 3) for k in range(300)]
    chunks = large_files.cut_texts(spark.createDataFrame(texts, "path string, text string"), RULES[0], 10)
    monkeypatch.setattr(large_files, "kept", lambda frame: frame)
    plan = large_files.find_occurrences(chunks, RULES[0])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert "FlatMapGroups" not in plan
    assert "BroadcastHashJoin" not in plan  # neither side of the chunks' join is known to be small
    kinds = [pa.string(), pa.string()]
    sizes = [b.num_rows for b in large_files._batches(((p, t) for p, t in texts * 100), ["path", "text"], kinds, 1)]
    assert sum(sizes) == 30_000
    assert len(sizes) <= 5
    long = [b.num_rows for b in large_files._batches((("p", "x" * (1 << 21)) for _ in range(5)), ["path", "text"], kinds, 1)]
    assert long == [2, 2, 1]


def test_states_of_a_file_whose_rows_come_in_several_batches(spark):
    text = "x /* a\n" * 40 + "*/ y // z"
    frame = spark.createDataFrame([(str(k), text) for k in range(5)], "path string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = rows_of(large_files.find_occurrences(large_files.cut_texts(frame, RULES[0], 20), RULES[0]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == rows_of(files.find_occurrences(frame, RULES[0]))
