"""Scan and rewrite against a character-by-character statement, on random texts."""

import brute
import pytest
from pyspark.sql import functions as F

from marginalia.functions import rewrite, scan
from marginalia.rules import CommentRules

CODE = CommentRules.parse(["/*...*/"], ["/**...*/"], ["//"], ["//:", "//*"])
CODE_ALPHABET = ["/*", "*/", "//", "\n", "\r\n", '"', '"""', "\\", " ", "\t", "/**", "//:", "//*", "*", ":", "a", "/"]

CASES = {
    "code": (CODE, CODE_ALPHABET),
    "exotic white space": (CODE, [*CODE_ALPHABET, " ", " ", "\x0c", "　", "\x1f", "\x85"]),
    "markup": (CommentRules.parse(["<!--...-->", "{{...}}"], ["<!---...--->"]), ["<!--", "-->", "<!---", "--->", "{{", "}}", "-", ">", "{", "}", '"', " ", "\n", "x"]),
    "hash": (CommentRules.parse(remove_lines=["#"], keep_lines=["#!"]), ["#", "#!", "!", "\n", "\r\n", " ", '"', "\\", "é"]),
    "blank tags": (CommentRules.parse(["\t;...;"], [" ;;...;"], [" #"], ["#!"]), [" #", "#!", "\t;", ";", ";;", " ", "\n", "\t", "x", '"']),
    "quote removed": (CommentRules((('"', '"'), ("%", "\n")), (("%%", "%"),)), ['"', "%", "%%", "\n", " ", "x", '"""']),
    "astral": (CommentRules.parse(["😀...😁"], remove_lines=["é"]), ["😀", "😁", "é", "\n", " ", "x", "😂"]),
    "many rules": (
        CommentRules.parse([f"<{i}...>" for i in range(40)], [f"<{i}x...>" for i in range(40)], [f"#{i}" for i in range(40)]),
        ["<1", "<12", "<12x", ">", "#3", "#34", "\n", " ", "x", '"'],
    ),
    "empty end": (CommentRules((("@", ""), ("#", "\n")), ()), ["@", "#", "\n", " ", "x"]),
}


@pytest.mark.parametrize("name", CASES)
def test_scan_and_rewrite_match_brute_force(spark, name):
    rules, alphabet = CASES[name]
    texts = brute.random_texts(2500, alphabet)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    rows = (
        frame.select("text", scan.segments(F.col("text"), rules).alias("segments"))
        .select(
            "text",
            "segments",
            scan.occurrences(F.col("segments")).alias("items"),
            scan.occurrence_count(F.col("segments")).alias("count"),
            rewrite.cleaned(F.col("segments")).alias("cleaned"),
        )
        .withColumn("one_by_one", rewrite.remove_comments(F.col("text"), F.col("items")))
        .collect()
    )
    assert len(rows) == len(texts)
    hits = 0
    for row in rows:
        expected = brute.occurrences(row.text, rules.remove, rules.keep)
        got = [(o.pos.first, o.pos.last, o.lines.first, o.lines.last, o.comment_text) for o in row["items"]]
        assert got == expected, row.text
        assert "".join(row.segments) == row.text
        assert row["count"] == len(expected)
        result = brute.cleaned(row.text, expected)
        assert row.cleaned == result, (row.text, got)
        assert row.one_by_one == result, (row.text, got)
        hits += len(expected)
    assert hits > 500


def test_long_texts_do_not_exhaust_the_stack(spark):
    texts = [
        '"' + "\\x" * 200_000 + '" /*' + "*a" * 200_000 + "*/ b",
        "//x\n" * 200_000,
        "a //x\n" * 20_000 + "/* open",
        "//: keep\n" * 100_000 + "/*" * 100_000,
        "/**/" * 100_000,
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(5)
    rows = (
        frame.select("id", scan.segments(F.col("text"), CODE).alias("s"))
        .select("id", scan.occurrences(F.col("s")).alias("items"), rewrite.cleaned(F.col("s")).alias("cleaned"))
        .collect()
    )
    for row in rows:
        expected = brute.occurrences(texts[row.id], CODE.remove, CODE.keep) if row.id != 2 else None
        if expected is not None:
            assert [(o.pos.first, o.pos.last) for o in row["items"]] == [e[:2] for e in expected]
        else:
            assert [o.pos.first for o in row["items"]] == [6 * i + 2 for i in range(20_000)]
            assert [o.lines.first for o in row["items"]] == list(range(1, 20_001))
            assert row.cleaned == "a\n" * 20_000 + "/* open"
