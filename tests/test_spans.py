import brute
import pytest
from pyspark.sql import functions as F

from marginalia.functions import spans

CASES = {
    "one pair": ({"<": [">"]}, ["<", ">", "a", "\n", " "], False),
    "several ends": ({"<<": ["]]", "]"], "<": [">", "/>"]}, ["<", ">", "]", "/", "a"], False),
    "first listed wins": ({"<": [">"], "<!": ["!>"]}, ["<", "!", ">", "a"], False),
    "longer listed first": ({"<!": ["!>"], "<": [">"]}, ["<", "!", ">", "a"], False),
    "ignore case": ({"<b>": ["</b>", "<Br>"], "[Q": ["q]"]}, ["<b>", "<B>", "</B>", "</b>", "<bR>", "[q", "[Q", "Q]", "q]", "x", "é"], True),
    "astral": ({"😀": ["😁"]}, ["😀", "😁", "x", "😂"], False),
    "overlapping tags": ({"<!--": ["-->"]}, ["<!--", "-->", "<!", "-", ">", "x"], False),
}


@pytest.mark.parametrize("name", CASES)
def test_spans_match_brute_force(spark, name):
    pairs, alphabet, ignore_case = CASES[name]
    fold = str.lower if ignore_case else str
    texts = brute.random_texts(1500, alphabet, longest=14)
    rows = (
        spark.createDataFrame([(t,) for t in texts], "text string")
        .select(
            "text",
            spans.extract_spans(F.col("text"), pairs, ignore_case).alias("found"),
            spans.strip_spans(F.col("text"), pairs, ignore_case).alias("stripped"),
            spans.mask_spans(F.col("text"), pairs, "#", ignore_case).alias("masked"),
        )
        .collect()
    )
    for row in rows:
        assert [tuple(f) for f in row.found] == brute.spans(row.text, pairs, fold), row.text
        assert row.stripped == brute.stripped(row.text, pairs, fold), row.text
        assert row.masked == brute.masked(row.text, pairs, "#", fold), row.text
        assert len(row.masked) == len(row.text)


def test_end_tag_stays_when_stripping(spark):
    row = spark.createDataFrame([("a<b>c",)], "t string").select(spans.strip_spans(F.col("t"), {"<": ">"})).first()
    assert row[0] == "a>c"


def test_a_mask_is_one_character():
    for mask in ("", "##"):
        with pytest.raises(ValueError, match="one character"):
            spans.mask_spans(None, {"<": ">"}, mask)


def test_tags_that_would_never_end_are_refused():
    for pairs in ({"'": "'"}, {"<": "</"}, {"<<": "<"}):
        with pytest.raises(ValueError):
            spans.strip_spans(None, pairs)
    with pytest.raises(ValueError):
        spans.extract_spans(None, {"": ">"})
