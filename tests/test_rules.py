import pytest
from pyspark.sql import functions as F

from marginalia.operators import rule_tables
from marginalia.rules import CommentRules, JobConfig, PathRule, PathRules, RuleError, parse_block, parse_ending

PATTERNS = {
    "hello": ("hello", "EXACT"),
    "hello*": ("hello", "STARTS_WITH"),
    "*hello": ("hello", "ENDS_WITH"),
    "*hello*": ("hello", "CONTAINS"),
    "*": ("", "CONTAINS"),
    "**": ("", "CONTAINS"),
    "": None,
    "hel*lo": None,
    "*h*ello": None,
    "h*ello*": None,
    "***": None,
    "x**": None,
    "**x": None,
    "*a*b*": None,
    "a\nb*": ("a\nb", "STARTS_WITH"),
}


def test_patterns(spark):
    for pattern, expected in PATTERNS.items():
        if expected is None:
            with pytest.raises(RuleError):
                PathRule.parse(pattern)
        else:
            assert PathRule.parse(pattern) == PathRule(*expected)
    frame = spark.createDataFrame([("EXCLUDE", p) for p in PATTERNS], "include_exclude string, pattern string")
    rows = rule_tables.parse_patterns(frame, strict=False).collect()
    assert {r.pattern: (r.filter_text, r.match_type) if r.match_type else None for r in rows} == PATTERNS


def test_refused_patterns_fail_the_job(spark):
    for action, pattern in (("EXCLUDE", "a*b"), ("INCLUDE", "plain")):
        frame = spark.createDataFrame([(action, pattern)], "include_exclude string, pattern string")
        with pytest.raises(Exception, match="path pattern not allowed"):
            rule_tables.parse_patterns(frame).collect()
    with pytest.raises(RuleError):
        PathRules.parse(["src"])
    assert PathRules.parse(["a\\b*"], ["plain"]).include == (PathRule("a/b", "STARTS_WITH"),)


def test_endings(spark):
    expected = {"*.kt": ".kt", "*": "", ".meta": None, ".meta*": None, "*.m*": None, "*.m*e": None, "": None}
    for pattern, ending in expected.items():
        if ending is None:
            with pytest.raises(RuleError):
                parse_ending(pattern)
        else:
            assert parse_ending(pattern) == ending
    frame = spark.createDataFrame([(p,) for p in expected], "p string")
    rows = frame.select("p", rule_tables.parse_ending(F.col("p")).alias("e")).collect()
    assert {r.p: r.e for r in rows} == expected


def test_blocks(spark):
    expected = {"/*...*/": ("/*", "*/"), "/**...*/": ("/**", "*/"), "/*": None, "a...b...c": None, "/*...": ("/*", "")}
    for rule, tags in expected.items():
        if tags is None:
            with pytest.raises(RuleError):
                parse_block(rule)
        else:
            assert parse_block(rule) == tags
    frame = spark.createDataFrame([(r,) for r in expected], "r string")
    rows = frame.select("r", rule_tables.parse_block(F.col("r")).alias("t")).collect()
    assert {r.r: tuple(r.t) if r.t else None for r in rows} == expected


def test_start_tags_must_be_unique(spark):
    for lists in (
        {"remove_blocks": ["/*...*/", "/*...;"]},
        {"remove_blocks": ["/*...*/"], "keep_blocks": ["/*...x"]},
        {"remove_lines": ["//"], "keep_lines": ["//"]},
        {"remove_blocks": ["//...x"], "remove_lines": ["//"]},
    ):
        with pytest.raises(RuleError, match="unique"):
            CommentRules.parse(**lists)
    blocks = spark.createDataFrame([("remove", "/*", "*/"), ("keep", "/**", "*/")], "action string, start_tag string, end_tag string")
    lines = spark.createDataFrame([("remove", "//"), ("keep", "/*")], "action string, start_tag string")
    united = rule_tables.unite_rules(blocks, lines)
    assert {r.end_tag for r in united.where("start_tag = '//'").collect()} == {"\n"}
    assert [(r.start_tag, r["count"]) for r in rule_tables.duplicate_start_tags(united).collect()] == [("/*", 2)]


def test_strict_parsing_fails_the_job(spark):
    for parse, bad, good in ((rule_tables.parse_ending, ".meta", "*.md"), (rule_tables.parse_block, "a...b...c", "a...b")):
        assert spark.createDataFrame([(good,)], "r string").select(parse(F.col("r"), strict=True)).first()[0] is not None
        for rule in (bad, None):
            with pytest.raises(Exception, match="not allowed"):
                spark.createDataFrame([(rule,)], "r string").select(parse(F.col("r"), strict=True)).collect()


def test_comment_rules_from_a_table(spark):
    schema = "action string, start_tag string, end_tag string"
    rows = [("remove", "/*", "*/"), ("keep", "/**", "*/"), ("remove", "//", "\n")]
    got = rule_tables.comment_rules(spark.createDataFrame(rows, schema))
    assert set(got.remove) == {("/*", "*/"), ("//", "\n")} and got.keep == (("/**", "*/"),)
    for bad in (("drop", "x", "y"), ("remove", None, "y"), ("remove", "x", None), ("keep", "//", "z"), ("keep", "", "z")):
        with pytest.raises(RuleError):
            rule_tables.comment_rules(spark.createDataFrame([*rows, bad], schema))
    with pytest.raises(RuleError, match="more than 2"):
        rule_tables.comment_rules(spark.createDataFrame(rows, schema), most=2)


def test_config():
    config = JobConfig.parse(
        "file:/users/a\\b/", "/archive/", ["\\src\\*"], ["*.kt"], ["*gen*"], remove_lines=["//"], keep_blocks=["/**...*/"]
    )
    assert config.source_root == "file:/users/a/b" and config.base == "/users/a/b" and config.archive_root == "/archive"
    assert config.paths.include == (PathRule("/src/", "STARTS_WITH"),)
    assert config.comments == CommentRules((("//", "\n"),), (("/**", "*/"),))
    for missing in ({"include": []}, {"endings": []}, {"source_root": ""}, {"archive_root": ""}):
        with pytest.raises(RuleError):
            JobConfig.parse(**{"source_root": "/s", "archive_root": "/a", "include": ["*"], "endings": ["*"], **missing})
