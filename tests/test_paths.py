import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import paths
from marginalia.operators import rule_tables
from marginalia.rules import PathRule, PathRules


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


HOLDS = {
    "EXACT": lambda path, text: path == text,
    "STARTS_WITH": str.startswith,
    "ENDS_WITH": str.endswith,
    "CONTAINS": lambda path, text: text in path,
}


def random_cases(seed, files, rules):
    """Paths and rules over a small alphabet, so that rules match often."""
    rng = random.Random(seed)
    text = lambda low, high: "".join(rng.choices("ab/é_", k=rng.randint(low, high)))
    return sorted({text(0, 9) for _ in range(files)}), [PathRule(text(0, 4), rng.choice(list(HOLDS))) for _ in range(rules)]


def passing(path, rules):
    hit = lambda some: any(HOLDS[r.match_type](path, r.filter_text) for r in some)
    return (not rules.include or hit(rules.include)) and not hit(rules.exclude)


@pytest.mark.parametrize("n", [0, 1, 9, 300])
def test_predicates_follow_the_rule(spark, n):
    """Includes, excludes and any-of for any number of rules, below a base."""
    files, rules = random_cases(n, 200, n)
    included, excluded = rules[::2], rules[1::2]
    p = F.col("p")
    got = values(
        spark,
        [("/base" + f,) for f in files],
        "p string",
        paths.passes(p, "/base", PathRules(tuple(included), ())),
        paths.passes(p, "/base", PathRules((), tuple(excluded))),
        paths.passes(p, "/base", PathRules(tuple(included), tuple(excluded))),
        paths.matches_any(paths.below(p, "/base"), rules),
    )
    for f, row in zip(files, got, strict=True):
        assert row == (
            passing(f, PathRules(tuple(included), ())),
            passing(f, PathRules((), tuple(excluded))),
            passing(f, PathRules(tuple(included), tuple(excluded))),
            any(HOLDS[r.match_type](f, r.filter_text) for r in rules),
        )


def test_plain_predicates_for_any_number_of_rules(spark, tmp_path):
    spark.range(5).selectExpr("string(id) as p").write.parquet(str(tmp_path / "t"))
    rules = [PathRule(f"n{k}", "CONTAINS") for k in range(200)]
    frame = spark.read.parquet(str(tmp_path / "t")).where(paths.matches_any(F.col("p"), rules))
    assert "exists(" not in frame._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == 0


def test_endings(spark):
    p = F.col("p")
    columns = [paths.ends_with_any(p, []), paths.ends_with_any(p, ["x", "LO"]), paths.ends_with_any(p, ["x", "LO"], ignore_case=True)]
    assert values(spark, [("solo",), ("solO",), ("box",)], "p string", *columns) == [(False, False, True), (False, False, True), (False, True, True)]


def test_a_path_outside_the_base_fails_the_job(spark):
    frame = spark.createDataFrame([("/else/x",)], "p string")
    with pytest.raises(Exception, match="path not below"):
        frame.select(paths.below(F.col("p"), "/base")).collect()
    assert values(spark, [(None,), ("/base",)], "p string", paths.below(F.col("p"), "/base")) == [(None,), ("",)]


def test_projections(spark):
    p = F.col("p")
    for base in ("/data/corpus/", "/data/corpus"):
        assert values(spark, [("/data/corpus/de/17.md",)], "p string", paths.relative(p, base)) == [("de/17.md",)]
    got = values(spark, [("C\\x\\y.txt",)], "p string", paths.relative(p, "C"), paths.forward_slashes(p))
    assert got == [("x\\y.txt", "C/x/y.txt")]
    names = ["report.md", "report.v2.md", "report", "end.", ".rc", "", "a..", "."]
    got = values(spark, [(n,) for n in names], "p string", paths.stem(p), paths.extension(p))
    assert got == [("report", "md"), ("report.v2", "md"), ("report", ""), ("end", ""), ("", "rc"), ("", ""), ("a.", ""), ("", "")]
    got = values(spark, [("/a/b.c/d",), ("/x",), ("y",)], "p string", paths.file_name(p), paths.parent(p))
    assert got == [("d", "/a/b.c"), ("x", ""), ("y", None)]
    got = values(spark, [("file:/a/b",), ("hdfs://h:1/a/b",), ("s3a://bucket/k",), ("/a:b/c",)], "p string", paths.without_scheme(p))
    assert [g[0] for g in got] == ["/a/b", "/a/b", "/k", "/a:b/c"]


RULE_TABLE = "include_exclude string, filter_text string, match_type string"


@pytest.mark.parametrize("base", ["", "/r"])
@pytest.mark.parametrize("actions", [("INCLUDE", "EXCLUDE"), ("EXCLUDE",), ("INCLUDE",)])
@pytest.mark.parametrize("broadcast", [0, 100])
def test_rule_tables_follow_the_rule(spark, monkeypatch, base, actions, broadcast):
    monkeypatch.setattr(rule_tables, "_BROADCAST_RULES", broadcast)
    rng = random.Random(3)
    files, rules = random_cases(5, 300, 60)
    rules = [r for r in rules if r.filter_text or r.match_type == "EXACT"] + [PathRule("a/bé_a", "CONTAINS"), PathRule("ab/é_ab/é", "ENDS_WITH")]
    listed = [(rng.choice(actions), r.filter_text, r.match_type) for r in rules[:25]]
    of = lambda kind: tuple(PathRule(t, m) for a, t, m in listed if a == kind)
    want = sorted(base + f for f in files if passing(f, PathRules(of("INCLUDE"), of("EXCLUDE"))))
    frame = spark.createDataFrame([(base + f, 1) for f in [*files, files[3]]] + [(None, 1)], "path string, other int")
    got = rule_tables.filter_by_rules(frame, spark.createDataFrame([*listed, listed[0]], RULE_TABLE), base).collect()
    assert sorted({r.path for r in got}) == want
    assert len(got) == len(want) + (base + files[3] in want)


def test_rules_that_match_everything_and_no_rules(spark):
    frame = spark.createDataFrame([("a",), ("",), (None,)], "path string")
    of = lambda *rows: rule_tables.filter_by_rules(frame, spark.createDataFrame(list(rows), RULE_TABLE)).count()
    assert of() == 2
    for kind in ("STARTS_WITH", "ENDS_WITH", "CONTAINS"):
        assert of(("INCLUDE", "", kind)) == 2
        assert of(("EXCLUDE", "", kind)) == 0
        assert of(("INCLUDE", "", kind), ("EXCLUDE", "a", "EXACT")) == 1
    assert of(("INCLUDE", "", "EXACT")) == 1
    assert of(("EXCLUDE", "", "EXACT")) == 1


@pytest.mark.parametrize("bad", [("INCLUDE", "x", None), ("EXCLUDE", "x", "LIKE"), ("MAYBE", "x", "EXACT"), (None, "x", "EXACT"), ("INCLUDE", None, "EXACT")])
def test_unusable_rules_fail_the_job(spark, bad):
    frame = spark.createDataFrame([("a",)], "path string")
    for some in ([bad], [bad, ("EXCLUDE", "b", "EXACT")]):
        with pytest.raises(Exception, match="path rule not usable"):
            rule_tables.filter_by_rules(frame, spark.createDataFrame(some, RULE_TABLE)).collect()


def test_the_paths_are_never_the_broadcast_side(spark, monkeypatch):
    frame = spark.createDataFrame([(f"/some/folder/{k}",) for k in range(50)], "path string")
    rules = spark.createDataFrame([("EXCLUDE", f"folder/{'x' * k}", "CONTAINS") for k in range(30)], RULE_TABLE)
    for most in (0, 100):
        monkeypatch.setattr(rule_tables, "_BROADCAST_RULES", most)
        plan = rule_tables.filter_by_rules(frame, rules)._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.split("\n") if "HashJoin" in x and "part" in x and "filter_text" not in x]
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert plan.count("Generate explode(CASE") <= 3, "a path gives rows for one size of parts only"
        assert not any("BuildLeft, false" in x and "Inner" in x for x in joins)


@pytest.mark.parametrize("automaton", [0, 10**6])
@pytest.mark.parametrize("actions", [("INCLUDE", "EXCLUDE"), ("EXCLUDE",)])
def test_rules_in_an_automaton_and_in_a_join(spark, monkeypatch, automaton, actions):
    """Paths with the character that marks a path's edges, rules with it, and all match types for the same texts."""
    monkeypatch.setattr(rule_tables, "_AUTOMATON_RULES", automaton)
    rng = random.Random(12)
    pieces = ["a", "b/", "\0", "é_", "/x.kt"]
    files = sorted({"".join(rng.choices(pieces, k=rng.randint(0, 5))) for _ in range(300)})
    for texts in (["a", "b/", "a\0b/", "", "/x.kt"], ["a", "b/a", "ab/", "é_/x.kt"]):
        listed = [(rng.choice(actions), t, m) for t in texts for m in ("EXACT", "STARTS_WITH", "ENDS_WITH", "CONTAINS") if (t or m == "EXACT") and rng.random() < 0.7]
        of = lambda kind: tuple(PathRule(t, m) for a, t, m in listed if a == kind)  # noqa: B023, E731
        want = sorted(f for f in files if passing(f, PathRules(of("INCLUDE"), of("EXCLUDE"))))
        frame = spark.createDataFrame([(f,) for f in [*files, None]], "path string")
        got = rule_tables.filter_by_rules(frame, spark.createDataFrame(listed, RULE_TABLE))
        assert sorted(r.path for r in got.collect()) == want


def test_an_automaton_gives_no_rows_and_no_exchange(spark):
    frame = spark.range(3000).selectExpr("concat('/src/dir', id % 700, '/File', id, '.kt') as path")
    for n in (10, 100_000):
        rules = spark.range(n).selectExpr("'EXCLUDE' as include_exclude", "concat('/dir', id, '/') as filter_text", "'CONTAINS' as match_type")
        left = rule_tables.filter_by_rules(frame, rules)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan
        assert left.count() == sum(k % 700 >= n for k in range(3000))
