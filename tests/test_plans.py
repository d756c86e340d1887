"""What the plans must look like to hold at scale."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import scan, spans, text
from marginalia.operators import files
from marginalia.plans.preview import preview_run
from marginalia.rules import CommentRules, JobConfig, PathRules
from marginalia.sources.tables import from_table

RULES = CommentRules.parse(["/*...*/"], ["/**...*/"], ["//"], ["//:", "//*"])
CONFIG = JobConfig("", "", RULES, PathRules.parse(["/a*"], ["*gen*"]), (".kt",))
# Stands in the scan pattern once.
MARK = "[^\"/]++|(?!"


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    """A table of more files than cores, as large tables are."""
    folder = str(tmp_path_factory.mktemp("plans") / "table")
    frame = spark.range(320).selectExpr("concat('/a/', id, '.kt') as name", "concat('x // ', id, '\\n') as body", "id as other")
    frame.repartition(16).write.parquet(folder)
    return from_table(spark.read.parquet(folder), F.col("name"), F.col("body"))


JOBS = {
    "occurrences": lambda s: files.flatten(files.find_occurrences(s, RULES)),
    "files": lambda s: files.commented_files(s, RULES),
    "grouped": lambda s: files.group_by_file(files.commented_files(s, RULES)),
    "cleaned": lambda s: files.clean_files(files.commented_files(s, RULES)),
    "emptied": lambda s: files.clean_files(files.commented_files(s, RULES)).where("cleaned = ''").select("path"),
    "cleaned whole": lambda s: files.clean_all(s, RULES),
    "sections": lambda s: files.file_sections(files.commented_files(s, RULES)),
    "markup": lambda s: files.file_markup(files.commented_files(files.select_files(s, CONFIG), RULES)),
    "cleaned tree": lambda s: files.cleaned_tree(s, CONFIG),
    "one line": lambda s: preview_run(s, CONFIG, "one_line"),
    "multi line": lambda s: preview_run(s, CONFIG, "multi_line"),
    "contexts": lambda s: files.commented_files(s, RULES).select(
        "path", F.inline(text.line_contexts(F.array_join("segments", ""), scan.occurrences(F.col("segments"))))
    ),
}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOBS)
def test_work_on_files_needs_no_exchange_and_one_scan_of_each_text(sources, name):
    plan = plan_of(JOBS[name](sources))
    assert "Exchange" not in plan
    assert "Python" not in plan
    assert plan.count(MARK) == 1
    assert "ReadSchema: struct<name:string,body:string>" in plan


def test_totals_are_added_up_before_the_exchange(sources):
    plan = plan_of(files.run_totals(sources, CONFIG))
    assert plan.count("Exchange") == 1 and "partial_count" in plan and plan.count(MARK) == 1
    assert tuple(files.run_totals(sources, CONFIG).first()) == (320, 320, 320)


def test_tables_are_dealt_out_only_if_asked(spark, sources, tmp_path):
    assert "Exchange" not in plan_of(sources)
    folder = str(tmp_path / "one")
    spark.range(100).selectExpr("string(id) as name", "'// x' as body", "id as other").coalesce(1).write.parquet(folder)
    table = spark.read.parquet(folder)
    assert "Exchange" not in plan_of(from_table(table, F.col("name"), F.col("body")))
    dealt = from_table(table, F.col("name"), F.col("body"), partitions=5)
    assert plan_of(dealt).count("Exchange hashpartitioning") == 1 and "other" not in plan_of(dealt)
    assert dealt.count() == 100


def test_spans_are_extracted_once(spark):
    frame = spark.range(3).selectExpr("concat('a<b>c', id) as t")
    for column in (spans.extract_spans(F.col("t"), {"<": ">"}), spans.mask_spans(F.col("t"), {"<": ">"}, "#")):
        assert plan_of(frame.select(column.alias("x"))).count("regexp_extract_all") == 1


def test_message_of_an_empty_preview_is_found_by_the_first_hit(sources):
    plan = plan_of(preview_run(sources, CONFIG, "markup"))
    assert "LocalLimit 1" in plan or "CollectLimit 1" in plan or "GlobalLimit 1" in plan
