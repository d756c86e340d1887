"""Corpora that both engines derive from the given tables with the same expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.rules import CommentRules
from marginalia.sources.tables import from_table

MARKUP_RULES = CommentRules.parse(["<!--...-->"])
CODE_RULES = CommentRules.parse(["/*...*/"], ["/**...*/"], ["//"], ["//:", "//*"])
HASH_RULES = CommentRules.parse(remove_lines=["#"])

_CODE = """'// ' || p_name || chr(10) || '/* ' || p_type || ' */' || chr(10) || '//: keep ' || p_brand || chr(10)
    || 'val x = "' || p_name || ' /*no*/ ' || chr(92) || '" ' || p_brand || '"' || chr(10)
    || '/** doc */ class P' || p_partkey || ' /* ' || p_size || ' */ { }' || chr(10) || '  //a' || chr(10) || '  //b' || chr(10)"""

# Sentences and clauses of the documents become statements with a comment behind or around them.
_ANNOTATED = """'/** ' || source || ' */' || chr(10)
    || replace(replace(text, '. ', '; /* ' || lang || ' */' || chr(13) || chr(10)), ', ', ' // note' || chr(10) || '  ')"""

# Customers of one segment have a script that is nothing but comments.
_SCRIPT = """case when c_mktsegment = 'BUILDING' then '// ' || c_name || chr(10) || '/* ' || c_custkey || chr(10) || ' */'
    else 'name = "' || c_name || '" // ' || c_mktsegment || chr(10) || chr(10)
    || '  /* balance' || chr(10) || c_nationkey || ' */  ' || chr(10) || 'key = ' || c_custkey || '/* k' || chr(10) || '*/;' end"""


@dataclass(frozen=True)
class Corpus:
    table: str
    path: str
    text: str
    rules: CommentRules
    base: str = ""

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        # Every given table is one file with one row group, which one task would read and scan alone.
        return from_table(frame, F.expr(self.path), F.expr(self.text), partitions=spark.sparkContext.defaultParallelism)

    @property
    def sql(self) -> str:
        return f"SELECT {self.path} AS path, {self.text} AS text FROM {self.table}"


HTML = Corpus("pages", "'/pages/' || page_id || '.html'", "html", MARKUP_RULES, "/pages")
CODE = Corpus("part", "'/src/' || p_brand || '/P' || p_partkey || '.kt'", _CODE, CODE_RULES, "/src")
PROSE = Corpus("documents", "'/docs/' || doc_id || '.txt'", "text", HASH_RULES, "/docs")
ANNOTATED = Corpus(
    "documents",
    "'/' || source || '/' || lang || '/doc' || doc_id || case when n_chars % 3 = 0 then '.kt' else '.txt' end",
    _ANNOTATED,
    CODE_RULES,
)
SCRIPTS = Corpus("customer", "'/home/' || c_nationkey || '/' || c_custkey || '.sh'", _SCRIPT, CODE_RULES, "/home")
# Raw strings, constructs that never close, and white space that only Unicode knows, between and behind comments.
_ODD = """case doc_id % 4 when 0 then replace(text, '. ', '. \"\"\" // not \" one \"\"\" // real' || chr(10))
    when 1 then replace(text, '. ', '. // one' || chr(10) || chr(160) || chr(10) || '/* two */ ') || '/* open ' || lang
    when 2 then replace(text, ', ', ' /* a */' || chr(12) || '/* b */, ') || chr(34) || ' // in a string'
    else '/* x */' || chr(8195) || '// y' || chr(13) || chr(10) || text || chr(10) || '//: keep' || chr(10) || '/** open' end"""

ODD = Corpus("documents", "'/odd/' || source || '/' || doc_id || '.kt'", _ODD, CODE_RULES, "/odd")
# File names that occur in many directories.
NAMED = Corpus(
    "part",
    "'/src/' || p_brand || '/' || p_partkey || '/' || replace(p_name, ' ', '_') || '.' || lower(p_type)",
    _CODE,
    CODE_RULES,
    "/src",
)
