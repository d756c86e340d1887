"""Registered queries: each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import paths, preview, scan, spans, text, times
from marginalia.operators import files, large_files, naming, rule_tables
from marginalia.plans import archive
from marginalia.plans.preview import preview_run, write_preview
from marginalia.plans.workspace import shared_dir
from marginalia.rules import JobConfig, PathRule, PathRules
from marginalia.sources.tree import inventory, read_tree
from marginalia.streaming.runs import archive_stream
from workload import corpora as c
from workload import oracle as o

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _with_shared_folder(function: Query) -> Query:
    """Sessions of a single machine may come without ``spark.checkpoint.dir``; they get a folder of their own."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not named and (sc.master == "local" or sc.master.startswith("local[")):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
        return function(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = _with_shared_folder(function)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _config(corpus: c.Corpus, root: str = "", endings: tuple[str, ...] = ("",)) -> JobConfig:
    return JobConfig(corpus.base, root, corpus.rules, PathRules(), endings)


# --- occurrences -----------------------------------------------------------------------------

_RANGES = "path, first, last, line_first, line_last, comment_text"


def _register_occurrences(name: str, corpus: c.Corpus) -> None:
    @query(name, f"{o.occurrences(corpus)} SELECT {_RANGES} FROM occ")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return files.flatten(files.find_occurrences(corpus.read(spark, sf_dir), corpus.rules))


for _name, _corpus in (
    ("html", c.HTML),
    ("code", c.CODE),
    ("prose", c.PROSE),
    ("annotated", c.ANNOTATED),
    ("scripts", c.SCRIPTS),
    ("odd", c.ODD),
):
    _register_occurrences(f"occurrences_{_name}", _corpus)


@query(
    "merged_occurrences_code",
    f"""{o.occurrences(c.CODE)} SELECT path, count(*)::int AS occurrences, sum(last - first + 1)::int AS chars,
    max(line_last - line_first + 1)::int AS most_lines FROM occ GROUP BY path""",
)
def merged_occurrences_code(spark, sf_dir):
    found = files.group_by_file(files.commented_files(c.CODE.read(spark, sf_dir), c.CODE.rules))
    chars = F.transform("items", lambda i: i["pos"]["last"] - i["pos"]["first"] + 1)
    lines = F.transform("items", lambda i: i["lines"]["last"] - i["lines"]["first"] + 1)
    return found.select(
        "path",
        F.size("items").alias("occurrences"),
        F.aggregate(chars, F.lit(0), lambda total, n: total + n).alias("chars"),
        F.array_max(lines).alias("most_lines"),
    )


@query(
    "positions_of_newline",
    f"""WITH lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM ({c.PROSE.sql}))
    SELECT path, pos FROM (SELECT path, i, n, (sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i) - 1)::int AS pos FROM lines)
    WHERE i < n""",
)
def positions_of_newline(spark, sf_dir):
    return c.PROSE.read(spark, sf_dir).select("path", F.explode(text.positions(F.col("text"), "\n")).alias("pos"))


@query(
    "positions_of_phrase",
    f"""SELECT path, (unnest(list_filter(range(0, length(text) - 3), lambda p: substr(text, p + 1, 4) = 'anan')))::int AS pos
    FROM ({c.PROSE.sql}) WHERE contains(text, 'anan')""",
)
def positions_of_phrase(spark, sf_dir):
    return c.PROSE.read(spark, sf_dir).select("path", F.explode(text.positions(F.col("text"), "anan")).alias("pos"))


@query(
    "line_numbers",
    f"""SELECT path, (length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1)::int AS line
    FROM (SELECT path, text, (length(text) // 2)::int AS pos FROM ({c.PROSE.sql}))""",
)
def line_numbers(spark, sf_dir):
    middle = F.floor(F.length("text") / 2).cast("int")
    return c.PROSE.read(spark, sf_dir).select("path", text.line_number(F.col("text"), middle).alias("line"))


@query(
    "line_numbers_of_offsets",
    f"""SELECT path, pos, (length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1)::int AS line
    FROM (SELECT path, text, (unnest(list_filter(range(0, length(text) - 1), lambda p: substr(text, p + 1, 2) = 'an')))::int AS pos
    FROM ({c.PROSE.sql}) WHERE contains(text, 'an'))""",
)
def line_numbers_of_offsets(spark, sf_dir):
    sources = c.PROSE.read(spark, sf_dir)
    offsets = sources.select("path", F.explode(text.positions(F.col("text"), "an")).alias("pos"))
    return files.line_numbers_of(sources, offsets)


# --- paths -----------------------------------------------------------------------------------

_PATHS = f"SELECT path FROM ({c.ANNOTATED.sql})"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ANNOTATED.read(spark, sf_dir).select("path")


_PATH_RULES = PathRules.parse(["/src1*", "*/de/*", "*.kt"], ["*/es/*", "/src13/*", "*7.txt"])
_INCLUDED = "(starts_with(path, '/src1') OR contains(path, '/de/') OR ends_with(path, '.kt'))"
_EXCLUDED = "(contains(path, '/es/') OR starts_with(path, '/src13/') OR ends_with(path, '7.txt'))"


@query("path_include", f"SELECT path, {_INCLUDED} AS included FROM ({_PATHS})")
def path_include(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", paths.matches_includes(F.col("path"), _PATH_RULES.include).alias("included"))


@query("path_exclude", f"SELECT path, NOT {_EXCLUDED} AS kept FROM ({_PATHS})")
def path_exclude(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", paths.matches_excludes(F.col("path"), _PATH_RULES.exclude).alias("kept"))


@query("path_combined", f"SELECT path FROM ({_PATHS}) WHERE {_INCLUDED} AND NOT {_EXCLUDED}")
def path_combined(spark, sf_dir):
    return _paths(spark, sf_dir).where(paths.passes(F.col("path"), "", _PATH_RULES))


@query(
    "path_below_base",
    f"""SELECT path FROM ({c.NAMED.sql}) WHERE starts_with(substr(path, 5), '/Brand#1')
    AND NOT contains(substr(path, 5), '_ring.') AND substr(path, 5) NOT LIKE '%src%'""",
)
def path_below_base(spark, sf_dir):
    rules = PathRules.parse(["/Brand#1*"], ["*_ring.*", "*src*"])
    return c.NAMED.read(spark, sf_dir).select("path").where(paths.passes(F.col("path"), c.NAMED.base, rules))


@query("file_endings", f"SELECT path FROM ({_PATHS}) WHERE path LIKE '%.kt' OR path LIKE '%0.txt'")
def file_endings(spark, sf_dir):
    return _paths(spark, sf_dir).where(paths.ends_with_any(F.col("path"), [".kt", "0.txt"]))


@query(
    "any_match",
    f"""SELECT path, (path = '/src1/en/doc1.kt' OR path LIKE '/src2/%' OR path LIKE '%5.kt' OR contains(path, '/fr/')) AS matches,
    (lower(path) LIKE '%.kt' OR lower(path) LIKE '%9.txt') AS ending FROM ({_PATHS})""",
)
def any_match(spark, sf_dir):
    rules = [PathRule.parse(p) for p in ("/src1/en/doc1.kt", "/src2/*", "*5.kt", "*/fr/*")]
    return _paths(spark, sf_dir).select(
        "path",
        paths.matches_any(F.col("path"), rules).alias("matches"),
        paths.ends_with_any(F.col("path"), [".KT", "9.TXT"], ignore_case=True).alias("ending"),
    )


# Rules from the labels: good documents are wanted, toxic ones are not, whatever their folder.
_LABEL_RULES = """SELECT 'INCLUDE' AS include_exclude, '/doc' || doc_id || '.txt' AS filter_text, 'ENDS_WITH' AS match_type FROM labels WHERE quality = 1
    UNION SELECT 'INCLUDE', '/doc' || doc_id || '.', 'CONTAINS' FROM labels WHERE quality = 1 AND toxic = 0
    UNION SELECT 'EXCLUDE', '/doc' || doc_id || '.', 'CONTAINS' FROM labels WHERE toxic = 1
    UNION SELECT DISTINCT 'EXCLUDE', '/' || source || '/es/', 'STARTS_WITH' FROM documents
    UNION SELECT 'INCLUDE', '/' || source || '/' || lang || '/doc' || doc_id || '.kt', 'EXACT' FROM documents"""
_RULE_HOLDS = """CASE match_type WHEN 'EXACT' THEN path = filter_text WHEN 'STARTS_WITH' THEN starts_with(path, filter_text)
    WHEN 'ENDS_WITH' THEN ends_with(path, filter_text) ELSE contains(path, filter_text) END"""


def _rule_sql(rules: str) -> str:
    return f"""WITH rules AS ({rules}), files AS ({_PATHS})
    SELECT path FROM files WHERE EXISTS (SELECT 1 FROM rules WHERE include_exclude = 'INCLUDE' AND {_RULE_HOLDS})
    AND NOT EXISTS (SELECT 1 FROM rules WHERE include_exclude = 'EXCLUDE' AND {_RULE_HOLDS})"""


@query("path_rules_join", _rule_sql(_LABEL_RULES))
def path_rules_join(spark, sf_dir):
    labels, documents = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    name = F.concat(F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."))

    def rules(frame: DataFrame, action: str, filter_text, match_type: str) -> DataFrame:
        return frame.select(
            F.lit(action).alias("include_exclude"), filter_text.alias("filter_text"), F.lit(match_type).alias("match_type")
        )

    folder = F.concat(F.lit("/"), F.col("source"), F.lit("/"))
    table = (
        rules(labels.where("quality = 1"), "INCLUDE", F.concat(name, F.lit("txt")), "ENDS_WITH")
        .union(rules(labels.where("quality = 1 and toxic = 0"), "INCLUDE", name, "CONTAINS"))
        .union(rules(labels.where("toxic = 1"), "EXCLUDE", name, "CONTAINS"))
        .union(rules(documents, "EXCLUDE", F.concat(folder, F.lit("es/")), "STARTS_WITH"))
        .union(rules(documents, "INCLUDE", F.concat(folder, F.col("lang"), name, F.lit("kt")), "EXACT"))
    )
    return rule_tables.filter_by_rules(_paths(spark, sf_dir), table)


_FOLDER_RULES = """SELECT DISTINCT 'INCLUDE' AS include_exclude, '/' || source || '/' AS filter_text, 'STARTS_WITH' AS match_type FROM documents
    WHERE source > 'src2' UNION SELECT DISTINCT 'EXCLUDE', '/' || lang || '/', 'CONTAINS' FROM documents WHERE lang > 'es'"""


@query("path_rules_table", _rule_sql(_FOLDER_RULES))
def path_rules_table(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    table = (
        documents.where("source > 'src2'")
        .selectExpr("'INCLUDE' as include_exclude", "'/' || source || '/' as filter_text", "'STARTS_WITH' as match_type")
        .union(documents.where("lang > 'es'").selectExpr("'EXCLUDE'", "'/' || lang || '/'", "'CONTAINS'"))
    )
    return rule_tables.filter_by_rules(_paths(spark, sf_dir), table)


@query(
    "path_patterns_applied",
    f"""WITH patterns AS (SELECT DISTINCT 'INCLUDE' AS include_exclude, '*/' || source || '/*' AS pattern FROM documents WHERE source < 'src15'
        UNION SELECT DISTINCT 'EXCLUDE', '*' || lang || chr(92) || 'doc1*' FROM documents WHERE lang <> 'en'
        UNION SELECT DISTINCT 'EXCLUDE', '/' || source || '/en*' FROM documents WHERE source > 'src8'
        UNION SELECT 'EXCLUDE', 'a*b' UNION SELECT 'INCLUDE', 'plain'),
    rules AS (SELECT include_exclude, replace(replace(pattern, chr(92), '/'), '*', '') AS filter_text,
        CASE WHEN starts_with(pattern, '*') THEN 'CONTAINS' ELSE 'STARTS_WITH' END AS match_type FROM patterns
        WHERE pattern NOT IN ('a*b', 'plain')), files AS ({_PATHS})
    SELECT path FROM files WHERE EXISTS (SELECT 1 FROM rules WHERE include_exclude = 'INCLUDE' AND {_RULE_HOLDS})
    AND NOT EXISTS (SELECT 1 FROM rules WHERE include_exclude = 'EXCLUDE' AND {_RULE_HOLDS})""",
)
def path_patterns_applied(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    patterns = (
        documents.where("source < 'src15'").selectExpr("'INCLUDE' as include_exclude", "'*/' || source || '/*' as pattern")
        .union(documents.where("lang <> 'en'").selectExpr("'EXCLUDE'", "'*' || lang || chr(92) || 'doc1*'"))
        .union(documents.where("source > 'src8'").selectExpr("'EXCLUDE'", "'/' || source || '/en*'"))
        .union(documents.limit(1).selectExpr("'EXCLUDE'", "'a*b'"))
        .union(documents.limit(1).selectExpr("'INCLUDE'", "'plain'"))
    )
    rules = rule_tables.parse_patterns(patterns.distinct(), strict=False).where("match_type is not null")
    return rule_tables.filter_by_rules(_paths(spark, sf_dir), rules)


# --- rule tables -----------------------------------------------------------------------------

_ACTION = "case when p_size % 2 = 0 then 'INCLUDE' else 'EXCLUDE' end"
_PATTERN = """case p_size % 10 when 0 then p_brand when 1 then p_brand || '*' when 2 then '*' || p_name when 3 then '*' || p_type || '*'
    when 4 then '*' when 5 then '**' when 6 then '' when 7 then '*' || p_name || '*' || p_type when 8 then p_brand || chr(92) || '*'
    else p_type || '*' || p_name end"""
_PATTERNS = f"SELECT p_partkey, {_ACTION} AS include_exclude, {_PATTERN} AS pattern FROM part"


@query(
    "rule_patterns",
    f"""SELECT p_partkey, include_exclude, pattern, match_type,
    CASE WHEN match_type IS NOT NULL THEN replace(slashed, '*', '') END AS filter_text FROM (
        SELECT *, CASE WHEN include_exclude = 'INCLUDE' AND kind = 'EXACT' THEN NULL ELSE kind END AS match_type FROM (
            SELECT *, CASE WHEN slashed = '*' THEN 'CONTAINS' WHEN slashed = '' THEN NULL
                WHEN stars = 0 THEN 'EXACT' WHEN stars = 2 AND starts_with(slashed, '*') AND ends_with(slashed, '*') THEN 'CONTAINS'
                WHEN stars > 1 THEN NULL WHEN starts_with(slashed, '*') THEN 'ENDS_WITH'
                WHEN ends_with(slashed, '*') THEN 'STARTS_WITH' END AS kind FROM (
                SELECT *, replace(pattern, chr(92), '/') AS slashed,
                length(pattern) - length(replace(pattern, '*', '')) AS stars FROM ({_PATTERNS}))))""",
)
def rule_patterns(spark, sf_dir):
    patterns = _table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(_ACTION).alias("include_exclude"), F.expr(_PATTERN).alias("pattern")
    )
    return rule_tables.parse_patterns(patterns, strict=False)


_ENDINGS = """case p_size % 4 when 0 then '*.' || lower(p_type) when 1 then '.' || p_type when 2 then '*.' || p_brand || '*'
    else '*' || p_name end"""


@query(
    "rule_endings",
    f"""SELECT p_partkey, CASE WHEN starts_with(pattern, '*') AND length(replace(pattern, '*', '')) = length(pattern) - 1
    THEN substr(pattern, 2) END AS ending FROM (SELECT p_partkey, {_ENDINGS} AS pattern FROM part)""",
)
def rule_endings(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", rule_tables.parse_ending(F.expr(_ENDINGS)).alias("ending"))


_BLOCKS = """case p_size % 3 when 0 then '<' || p_brand || '>...</' || p_brand || '>' when 1 then p_name
    else p_brand || '...' || p_type || '...' end"""


@query(
    "rule_blocks",
    f"""SELECT p_partkey, CASE WHEN len(parts) = 2 THEN parts[1] END AS start_tag, CASE WHEN len(parts) = 2 THEN parts[2] END AS end_tag
    FROM (SELECT p_partkey, string_split({_BLOCKS}, '...') AS parts FROM part)""",
)
def rule_blocks(spark, sf_dir):
    tags = _table(spark, sf_dir, "part").select("p_partkey", rule_tables.parse_block(F.expr(_BLOCKS)).alias("tags"))
    return tags.select("p_partkey", "tags.start_tag", "tags.end_tag")


@query(
    "rule_duplicates",
    """SELECT start_tag, count(*) AS count FROM (SELECT '<' || p_name || '>' AS start_tag FROM part
    UNION ALL SELECT '//' || p_partkey FROM part UNION ALL SELECT '<' || c_name || '>' FROM customer) GROUP BY start_tag HAVING count(*) > 1""",
)
def rule_duplicates(spark, sf_dir):
    part, customer = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "customer")
    blocks = part.selectExpr("'remove' as action", "'<' || p_name || '>' as start_tag", "'</' || p_name || '>' as end_tag")
    named = customer.selectExpr("'keep' as action", "'<' || c_name || '>' as start_tag", "'' as end_tag")
    lines = part.selectExpr("'remove' as action", "'//' || p_partkey as start_tag")
    return rule_tables.duplicate_start_tags(rule_tables.unite_rules(blocks.unionByName(named), lines))


@query(
    "rule_union",
    """SELECT 'remove' AS action, '<' || p_name || '>' AS start_tag, '</' || p_name || '>' AS end_tag FROM part
    UNION ALL SELECT 'keep', '//' || p_partkey, chr(10) FROM part""",
)
def rule_union(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    blocks = part.selectExpr("'remove' as action", "'<' || p_name || '>' as start_tag", "'</' || p_name || '>' as end_tag")
    return rule_tables.unite_rules(blocks, part.selectExpr("'keep' as action", "'//' || p_partkey as start_tag"))


@query("occurrences_of_rule_table", f"{o.occurrences(c.CODE)} SELECT {_RANGES} FROM occ")
def occurrences_of_rule_table(spark, sf_dir):
    """The rules of the code corpus, from tables of block and line rules."""
    blocks = spark.createDataFrame([("remove", "/*...*/"), ("keep", "/**...*/")], "action string, rule string")
    lines = spark.createDataFrame([("remove", "//"), ("keep", "//:"), ("keep", "//*")], "action string, start_tag string")
    tags = blocks.select("action", rule_tables.parse_block(F.col("rule"), strict=True).alias("tags")).select("action", "tags.*")
    rules = rule_tables.comment_rules(rule_tables.unite_rules(tags, lines))
    return files.flatten(files.find_occurrences(c.CODE.read(spark, sf_dir), rules))


# --- path projections ------------------------------------------------------------------------


@query("relative_path", f"SELECT path, {o.relative(c.NAMED)} AS rel_path FROM ({c.NAMED.sql})")
def relative_path(spark, sf_dir):
    return c.NAMED.read(spark, sf_dir).select("path", paths.relative(F.col("path"), c.NAMED.base).alias("rel_path"))


_NAMES = """case p_size % 5 when 0 then replace(p_name, ' ', '.') when 1 then p_name when 2 then p_name || '.'
    when 3 then '.' || p_type else p_name || '.' || p_brand || '.' || p_type end"""


@query(
    "name_split",
    f"""SELECT p_partkey, CASE WHEN contains(name, '.') THEN left(name, length(name) - length(ext) - 1) ELSE name END AS stem,
    ext AS extension FROM (SELECT p_partkey, name, CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] ELSE '' END AS ext
    FROM (SELECT p_partkey, {_NAMES} AS name FROM part))""",
)
def name_split(spark, sf_dir):
    named = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMES).alias("name"))
    return named.select(
        "p_partkey", paths.stem(F.col("name")).alias("stem"), paths.extension(F.col("name")).alias("extension")
    )


@query(
    "path_parts",
    f"""SELECT path, string_split(path, '/')[-1] AS name, left(path, length(path) - length(string_split(path, '/')[-1]) - 1) AS parent,
    url, replace(replace(url, '/', chr(92)), chr(92), '/') AS slashed FROM (SELECT '/pages/' || page_id || '.html' AS path, url FROM pages)""",
)
def path_parts(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.expr(c.HTML.path).alias("path"), "url")
    return pages.select(
        "path",
        paths.file_name(F.col("path")).alias("name"),
        paths.parent(F.col("path")).alias("parent"),
        "url",
        paths.forward_slashes(F.translate("url", "/", "\\")).alias("slashed"),
    )


@query(
    "distinct_paths",
    "SELECT DISTINCT '/' || source || '/' || lang AS path FROM documents",
)
def distinct_paths(spark, sf_dir):
    return files.distinct_paths(_table(spark, sf_dir, "documents").selectExpr("'/' || source || '/' || lang as path"))


# --- rewriting -------------------------------------------------------------------------------


def _register_context(name: str, corpus: c.Corpus) -> None:
    @query(name, f"{o.context(corpus)} SELECT path, first, last, before, after FROM ctx")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = files.commented_files(corpus.read(spark, sf_dir), corpus.rules)
        whole = F.array_join("segments", "")
        rows = found.select("path", F.inline(text.line_contexts(whole, scan.occurrences(F.col("segments")))))
        return rows.select("path", "pos.first", "pos.last", "before", "after")


def _register_cleaned(name: str, corpus: c.Corpus) -> None:
    @query(name, f"{o.cleaned(corpus)} SELECT path, comments, cleaned, label FROM done")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = files.commented_files(corpus.read(spark, sf_dir), corpus.rules)
        return files.clean_files(found).select("path", "comments", "cleaned", "label")


for _name, _corpus in (("code", c.CODE), ("annotated", c.ANNOTATED), ("scripts", c.SCRIPTS)):
    _register_context(f"line_context_{_name}", _corpus)
for _name, _corpus in (
    ("html", c.HTML),
    ("code", c.CODE),
    ("prose", c.PROSE),
    ("annotated", c.ANNOTATED),
    ("scripts", c.SCRIPTS),
):
    _register_cleaned(f"cleaned_{_name}", _corpus)


@query("cleaned_from_occurrences", f"{o.cleaned(c.SCRIPTS)} SELECT path, cleaned FROM done")
def cleaned_from_occurrences(spark, sf_dir):
    sources = c.SCRIPTS.read(spark, sf_dir)
    return files.clean_listed(sources, files.find_occurrences(sources, c.SCRIPTS.rules))


@query(
    "cleaned_whole",
    f"""{o.cleaned(c.SCRIPTS)} SELECT path, coalesce(cleaned, corpus.text) AS cleaned FROM corpus LEFT JOIN done USING (path)
    WHERE coalesce(cleaned, corpus.text) <> '' OR corpus.text = ''""",
)
def cleaned_whole(spark, sf_dir):
    return files.clean_all(c.SCRIPTS.read(spark, sf_dir), c.SCRIPTS.rules)


@query("fully_commented", f"{o.cleaned(c.SCRIPTS)} SELECT path FROM done WHERE cleaned = ''")
def fully_commented(spark, sf_dir):
    found = files.commented_files(c.SCRIPTS.read(spark, sf_dir), c.SCRIPTS.rules)
    return files.clean_files(found).select("path", "cleaned").where(files.is_emptied(F.col("cleaned"))).select("path")


# Rules and endings that each leave out some files.
_BITING = JobConfig(
    c.ANNOTATED.base, "", c.ANNOTATED.rules, PathRules.parse(["/src1*", "*/de/*"], ["*/es/*", "/src13/*"]), (".kt", "7.txt")
)
_BITES = """((starts_with(path, '/src1') OR contains(path, '/de/')) AND NOT (contains(path, '/es/') OR starts_with(path, '/src13/'))
    AND (ends_with(path, '.kt') OR ends_with(path, '7.txt')))"""


@query(
    "cleaned_tree",
    f"""{o.cleaned(c.ANNOTATED)} SELECT path, {o.relative(c.ANNOTATED)} AS rel_path,
    CASE WHEN {_BITES} THEN coalesce(done.cleaned, corpus.text) ELSE corpus.text END AS text FROM corpus LEFT JOIN done USING (path)
    WHERE NOT ({_BITES} AND coalesce(done.cleaned, 'kept') = '')""",
)
def cleaned_tree(spark, sf_dir):
    return files.cleaned_tree(c.ANNOTATED.read(spark, sf_dir), _BITING)


@query("preview_selected", f"{o.occurrences(c.ANNOTATED)} SELECT {{}} FROM occ WHERE {_BITES}")
def preview_selected(spark, sf_dir):
    return preview_run(c.ANNOTATED.read(spark, sf_dir), _BITING)


@query(
    "markup_of_nothing",
    """SELECT NULL::varchar AS path, 0 AS first, '<span class="plain">(No comments to be removed)</span>' AS line
    WHERE (SELECT count(*) FROM documents WHERE contains(text, '<!--')) = 0""",
)
def markup_of_nothing(spark, sf_dir):
    plain = c.Corpus("documents", c.PROSE.path, c.PROSE.text, c.MARKUP_RULES, c.PROSE.base)
    return preview_run(plain.read(spark, sf_dir), _config(plain), "markup")


# --- grouping, labels, totals ----------------------------------------------------------------

_ITEMS_SQL = "string_agg(first || '-' || last || ':' || line_first || '-' || line_last, ',' ORDER BY first)"


def _items_text(items: str):
    return F.array_join(
        F.transform(
            items,
            lambda i: F.concat_ws(
                ":",
                F.concat_ws("-", i["pos"]["first"].cast("string"), i["pos"]["last"].cast("string")),
                F.concat_ws("-", i["lines"]["first"].cast("string"), i["lines"]["last"].cast("string")),
            ),
        ),
        ",",
    )


@query("grouped_by_file", f"{o.occurrences(c.ANNOTATED)} SELECT path, {_ITEMS_SQL} AS items FROM occ GROUP BY path")
def grouped_by_file(spark, sf_dir):
    found = files.commented_files(c.ANNOTATED.read(spark, sf_dir), c.ANNOTATED.rules)
    return files.group_by_file(found).select("path", _items_text("items").alias("items"))


@query("collected_by_file", f"{o.occurrences(c.CODE)} SELECT path, {_ITEMS_SQL} AS items FROM occ GROUP BY path")
def collected_by_file(spark, sf_dir):
    found = files.find_occurrences(c.CODE.read(spark, sf_dir), c.CODE.rules)
    return files.collect_by_file(found).select("path", _items_text("items").alias("items"))


@query("removal_labels", f"{o.cleaned(c.SCRIPTS)} SELECT label, count(*) AS files FROM done GROUP BY label")
def removal_labels(spark, sf_dir):
    found = files.commented_files(c.SCRIPTS.read(spark, sf_dir), c.SCRIPTS.rules)
    return files.clean_files(found).groupBy("label").agg(F.count("*").alias("files"))


@query(
    "run_totals",
    f"""{o.occurrences(c.ANNOTATED)} SELECT (SELECT count(*) FROM corpus WHERE {_INCLUDED} AND NOT {_EXCLUDED}) AS files,
    (SELECT count(*) FROM corpus WHERE {_INCLUDED} AND NOT {_EXCLUDED} AND path LIKE '%.kt') AS matching_files,
    (SELECT count(*) FROM occ WHERE {_INCLUDED} AND NOT {_EXCLUDED} AND path LIKE '%.kt') AS occurrences""",
)
def run_totals(spark, sf_dir):
    config = JobConfig("", "", c.ANNOTATED.rules, _PATH_RULES, (".kt",))
    return files.run_totals(c.ANNOTATED.read(spark, sf_dir), config)


_NAMES_SQL = f"""SELECT path, stem || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.json' AS summary_name FROM (
    SELECT path, stem, row_number() OVER (PARTITION BY stem ORDER BY path) - 1 AS k FROM (
    SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM ({c.NAMED.sql})))"""


@query("summary_names", _NAMES_SQL)
def summary_names(spark, sf_dir):
    return naming.summary_names(c.NAMED.read(spark, sf_dir))


# Stems that end like numbers of other families, in chains, with zeros that no number has, and paths that are null.
_CLASHING = """case when p_partkey % 97 = 0 then null else '/src/' || p_brand || '/' || p_partkey || '/N' || p_partkey % 25
    || case p_size % 5 when 0 then '' when 1 then '-' || p_size % 9 when 2 then '-' || p_size % 6 || '-' || p_partkey % 4
    when 3 then '-0' || p_size % 3 else '' end || '.kt' end"""
_CLASHING_SQL = f"""WITH files AS (SELECT {_CLASHING} AS path FROM part),
    stems AS (SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM files WHERE path IS NOT NULL),
    roots AS (SELECT path, stem, regexp_replace(stem, '(-[1-9][0-9]*)+$', '') AS root FROM stems),
    lists AS (SELECT list(path ORDER BY path) AS paths, list([stem] ORDER BY path) AS stems FROM roots GROUP BY root),
    named AS (SELECT paths, list_reduce(stems, lambda done, own: list_append(done, list_filter(list_transform(range(0, len(done) + 1),
        lambda k: own[1] || CASE WHEN k = 0 THEN '' ELSE '-' || k END), lambda c: NOT list_contains(done, c))[1]), []::VARCHAR[]) AS names FROM lists)
    SELECT unnest(paths) AS path, unnest(names) || '.json' AS summary_name FROM named
    UNION ALL SELECT path, NULL FROM files WHERE path IS NULL"""


@query("summary_names_clashing", _CLASHING_SQL)
def summary_names_clashing(spark, sf_dir):
    return naming.summary_names(_table(spark, sf_dir, "part").select(F.expr(_CLASHING).alias("path")))


# --- previews --------------------------------------------------------------------------------

_SHORT = "replace(replace(comment_text, chr(13), ''), chr(10), chr(92) || 'n')"
_ONE_LINE = f"""path, first, {{rel}} || ':' || line_first || '> ' || CASE WHEN length({_SHORT}) > 40
    THEN left({_SHORT}, 37) || '...' ELSE {_SHORT} END AS line"""


def _one_line_sql(corpus: c.Corpus) -> str:
    return f"{o.occurrences(corpus)} SELECT {_ONE_LINE.format(rel=o.relative(corpus))} FROM occ"


_LINES = "string_split(regexp_replace(replace(replace(comment_text, chr(13), ''), chr(9), '    '), '\\n\\z', ''), chr(10))"


def _multi_line_sql(corpus: c.Corpus) -> str:
    return f"""{o.occurrences(corpus)} SELECT path, first, {o.relative(corpus)} || ':' || line_first || '-' || line_last || '>'
    || chr(10) || '    ' || array_to_string(CASE WHEN len(lines) <= 5 THEN lines
    ELSE list_concat(list_concat(lines[1:2], ['[...]']), lines[-2:]) END, chr(10) || '    ') AS line
    FROM (SELECT *, {_LINES} AS lines FROM occ)"""


def _preview(corpus: c.Corpus, fmt: str) -> Query:
    return lambda spark, sf_dir: preview_run(corpus.read(spark, sf_dir), _config(corpus), fmt)


ORACLES["preview_selected"] = ORACLES["preview_selected"].format(_ONE_LINE.format(rel=o.relative(c.ANNOTATED)))
query("preview_line", _one_line_sql(c.CODE))(_preview(c.CODE, "one_line"))
query("preview_line_html", _one_line_sql(c.HTML))(_preview(c.HTML, "one_line"))
query("preview_multiline", _multi_line_sql(c.ANNOTATED))(_preview(c.ANNOTATED, "multi_line"))
query("preview_multiline_scripts", _multi_line_sql(c.SCRIPTS))(_preview(c.SCRIPTS, "multi_line"))
query("markup", f"{o.markup(c.HTML)} SELECT path, 0 AS first, html AS line FROM markup")(_preview(c.HTML, "markup"))
query("markup_annotated", f"{o.markup(c.ANNOTATED)} SELECT path, 0 AS first, html AS line FROM markup")(
    _preview(c.ANNOTATED, "markup")
)


@query("sections", f"{o.sections(c.CODE)} SELECT path, seq, text, highlight FROM section")
def sections(spark, sf_dir):
    return files.file_sections(files.commented_files(c.CODE.read(spark, sf_dir), c.CODE.rules))


@query(
    "escaped",
    """SELECT conv_id, turn, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'),
    chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS shown FROM conversations""",
)
def escaped(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.escape_controls(F.col("text")).alias("shown"))


@query(
    "snippet",
    f"""SELECT path, CASE WHEN pos >= length(text) THEN '(pos ' || pos || ' >) string length ' || length(text) || ')'
    WHEN pos < 0 THEN '(pos ' || pos || ' < 0)' ELSE replace(replace(replace(replace(
    substr(text, greatest(pos - 10, 0) + 1, pos - greatest(pos - 10, 0)) || '-->' || substr(text, pos + 1, 1) || '<--' || substr(text, pos + 2, 10),
    chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') END AS shown
    FROM (SELECT path, text, ((length(text) * (length(text) % 7)) // 5 - 3)::int AS pos FROM ({c.PROSE.sql}))""",
)
def snippet(spark, sf_dir):
    length = F.length("text")
    pos = (F.floor(length * (length % 7) / 5) - 3).cast("int")
    return c.PROSE.read(spark, sf_dir).select("path", text.snippet(F.col("text"), pos).alias("shown"))


# --- archive ---------------------------------------------------------------------------------


def _archived(spark: SparkSession, sf_dir: str, corpus: c.Corpus, *runs: str) -> str:
    root = shared_dir(spark)
    for run_id in runs:
        archive.archive_run(spark, corpus.read(spark, sf_dir), _config(corpus, root), run_id)
    return root


_RUN = "2022-08-22T19-00-00_0123"
_REL = o.relative(c.NAMED)
_JSON = f"""to_json(struct_pack(relativePath := {_REL}, items := list(struct_pack(filePath := path,
    pos := struct_pack(first := first, last := last), lines := struct_pack(first := line_first, last := line_last),
    commentText := comment_text) ORDER BY first)))::varchar"""


@query(
    "summary_json",
    f"""{o.occurrences(c.NAMED)}, names AS ({_NAMES_SQL}),
    docs AS (SELECT path, {_REL} AS rel_path, {_JSON} AS json FROM occ GROUP BY path)
    SELECT rel_path, summary_name, json FROM docs JOIN names USING (path)""",
)
def summary_json(spark, sf_dir):
    root = _archived(spark, sf_dir, c.NAMED, _RUN)
    return archive.read_summaries(spark, root, _RUN).drop("run_id")


@query(
    "operation_index",
    f"""{o.cleaned(c.SCRIPTS)} SELECT {o.relative(c.SCRIPTS)} AS rel_path, label, {o.relative(c.SCRIPTS)} || ':' || label AS line FROM done""",
)
def operation_index(spark, sf_dir):
    root = _archived(spark, sf_dir, c.SCRIPTS, _RUN)
    return archive.read_archive(spark, root, archive.OPERATION_INDEX, _RUN).drop("run_id")


@query(
    "code_archive",
    f"""{o.cleaned(c.NAMED)}, rel AS (SELECT {_REL} AS rel, text FROM done)
    SELECT string_split(rel, '/')[-1] AS name, left(rel, length(rel) - length(string_split(rel, '/')[-1]) - 1) AS rel_dir, text FROM rel""",
)
def code_archive(spark, sf_dir):
    root = _archived(spark, sf_dir, c.NAMED, _RUN)
    return archive.read_archive(spark, root, archive.CODE_ARCHIVE, _RUN).drop("run_id")


@query(
    "archive_selected",
    f"""{o.cleaned(c.ANNOTATED)} SELECT {o.relative(c.ANNOTATED)} AS rel_path, label, text, cleaned FROM done WHERE {_BITES}""",
)
def archive_selected(spark, sf_dir):
    """Old and new text of every file of a run whose rules and endings leave out files."""
    root = shared_dir(spark)
    config = replace(_BITING, archive_root=root)
    archive.archive_run(spark, c.ANNOTATED.read(spark, sf_dir), config, _RUN)
    table = lambda name: archive.read_archive(spark, root, name, _RUN).drop("run_id")
    old = table(archive.CODE_ARCHIVE).select(F.concat_ws("/", F.nullif("rel_dir", F.lit("")), "name").alias("rel_path"), "text")
    new = table("snapshot").select("rel_path", F.col("text").alias("cleaned"))
    return table(archive.OPERATION_INDEX).select("rel_path", "label").join(old, "rel_path").join(new, "rel_path", "left").select(
        "rel_path", "label", "text", F.coalesce("cleaned", F.lit("")).alias("cleaned")
    )


@query(
    "archive_whole_tree",
    f"""{o.cleaned(c.ANNOTATED)} SELECT {o.relative(c.ANNOTATED)} AS rel_path,
    md5(CASE WHEN {_BITES} THEN coalesce(done.cleaned, corpus.text) ELSE corpus.text END) AS text_md5 FROM corpus LEFT JOIN done USING (path)
    WHERE NOT ({_BITES} AND coalesce(done.cleaned, 'kept') = '')""",
)
def archive_whole_tree(spark, sf_dir):
    root = shared_dir(spark)
    config = replace(_BITING, archive_root=root)
    archive.archive_run(spark, c.ANNOTATED.read(spark, sf_dir), config, _RUN, whole_tree=True)
    tree = archive.read_archive(spark, root, "snapshot", _RUN)
    return tree.select("rel_path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("changes", f"{o.markup(c.SCRIPTS)} SELECT path, html FROM markup")
def changes(spark, sf_dir):
    root = _archived(spark, sf_dir, c.SCRIPTS, _RUN)
    return archive.read_archive(spark, root, archive.CHANGES, _RUN).drop("run_id")


@query(
    "changes_of_nothing",
    """SELECT NULL::varchar AS path, '<span class="plain">(No comments to be removed)</span>' AS html
    WHERE (SELECT count(*) FROM documents WHERE contains(text, '<!--')) = 0""",
)
def changes_of_nothing(spark, sf_dir):
    plain = c.Corpus("documents", c.PROSE.path, c.PROSE.text, c.MARKUP_RULES, c.PROSE.base)
    root = _archived(spark, sf_dir, plain, _RUN)
    return archive.read_archive(spark, root, archive.CHANGES, _RUN).drop("run_id")


@query(
    "snapshot",
    f"""{o.cleaned(c.SCRIPTS)} SELECT path, {o.relative(c.SCRIPTS)} AS rel_path, cleaned AS text FROM done WHERE cleaned <> ''""",
)
def snapshot(spark, sf_dir):
    root = _archived(spark, sf_dir, c.SCRIPTS, _RUN)
    return archive.read_archive(spark, root, "snapshot", _RUN).drop("run_id")


_SECOND_RUN = "2022-08-23T19-00-00_0000"


@query(
    "runs_side_by_side",
    f"""{o.cleaned(c.SCRIPTS)} SELECT run_id, label, count(*) AS files FROM done,
    (VALUES ('{_RUN}'), ('{_SECOND_RUN}')) AS runs(run_id) GROUP BY run_id, label""",
)
def runs_side_by_side(spark, sf_dir):
    root = _archived(spark, sf_dir, c.SCRIPTS, _RUN, _SECOND_RUN)
    return (
        archive.read_archive(spark, root, archive.OPERATION_INDEX)
        .groupBy("run_id", "label")
        .agg(F.count("*").alias("files"))
    )


@query(
    "preview_file",
    f"""WITH shown AS ({_one_line_sql(c.CODE)}) SELECT line FROM shown""",
)
def preview_file(spark, sf_dir):
    target = shared_dir(spark)
    write_preview(preview_run(c.CODE.read(spark, sf_dir), _config(c.CODE)), target)
    return spark.read.text(target).withColumnRenamed("value", "line")


@query(
    "archive_stream",
    f"""{o.cleaned(c.SCRIPTS)} SELECT label, count(*) AS files FROM done GROUP BY label""",
)
def archive_stream_(spark, sf_dir):
    root, inbox, checkpoint = (shared_dir(spark) for _ in range(3))
    c.SCRIPTS.read(spark, sf_dir).write.parquet(inbox)
    arriving = spark.readStream.schema("path string, text string").parquet(inbox)
    archive_stream(arriving, _config(c.SCRIPTS, root), "stream", checkpoint).awaitTermination()
    return (
        archive.read_archive(spark, root, archive.OPERATION_INDEX)
        .groupBy("label")
        .agg(F.count("*").alias("files"))
    )


# --- tagged spans ----------------------------------------------------------------------------


@query(
    "span_extract",
    """SELECT page_id, unnest(regexp_extract_all(html, '<li>([\\s\\S]*?)</li>|<h1>([\\s\\S]*?)</h1>')) AS whole FROM pages""",
)
def span_extract(spark, sf_dir):
    tags = {"<li>": "</li>", "<h1>": "</h1>"}
    pages = _table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.inline(spans.extract_spans(F.col("html"), tags)))
    return found.select("page_id", F.concat("start_tag", "content", "end_tag").alias("whole"))


@query(
    "span_positions",
    """WITH cut AS (SELECT page_id, string_split_regex(html, '(?i)<B>') AS parts FROM pages),
    part AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
    placed AS (SELECT *, coalesce(sum(length(part) + 3) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM part)
    SELECT page_id, start::int AS start_pos, (start + length(string_split_regex(part, '<br>|</b>')[1]))::int AS end_pos,
    string_split_regex(part, '<br>|</b>')[1] AS content,
    CASE WHEN starts_with(substr(part, length(string_split_regex(part, '<br>|</b>')[1]) + 1), '<br>') THEN '<BR>' ELSE '</B>' END AS end_tag
    FROM placed WHERE i > 1""",
)
def span_positions(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.inline(spans.extract_spans(F.col("html"), {"<B>": ["<BR>", "</B>"]}, ignore_case=True)))
    return found.select("page_id", "start_pos", "end_pos", "content", "end_tag")


@query(
    "span_strip",
    """SELECT page_id, regexp_replace(regexp_replace(html, '<p>[\\s\\S]*?(</p>|\\z)', '\\1', 'g'), '<li>[\\s\\S]*?(</li>|\\z)', '\\1', 'g') AS stripped FROM pages""",
)
def span_strip(spark, sf_dir):
    tags = {"<p>": "</p>", "<li>": "</li>"}
    return _table(spark, sf_dir, "pages").select("page_id", spans.strip_spans(F.col("html"), tags).alias("stripped"))


@query(
    "span_mask",
    """WITH cut AS (SELECT page_id, string_split_regex(regexp_replace(html, '(<script>[\\s\\S]*?(?:</script>|\\z)|<nav>[\\s\\S]*?(?:</nav>|\\z))',
        chr(57344) || '\\1' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']') AS parts FROM pages),
    part AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut)
    SELECT page_id, string_agg(CASE WHEN i % 2 = 0 THEN repeat('#', length(part)::int) ELSE part END, '' ORDER BY i) AS masked FROM part GROUP BY page_id""",
)
def span_mask(spark, sf_dir):
    tags = {"<script>": "</script>", "<nav>": "</nav>"}
    return _table(spark, sf_dir, "pages").select("page_id", spans.mask_spans(F.col("html"), tags, "#").alias("masked"))


# --- times -----------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
    return _table(spark, sf_dir, "events").select("event_id", F.expr(epoch).alias("millis"))


@query(
    "run_id_format",
    """SELECT event_id, strftime(ts, '%Y-%m-%d''T''%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d''T''%H:%M:%S.0%g') AS iso_millis,
    strftime(ts, '%Y-%m-%dT%H-%M-%S_0%g') AS run_id FROM events""",
)
def run_id_format(spark, sf_dir):
    millis = F.col("millis")
    return _events(spark, sf_dir).select(
        "event_id",
        times.iso_text(millis, millis=False).alias("iso"),
        times.iso_text(millis).alias("iso_millis"),
        times.run_id(millis).alias("run_id"),
    )


@query(
    "local_offset",
    """SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN 7200000 ELSE 3600000 END::bigint AS berlin,
    19800000::bigint AS kolkata, epoch_us(ts) // 1000 + 19800000 AS local_millis FROM events""",
)
def local_offset(spark, sf_dir):
    ts = F.timestamp_millis("millis")
    return _events(spark, sf_dir).select(
        "event_id",
        times.utc_offset_millis(ts, "Europe/Berlin").alias("berlin"),
        times.utc_offset_millis(ts, "Asia/Kolkata").alias("kolkata"),
        times.local_millis(ts, "Asia/Kolkata").alias("local_millis"),
    )


# --- directory trees -------------------------------------------------------------------------

# Names as they are in real trees: with dots and underscores in front, and files without a byte.
_TREE_NAME = """c_nationkey || '/' || case c_custkey % 5 when 0 then '__init__' when 1 then '.hidden' when 2 then '_form' else 'plain' end
    || c_custkey || case when c_custkey % 2 = 0 then '.sh' else '.txt' end"""
_TREE_TEXT = f"case when c_custkey % 7 = 0 then '' else {c.SCRIPTS.text} end"


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Scripts of the customers as files of a new tree, a folder per nation."""
    root = shared_dir(spark)
    local = root.removeprefix("file://")
    scripts = _table(spark, sf_dir, "customer").select(F.expr(_TREE_NAME).alias("name"), F.expr(_TREE_TEXT).alias("text"))

    def write(batches):
        import os

        for b in batches:
            for name, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = f"{local}/{name}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(text_)
            yield b.select([0])

    scripts.mapInArrow(write, "name string").count()
    return root


@query(
    "inventory",
    f"""SELECT {_TREE_NAME} AS rel_path, strlen({_TREE_TEXT})::bigint AS length, true AS fresh FROM customer""",
)
def inventory_(spark, sf_dir):
    found = inventory(spark, _tree(spark, sf_dir))
    fresh = F.col("modified").between(F.current_timestamp() - F.expr("interval 1 hour"), F.current_timestamp() + F.expr("interval 1 hour"))
    return found.select("rel_path", "length", fresh.alias("fresh"))


@query(
    "occurrences_in_chunks",
    f"{o.occurrences(c.ODD)} SELECT {_RANGES} FROM occ",
)
def occurrences_in_chunks(spark, sf_dir):
    """Texts cut into chunks of some hundred characters, which several rows of a text hold."""
    chunks = large_files.cut_texts(c.ODD.read(spark, sf_dir), c.ODD.rules, 400)
    found = files.flatten(large_files.find_occurrences(chunks, c.ODD.rules))
    return found.select("path", *[F.col(n).cast("int").alias(n) for n in ("first", "last", "line_first", "line_last")], "comment_text")


@query(
    "inventory_links",
    f"SELECT {_TREE_NAME} AS rel_path, strlen({_TREE_TEXT})::bigint AS length FROM customer",
)
def inventory_links(spark, sf_dir):
    """A tree whose folders link to each other, to the root and to files: links are neither entered nor listed."""
    import os

    root = _tree(spark, sf_dir)
    local = root.removeprefix("file://")
    folders = sorted(os.listdir(local))
    for folder, other in zip(folders, [*folders[1:], folders[0]], strict=True):
        os.symlink(f"{local}/{other}", f"{local}/{folder}/next")
        os.symlink(local, f"{local}/{folder}/top")
        os.symlink(f"{local}/{folder}/{min(os.listdir(f'{local}/{folder}'))}", f"{local}/{folder}/copy.sh")
    return inventory(spark, root).select("rel_path", "length")


@query(
    "tree_scan",
    f"""SELECT {_TREE_NAME} AS rel_path, strlen({_TREE_TEXT})::bigint AS length, {_TREE_TEXT} AS text FROM customer
    WHERE contains('/' || {_TREE_NAME}, '/1') AND NOT contains({_TREE_NAME}, '/_') AND ends_with({_TREE_NAME}, '.sh')""",
)
def tree_scan(spark, sf_dir):
    root = _tree(spark, sf_dir)
    config = JobConfig(root.removeprefix("file://"), "", c.SCRIPTS.rules, PathRules.parse(["*/1*"], ["*/_*"]), (".sh",))
    return read_tree(spark, root, config).select("rel_path", "length", "text")


@query(
    "tree_occurrences",
    f"""{o.occurrences(c.Corpus("customer", "'/' || " + _TREE_NAME, _TREE_TEXT, c.CODE_RULES))} SELECT {_RANGES} FROM occ""",
)
def tree_occurrences(spark, sf_dir):
    sources = read_tree(spark, _tree(spark, sf_dir))
    found = files.find_occurrences(sources.withColumn("path", F.concat(F.lit("/"), "rel_path")), c.SCRIPTS.rules)
    return files.flatten(found)
