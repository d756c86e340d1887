"""Rules that come as tables: parsing, checking and applying them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import paths
from marginalia.plans.workspace import kept, ship
from marginalia.rules import CONTAINS, ENDS_WITH, EXACT, LINE_END, STARTS_WITH, CommentRules, RuleError

INCLUDE = "INCLUDE"
EXCLUDE = "EXCLUDE"

_RULE = ("include_exclude", "filter_text", "match_type")
_GRAM = 4
_BROADCAST_RULES = 20_000
#: Rules and characters of rules that are made into one automaton, which every task gets; more are joined.
_AUTOMATON_RULES, _AUTOMATON_CHARS = 200_000, 16 << 20
#: What stands in front of and behind a path while it is searched.
_EDGE = "\0"


def pattern_match_type(pattern: Column) -> Column:
    """Match type of a path pattern; null if the pattern is not allowed."""
    return (
        F.when(F.rlike(pattern, F.lit(r"\A\*(?:[^*]*\*)?\z")), CONTAINS)
        .when(F.rlike(pattern, F.lit(r"\A[^*]+\z")), EXACT)
        .when(F.rlike(pattern, F.lit(r"\A[^*]+\*\z")), STARTS_WITH)
        .when(F.rlike(pattern, F.lit(r"\A\*[^*]+\z")), ENDS_WITH)
    )


def parse_patterns(patterns: DataFrame, strict: bool = True) -> DataFrame:
    """Adds filter_text and match_type to a table with include_exclude and pattern.

    With ``strict`` a pattern that is not allowed, or an include pattern without
    asterisk, fails the job; otherwise its match type is null.
    """
    pattern = paths.forward_slashes(F.col("pattern"))
    kind = pattern_match_type(pattern)
    refused = kind.isNull() | ((F.col("include_exclude") == INCLUDE) & (kind == EXACT))
    message = F.concat(F.lit("path pattern not allowed: "), F.col("pattern"))
    match_type = F.when(~refused, kind)
    if strict:
        match_type = match_type.when(refused, F.raise_error(message).cast("string"))
    return patterns.select(
        "*",
        F.when(~refused, F.replace(pattern, F.lit("*"), F.lit(""))).alias("filter_text"),
        match_type.alias("match_type"),
    )


def _refused(value: Column, source: Column, kind: str, strict: bool) -> Column:
    """With ``strict``, a value that came out null fails the job."""
    if not strict:
        return value
    message = F.concat(F.lit(f"{kind} not allowed: "), F.coalesce(source, F.lit("null")))
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(message))


def parse_ending(pattern: Column, strict: bool = False) -> Column:
    """``*.kt`` -> ``.kt``; unless the only asterisk stands first, null, or a failed job with ``strict``."""
    ending = F.when(F.rlike(pattern, F.lit(r"\A\*[^*]*\z")), F.substring(pattern, 2, 2**31 - 1))
    return _refused(ending, pattern, "file ending", strict)


def parse_block(rule: Column, strict: bool = False) -> Column:
    """``start...end`` -> struct(start_tag, end_tag); if there is not exactly one ``...``, null, or a failed job with ``strict``."""
    parts = F.split(rule, r"\.\.\.", -1)
    tags = F.struct(F.element_at(parts, 1).alias("start_tag"), F.try_element_at(parts, F.lit(2)).alias("end_tag"))
    return _refused(F.when(F.size(parts) == 2, tags), rule, "block rule", strict)


def unite_rules(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Block rules (action, start_tag, end_tag) and line rules (action, start_tag) in one table."""
    return blocks.select("action", "start_tag", "end_tag").unionByName(
        lines.select("action", "start_tag", F.lit(LINE_END).alias("end_tag"))
    )


def duplicate_start_tags(rules: DataFrame) -> DataFrame:
    """Start tags used more than once; must be empty for usable rules (``comment_rules`` refuses them)."""
    return rules.groupBy("start_tag").count().where("count > 1")


def comment_rules(rules: DataFrame, most: int = 10_000) -> CommentRules:
    """Rules as a job uses them from a table (action ``remove`` or ``keep``, start_tag, end_tag).

    The number of rules is part of the plan, so more than ``most`` are refused, as are start tags used more than
    once, empty ones, other actions and nulls.
    """
    rows = rules.select("action", "start_tag", "end_tag").orderBy("start_tag").limit(most + 1).collect()
    if len(rows) > most:
        raise RuleError(f"more than {most} comment rules")
    for r in rows:
        if r.action not in ("remove", "keep") or r.start_tag is None or r.end_tag is None:
            raise RuleError(f"not a comment rule: {r.asDict()}")
    of = lambda action: tuple((r.start_tag, r.end_tag) for r in rows if r.action == action)
    return CommentRules(of("remove"), of("keep"))


def _checked(rules: DataFrame) -> DataFrame:
    """The rules, each once; one that cannot be used fails the job."""
    known = F.col("match_type").isin(EXACT, STARTS_WITH, ENDS_WITH, CONTAINS)
    usable = known & F.col("include_exclude").isin(INCLUDE, EXCLUDE) & F.col("filter_text").isNotNull()
    shown = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("null")) for c in _RULE])
    refused = F.raise_error(F.concat(F.lit("path rule not usable: "), shown)).cast("string")
    checked = F.when(F.coalesce(usable, F.lit(False)), F.col("filter_text")).otherwise(refused)
    return rules.select("include_exclude", checked.alias("filter_text"), "match_type").distinct()


def _grams(text: Column, sizes: list[int]) -> Column:
    """All different parts of a text that have one of the sizes."""
    parts = [
        F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, F.lit(n))))  # noqa: B023
        for n in sizes
    ]
    return F.array_distinct(F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull())))


def _automaton(rules: list[tuple[str, str, str]]):
    """A trie with failure links over the rules' texts, tied to the path's edges where their match type says so.

    A text's value is whether it starts at the path's start, whether it ends at its end, its length, whether it
    includes and whether it excludes.
    """
    import ahocorasick

    found: dict[str, tuple[bool, bool, int, bool, bool]] = {}
    for action, text, kind in rules:
        first, last = kind in (EXACT, STARTS_WITH), kind in (EXACT, ENDS_WITH)
        own = (_EDGE if first else "") + text + (_EDGE if last else "")
        included, excluded = found[own][3:] if own in found else (False, False)
        found[own] = (first, last, len(own), included or action == INCLUDE, excluded or action == EXCLUDE)
    out = ahocorasick.Automaton()
    for own, value in found.items():
        out.add_word(own, value)
    out.make_automaton()
    return out


def _passing(rules: list[tuple[str, str, str]], includes: bool):
    """A function of paths: whether each passes the rules. ``includes``: a path has to be included by one."""
    held: list = []

    def passes(paths_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not held:
            held.append(_automaton(rules))
        automaton = held[0]
        for some in paths_:
            out = []
            for path in some:
                if path is None:
                    out.append(False)
                    continue
                included, excluded, size = not includes, False, len(path) + 2
                for end, (first, last, length, has_in, has_out) in automaton.iter(_EDGE + path + _EDGE) if len(automaton) else ():
                    if (first and end + 1 != length) or (last and end + 1 != size):  # the edge character inside a path
                        continue
                    included = included or has_in
                    if has_out:
                        excluded = True
                        break
                out.append(included and not excluded)
            yield pd.Series(out, dtype=bool)

    return F.pandas_udf(passes, "boolean")


def filter_by_rules(frame: DataFrame, rules: DataFrame, base: str = "") -> DataFrame:
    """Rows of ``frame`` whose ``path`` passes the rules (include_exclude, filter_text, match_type).

    A null path passes no rules, not even an empty table of them. A rule with a null, or with an action or match type
    that does not exist, fails the job.

    Up to 200,000 rules (counted, with their characters) become one automaton that every task gets: a path is read once,
    whatever the rules, gives no rows but its own, and nothing is shuffled. More are joined: each is looked up by the
    part of ``_GRAM`` characters of its text (or its whole text, if shorter) that the fewest paths have, and tested on
    the paths that have that part.
    """
    table = kept(_checked(rules))
    matches_all = (F.col("filter_text") == "") & (F.col("match_type") != EXACT)
    is_of = lambda kind: F.col("include_exclude") == kind
    known = table.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_or(is_of(INCLUDE)), F.lit(False)).alias("includes"),
        F.coalesce(F.bool_or(is_of(INCLUDE) & matches_all), F.lit(False)).alias("all_in"),
        F.coalesce(F.bool_or(is_of(EXCLUDE) & matches_all), F.lit(False)).alias("all_out"),
        F.collect_set(F.least(F.length("filter_text"), F.lit(_GRAM))).alias("sizes"),
        F.coalesce(F.sum(F.length("filter_text") + 2), F.lit(0)).alias("chars"),
        F.coalesce(F.bool_or(F.contains("filter_text", F.lit(_EDGE))), F.lit(False)).alias("edges"),
    ).first()
    if known.all_out:
        return frame.where("false")
    if known.n <= _AUTOMATON_RULES and known.chars <= _AUTOMATON_CHARS and not known.edges:
        rows = [tuple(r) for r in table.where(~matches_all).select(*_RULE).collect()]
        ship(frame.sparkSession)
        passes = _passing(rows, known.includes and not known.all_in)
        return frame.where(passes(paths.below(F.col("path"), base)))
    sizes = sorted(known.sizes)
    sub_path = paths.below(F.col("path"), base)
    unique = frame.select("path").where("path is not null").distinct().select("path", sub_path.alias("sub_path"))
    # The empty text is a part of no path but an empty one, so that rules for it are looked up as well.
    own = F.when(F.col("sub_path") == "", F.array(F.lit(""))).otherwise(_grams(F.col("sub_path"), [n for n in sizes if n] or [1]))
    looked_up = unique.select("path", "sub_path", F.explode(own).alias("part"))
    counts = looked_up.groupBy("part").agg(F.count("*").alias("paths"))
    size = F.least(F.length("filter_text"), F.lit(_GRAM))
    parts = table.where(~matches_all).select(
        *_RULE,
        F.explode(
            F.when(F.col("filter_text") == "", F.array(F.lit(""))).otherwise(
                F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("filter_text") - size + 1), lambda at: F.substring(F.col("filter_text"), at, size)))
            )
        ).alias("part"),
    )
    # A part that no path has comes first: such a rule matches nothing.
    keyed = parts.join(counts, "part", "left").groupBy(*_RULE).agg(F.min_by("part", F.coalesce("paths", F.lit(0))).alias("part"))
    keyed = F.broadcast(keyed) if known.n <= _BROADCAST_RULES else keyed.hint("merge")
    text, path = F.col("filter_text"), F.col("sub_path")
    holds = (
        F.when(F.col("match_type") == EXACT, path == text)
        .when(F.col("match_type") == STARTS_WITH, F.startswith(path, text))
        .when(F.col("match_type") == ENDS_WITH, F.endswith(path, text))
        .otherwise(F.contains(path, text))
    )
    hits = (
        looked_up.join(keyed, "part")
        .where(holds)
        .groupBy("path")
        .agg(F.bool_or(is_of(INCLUDE)).alias("included"), F.bool_or(is_of(EXCLUDE)).alias("excluded"))
    )
    passing = frame.where("path is not null")
    if not known.includes or known.all_in:
        return passing.join(hits.where("excluded"), "path", "left_anti")
    return passing.join(hits.where("included and not excluded"), "path", "left_semi")
