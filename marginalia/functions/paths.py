"""Predicates and projections on paths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.rules import CONTAINS, ENDS_WITH, EXACT, SCHEME, STARTS_WITH, PathRule, PathRules


_TESTS = {STARTS_WITH: F.startswith, ENDS_WITH: F.endswith, CONTAINS: F.contains}


def any_true(tests: Iterable[Column]) -> Column:
    """Any of the tests, as a balanced tree, so that a thousand of them are ten levels deep."""
    tests = list(tests)
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def _one_of(text: Column, match_type: str, wanted: list[str]) -> Column:
    """One match type, any of some texts."""
    if match_type == EXACT:
        return text.isin(wanted)
    return any_true(_TESTS[match_type](text, F.lit(w)) for w in wanted)


def matches_any(text: Column, rules: Iterable[PathRule]) -> Column:
    """True if a rule matches; an empty list matches nothing."""
    by_type: dict[str, list[str]] = {}
    for rule in rules:
        by_type.setdefault(rule.match_type, []).append(rule.filter_text)
    return any_true(_one_of(text, match_type, wanted) for match_type, wanted in by_type.items())


def matches_includes(text: Column, rules: Iterable[PathRule]) -> Column:
    """True if a rule matches or there is no rule."""
    rules = tuple(rules)
    return matches_any(text, rules) if rules else F.lit(True)


def matches_excludes(text: Column, rules: Iterable[PathRule]) -> Column:
    """False if a rule matches."""
    return ~matches_any(text, rules)


def below(path: Column, base: str) -> Column:
    """The path with the base path cut off; a leading slash stays.  A path that is not below the base fails the job."""
    if not base:
        return path
    message = F.concat(F.lit(f"path not below {base!r}: "), path)
    cut = F.substring(path, len(base) + 1, 2**31 - 1)
    return F.when(path.isNull() | F.startswith(path, F.lit(base)), cut).otherwise(F.raise_error(message).cast("string"))


def passes(path: Column, base: str, rules: PathRules) -> Column:
    """Include and exclude rules, applied to the path below ``base``."""
    sub_path = below(path, base)
    return matches_includes(sub_path, rules.include) & matches_excludes(sub_path, rules.exclude)


def ends_with_any(text: Column, endings: Iterable[str], ignore_case: bool = False) -> Column:
    """True if the text has one of the endings; an empty list matches nothing."""
    fold = F.lower if ignore_case else (lambda c: c)
    return any_true(F.endswith(fold(text), fold(F.lit(ending))) for ending in endings)


def relative(path: Column, base: str) -> Column:
    """The path below ``base`` without a leading backslash and then a leading slash."""
    return F.regexp_replace(below(path, base), r"^\\?/?", "")


def forward_slashes(text: Column) -> Column:
    return F.translate(text, "\\", "/")


def without_scheme(path: Column) -> Column:
    """``file:/a/b`` and ``hdfs://host:1/a/b`` -> ``/a/b``."""
    return F.regexp_replace(path, SCHEME, "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """All before the last slash; null if there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", ""))


def stem(name: Column) -> Column:
    """File name without its extension."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)


def extension(name: Column) -> Column:
    """What stands behind the last dot."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))
