"""Rules of a job: which comments go, which stay, and which paths are looked at."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

EXACT = "EXACT"
STARTS_WITH = "STARTS_WITH"
ENDS_WITH = "ENDS_WITH"
CONTAINS = "CONTAINS"

LINE_END = "\n"
BLOCK_SEPARATOR = "..."

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?"


class RuleError(ValueError):
    """A rule that cannot be used."""


@dataclass(frozen=True)
class PathRule:
    filter_text: str
    match_type: str

    @staticmethod
    def parse(pattern: str) -> PathRule:
        """``x`` exact, ``x*`` prefix, ``*x`` suffix, ``*x*`` or ``*`` contains; all else is refused."""
        if not pattern:
            raise RuleError("a path pattern may not be empty")
        text = pattern.strip("*") if pattern.count("*") <= 2 else pattern
        if pattern == "*":
            return PathRule("", CONTAINS)
        if "*" in text:
            raise RuleError(f"{pattern!r}: '*' may only stand at the beginning and/or the end")
        shapes = {
            text: EXACT,
            f"{text}*": STARTS_WITH,
            f"*{text}": ENDS_WITH,
            f"*{text}*": CONTAINS,
        }
        if pattern not in shapes:
            raise RuleError(f"{pattern!r}: only one '*' is allowed at each end")
        return PathRule(text, shapes[pattern])


def parse_ending(pattern: str) -> str:
    """``*.kt`` -> ``.kt``: one asterisk, and it stands first."""
    if not pattern.startswith("*") or pattern.count("*") != 1:
        raise RuleError(f"file ending {pattern!r} must start with its only '*'")
    return pattern[1:]


def parse_block(rule: str) -> tuple[str, str]:
    """``/*...*/`` -> (``/*``, ``*/``)."""
    parts = rule.split(BLOCK_SEPARATOR)
    if len(parts) != 2:
        raise RuleError(f"{rule!r}: expected 'start...end', as in '/*...*/'")
    return parts[0], parts[1]


def root_path(root: str) -> str:
    """``hdfs://host:1/a/b/`` -> ``/a/b``, the form in which paths are compared."""
    return re.sub(SCHEME, "", root).rstrip("/")


def _slashes(text: str) -> str:
    return text.replace("\\", "/")


@dataclass(frozen=True)
class PathRules:
    """A path passes if an include rule matches (or there is none) and no exclude rule does."""

    include: tuple[PathRule, ...] = ()
    exclude: tuple[PathRule, ...] = ()

    @staticmethod
    def parse(include: Iterable[str] = (), exclude: Iterable[str] = ()) -> PathRules:
        included = tuple(PathRule.parse(_slashes(p)) for p in include)
        for rule in included:
            if rule.match_type == EXACT:
                raise RuleError(f"include path {rule.filter_text!r} must contain an asterisk")
        return PathRules(included, tuple(PathRule.parse(_slashes(p)) for p in exclude))


@dataclass(frozen=True)
class CommentRules:
    """Start and end tags of comments to remove and to keep; a line comment ends with a line feed."""

    remove: tuple[tuple[str, str], ...]
    keep: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        starts = [start for start, _ in (*self.remove, *self.keep)]
        if "" in starts:
            raise RuleError("a start tag may not be empty")
        for start in starts:
            if starts.count(start) > 1:
                raise RuleError(f"start tags must be unique, but {start!r} occurs multiple times")

    @staticmethod
    def parse(
        remove_blocks: Iterable[str] = (),
        keep_blocks: Iterable[str] = (),
        remove_lines: Iterable[str] = (),
        keep_lines: Iterable[str] = (),
    ) -> CommentRules:
        return CommentRules(
            remove=(*map(parse_block, remove_blocks), *((tag, LINE_END) for tag in remove_lines)),
            keep=(*map(parse_block, keep_blocks), *((tag, LINE_END) for tag in keep_lines)),
        )


@dataclass(frozen=True)
class JobConfig:
    """All a preview or archive run needs to know."""

    source_root: str
    archive_root: str
    comments: CommentRules
    paths: PathRules = field(default_factory=PathRules)
    endings: tuple[str, ...] = ()

    @property
    def base(self) -> str:
        """What the paths of all source files begin with."""
        return root_path(self.source_root)

    @staticmethod
    def parse(
        source_root: str,
        archive_root: str,
        include: Iterable[str],
        endings: Iterable[str],
        exclude: Iterable[str] = (),
        **comment_rules: Iterable[str],
    ) -> JobConfig:
        include, endings = tuple(include), tuple(endings)
        for name, value in (
            ("source_root", source_root),
            ("archive_root", archive_root),
            ("include", include),
            ("endings", endings),
        ):
            if not value:
                raise RuleError(f"{name} may not be empty")
        return JobConfig(
            source_root=_slashes(source_root.removesuffix("/")),
            archive_root=_slashes(archive_root.removesuffix("/")),
            comments=CommentRules.parse(**comment_rules),
            paths=PathRules.parse(include, exclude),
            endings=tuple(parse_ending(e) for e in endings),
        )
