"""Regular expressions that cut a whole text into plain pieces and comment occurrences.

All repetitions are possessive, so Java's matcher loops instead of recursing and
long comments, strings or runs of comments cannot exhaust the stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from marginalia.rules import LINE_END, CommentRules

# String delimiters of the scanned languages.
STRING_QUOTE = '"'
RAW_STRING_QUOTE = '"""'

_REST = r"(?s:.)*+"
_STRING = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\\?\z)'
_BETWEEN_OCCURRENCES = "\t\r\n "


def any_of(texts: Iterable[str]) -> str:
    """Alternation of literal texts, longest first, so that the longest one wins."""
    return "|".join(re.escape(t) for t in sorted(set(texts), key=lambda t: (-len(t), t)))


def _class(chars: Iterable[str], *, negated: bool = False) -> str:
    return "[" + ("^" if negated else "") + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


def until(ends: Sequence[str]) -> str:
    """Everything before the nearest of ``ends``, or the rest of the text if there is none."""
    if "" in ends:
        return ""
    heads = [end[0] for end in ends]
    plain = _class(heads, negated=True)
    return f"{plain}*+(?:(?!{_in_order(ends)}){_class(heads)}{plain}*+)*+"


def through(ends: Sequence[str]) -> str:
    """Everything up to and including the nearest of ``ends``; no match if there is none."""
    return "" if "" in ends else f"{until(ends)}(?:{_in_order(ends)})"


def _in_order(texts: Sequence[str]) -> str:
    return "|".join(map(re.escape, texts))


def _no_longer(start: str, starts: Iterable[str]) -> str:
    longer = [s for s in starts if len(s) > len(start) and s.startswith(start)]
    return f"(?!{any_of(longer)})" if longer else ""


def longest_wins(start: str, starts: Iterable[str]) -> str:
    """``start``, unless a longer start tag matches at the same place."""
    return _no_longer(start, starts) + re.escape(start)


def plain_run(starts: Iterable[str]) -> list[str]:
    """Pieces that no start tag opens: runs of harmless characters, and single characters that only look like one."""
    heads = {s[0] for s in starts}
    return [_class(heads, negated=True) + "++", f"(?!{any_of(starts)}){_class(heads)}"]


def occurrence_tiles(rules: CommentRules) -> str:
    """Matches that tile a text: plain pieces and removable occurrences in turn.

    A plain piece holds code, strings and kept comments.  An occurrence is a run
    of removable comments with nothing but tab, CR, LF and space between them.
    """
    remove = dict(rules.remove)
    keep = {start: end for start, end in rules.keep if start not in remove}
    if RAW_STRING_QUOTE not in remove:
        keep[RAW_STRING_QUOTE] = RAW_STRING_QUOTE
    strings = {STRING_QUOTE} - remove.keys() - keep.keys()
    starts = {*remove, *keep, *strings}

    removable, skipped = [], []
    for start, end in remove.items():
        opening = longest_wins(start, starts)
        if end == LINE_END:
            removable.append(rf"{opening}[^\n]*+\n?+")
        else:
            removable.append(opening + through([end]))
            if end:
                skipped.append(f"{opening}(?!{through([end])}){_REST}")
    for start, end in keep.items():
        skipped.append(f"{longest_wins(start, starts)}(?:{through([end])}|{_REST})")
    for start in strings:
        skipped.append(_no_longer(start, starts) + _STRING)

    space = _class(_BETWEEN_OCCURRENCES)
    if any(start[0] in _BETWEEN_OCCURRENCES for start in starts):
        space = f"(?!{any_of(starts)}){space}"
    comment = "(?:" + "|".join(removable) + ")"
    plain = "(?:" + "|".join([*plain_run(starts), *skipped]) + ")"
    return f"{plain}++|{comment}(?:(?:{space})*+{comment})*+"


def _openings(pairs: Mapping[str, Sequence[str]], ignore_case: bool) -> list[tuple[str, Sequence[str]]]:
    """Patterns of start tags with their end tags; of tags at the same place the one listed first wins."""
    fold = str.lower if ignore_case else str
    openings: list[tuple[str, Sequence[str]]] = []
    earlier: list[str] = []
    for start, ends in pairs.items():
        if not any(fold(start).startswith(fold(e)) for e in earlier):
            ahead = [e for e in earlier if fold(e).startswith(fold(start))]
            openings.append(((f"(?!{any_of(ahead)})" if ahead else "") + re.escape(start), ends))
        earlier.append(start)
    return openings


def span_tiles(pairs: Mapping[str, Sequence[str]], *, ignore_case: bool) -> str:
    """Matches that tile a text: plain runs, tagged spans, and at the end a span that never closes.

    A span runs from a start tag through the nearest of its end tags.
    """
    openings = _openings(pairs, ignore_case)
    spans = [opening + through(ends) for opening, ends in openings]
    open_ends = [f"{opening}(?!{through(ends)}){_REST}" for opening, ends in openings]
    return rf"{_flags(ignore_case)}(?:{'|'.join(plain_run(pairs))})++|{'|'.join(spans + open_ends)}"


def closed_span(pairs: Mapping[str, Sequence[str]], *, ignore_case: bool) -> str:
    """Matches a text that is one closed span."""
    spans = [opening + through(ends) for opening, ends in _openings(pairs, ignore_case)]
    return rf"{_flags(ignore_case)}\A(?:{'|'.join(spans)})\z"


def start_tag(pairs: Mapping[str, Sequence[str]], *, ignore_case: bool) -> str:
    """Matches a text that begins with a start tag."""
    return rf"{_flags(ignore_case)}\A(?:{any_of(pairs)})"


def open_spans(pairs: Mapping[str, Sequence[str]], *, ignore_case: bool) -> str:
    """Matches of tagged spans up to, but not including, their end tag."""
    spans = [f"(?={opening}){until(ends)}" for opening, ends in _openings(pairs, ignore_case)]
    return _flags(ignore_case) + "|".join(spans)


def _flags(ignore_case: bool) -> str:
    return "(?iu)" if ignore_case else ""


def unused_char(starts: Iterable[str]) -> str:
    """A character no start tag contains."""
    used = set("".join(starts))
    return next(c for c in map(chr, range(ord("."), 0x10000)) if c not in used and not c.isalpha())
