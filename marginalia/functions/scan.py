"""Segments and occurrences of a text.

``segments`` is the one product of the scan: plain piece, occurrence, plain piece,
occurrence, ... in text order.  The first piece is plain (and may be empty), the
pieces concatenate to the text, and everything else (offsets, cleaned text,
sections, previews) is worked out from them inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import let, let_sql, running_sum_sql
from marginalia.functions.paths import matches_any
from marginalia.functions.patterns import STRING_QUOTE, occurrence_tiles, unused_char
from marginalia.functions.text import count_newlines, newlines_sql
from marginalia.rules import CONTAINS, CommentRules, PathRule

_LOWER_HALF = 2**32 - 1


def has_start_tag(text: Column, rules: CommentRules) -> Column:
    """Cheap and safe test: a text without any start tag to remove has no occurrence."""
    return matches_any(text, (PathRule(start, CONTAINS) for start, _ in rules.remove))


def tiles(text: Column, pattern: str, pad: str) -> Column:
    """Pieces of ``text`` under a tiling pattern.

    A plain character in front makes the first piece plain, even if the text starts
    with a match; it is taken off again.
    """
    pieces = F.regexp_extract_all(F.concat(F.lit(pad), text), F.lit(pattern), F.lit(0))
    return let(pieces, "all -> concat(array(substring(all[0], 2)), slice(all, 2, size(all)))")


def cut(text: Column, rules: CommentRules) -> Column:
    """Plain pieces (even places) and occurrences (odd places) of a text."""
    starts = [start for start, _ in (*rules.remove, *rules.keep)]
    return tiles(text, occurrence_tiles(rules), unused_char([*starts, STRING_QUOTE]))


def segments(text: Column, rules: CommentRules) -> Column:
    """Like ``cut``, but a text without start tags is not searched at all."""
    return F.when(has_start_tag(text, rules), cut(text, rules)).when(text.isNotNull(), F.array(text))


def occurrence_count(pieces: Column) -> Column:
    return F.floor(F.size(pieces) / 2).cast("int")


def located(pieces: Column) -> Column:
    """Occurrence texts, each with what stands ``before`` it: characters (upper half) and line feeds (lower half)."""
    return let(pieces, f"segs -> {_located_sql('segs')}")


def occurrence_columns(before: Column, text: Column) -> list[Column]:
    """``pos``, ``lines`` and ``comment_text`` of a located occurrence."""
    first, line = F.shiftright(before, 32).cast("int"), before.bitwiseAND(F.lit(_LOWER_HALF)).cast("int") + 1
    inner = count_newlines(text) - F.endswith(text, F.lit("\n")).cast("int")
    return [
        F.struct(first.alias("first"), (first + F.length(text) - 1).alias("last")).alias("pos"),
        F.struct(line.alias("first"), (line + inner).alias("last")).alias("lines"),
        text.alias("comment_text"),
    ]


def occurrences(pieces: Column) -> Column:
    """Occurrences with inclusive 0-based offsets, 1-based line range and text, as an array."""
    return let(pieces, f"segs -> {occurrences_sql('segs')}")


def occurrences_sql(segs: str) -> str:
    first, line = "int(shiftright(found.before, 32))", f"int(found.before & {_LOWER_HALF}L) + 1"
    return f"""transform({_located_sql(segs)}, found -> named_struct(
        'pos', named_struct('first', {first}, 'last', {first} + length(found.text) - 1),
        'lines', named_struct('first', {line}, 'last', {line} + {inner_newlines_sql('found.text')}),
        'comment_text', found.text))"""


def _located_sql(segs: str) -> str:
    extents = f"transform({segs}, seg -> shiftleft(bigint(length(seg)), 32) + {newlines_sql('seg')})"
    found = f"transform(sequence(1, size({segs}) - 1, 2), at -> named_struct('before', sums[at], 'text', {segs}[at]))"
    nothing = "cast(array() as array<struct<before:bigint,text:string>>)"
    return f"if(size({segs}) > 1, {let_sql('sums', running_sum_sql(extents, '0L'), found)}, {nothing})"


def inner_newlines_sql(text: str) -> str:
    """Line feeds of a comment without the one that ends it."""
    return f"({newlines_sql(text)} - int(endswith({text}, chr(10))))"
