"""Text helpers: blankness, newline counts, line context, escapes, positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import let, let_sql, literal, running_sum_sql

# The characters that count as white space when a line is called blank.
_BLANKS = r"\x09-\x0d\x1c-\x20\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NON_BLANK = f"[^{_BLANKS}]"
BLANK_START = rf"\A[{_BLANKS}]*+"


#: Characters of a text that one row of the table of line starts stands for.
LINE_BLOCK = 1024


def blank_sql(text: str) -> str:
    # The regular expression is asked only if the first character behind common white space is not plain ASCII.
    bare = f"ltrim(concat(' ', chr(9), chr(10), chr(13)), {text})"
    plain = "substring(bare, 1, 1) between '!' and '~'"
    return let_sql("bare", bare, f"bare = '' or (not ({plain}) and not rlike(bare, {literal(_NON_BLANK)}))")


def newlines_sql(text: str) -> str:
    return f"(octet_length({text}) - octet_length(replace({text}, chr(10), '')))"


def count_newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def first_line_sql(text: str) -> str:
    """Text up to the first line feed, without it."""
    return f"substring_index({text}, chr(10), 1)"


def last_line_sql(text: str) -> str:
    """Text after the last line feed."""
    return f"substring_index({text}, chr(10), -1)"


def tail_sql(text: str, start: str) -> str:
    """Text from the 0-based offset ``start`` on."""
    return f"substring({text}, {start} + 1)"


def line_before_sql(text: str, pos: str) -> str:
    return last_line_sql(f"substring({text}, 1, {pos})")


def line_after_sql(text: str, pos: str) -> str:
    rest = first_line_sql(tail_sql(text, f"{pos} + 1"))
    return f"if(substring({text}, {pos} + 1, 1) = chr(10), '', {rest})"


def line_before(text: Column, pos: Column) -> Column:
    """What stands before offset ``pos`` on its line."""
    return let(F.struct(text.alias("text"), pos.alias("pos")), f"at -> {line_before_sql('at.text', 'at.pos')}")


def line_after(text: Column, pos: Column) -> Column:
    """What stands after offset ``pos`` on its line; nothing if ``pos`` is the line feed itself."""
    return let(F.struct(text.alias("text"), pos.alias("pos")), f"at -> {line_after_sql('at.text', 'at.pos')}")


def line_contexts(text: Column, items: Column) -> Column:
    """``items`` with the text before and after each of them on its first and last line.

    The text is cut into lines once, so the cost does not grow with the number of
    items times the length of the text.
    """
    starts = running_sum_sql("transform(file.lines, line -> length(line) + 1)", "0")
    first, last = "item.lines.first - 1", "item.lines.last - 1"
    contexts = f"""transform(file.items, item -> named_struct(
        'pos', item.pos, 'lines', item.lines, 'comment_text', item.comment_text,
        'before', substring(file.lines[{first}], 1, item.pos.first - starts[{first}]),
        'after', {tail_sql(f"file.lines[{last}]", f"item.pos.last - starts[{last}] + 1")}))"""
    file = F.struct(F.split(text, "\n", -1).alias("lines"), items.alias("items"))
    return let(file, f"file -> {let_sql('starts', starts, contexts)}")


def positions(text: Column, needle: str) -> Column:
    """0-based offsets of every occurrence of ``needle``, overlapping ones included."""
    if not needle:
        raise ValueError("needle may not be empty")
    head, rest = re.escape(needle[0]), re.escape(needle[1:])
    step = rf"(?s:.)*?{head}(?={rest})" if rest else rf"[^{head}]*+{head}"
    # The needle appended at the end is always found, so no search ever runs into the end
    # of the text; where it is found is the length of the text.
    steps = F.regexp_extract_all(F.concat(text, F.lit(needle)), F.lit(step), F.lit(0))
    starts = f"zip_with(sizes, {running_sum_sql('sizes', '0')}, (size, sum) -> sum + size - 1)"
    inside = f"filter(starts, start -> start + {len(needle)} <= element_at(starts, -1))"
    found = let(F.transform(steps, F.length), f"sizes -> {let_sql('starts', starts, inside)}")
    return F.when(F.contains(text, F.lit(needle)), found).otherwise(F.array().cast("array<int>"))


def line_number(text: Column, pos: Column) -> Column:
    """1-based line of an offset; a line feed belongs to the line it ends."""
    return count_newlines(F.substring(text, F.lit(1), pos)) + 1


def line_blocks(text: Column) -> Column:
    """The text in blocks of ``LINE_BLOCK`` characters: number of the block, its characters, line feeds before it, and the offsets
    within it at which a line begins (0 for the line that goes on). The offset behind the last character has a block
    as well. The text is read once and is no part of the result."""
    starts = running_sum_sql("transform(split(piece, chr(10), -1), line -> length(line) + 1)", "0")
    blocks = f"regexp_extract_all(concat(text, 'x'), {literal(f'(?s).{{1,{LINE_BLOCK}}}+')}, 0)"
    lines = running_sum_sql(f"transform(pieces, piece -> {newlines_sql('piece')})", "0")
    body = f"""transform(pieces, (piece, i) -> named_struct('block', bigint(i), 'size', length(piece), 'lines', lines[i], 'starts', {starts}))"""
    return let(text, f"text -> {let_sql('pieces', blocks, let_sql('lines', lines, body))}")


def line_in_block(block: Column, pos: Column) -> Column:
    """1-based line of an offset, from the block it lies in."""
    here = (pos % LINE_BLOCK).cast("int")
    return block["lines"] + F.size(F.filter(block["starts"], lambda start: start <= here))


def escape_controls(text: Column) -> Column:
    """Show backslash, line feed, carriage return and tab as two characters; null as ``null``."""
    shown = F.coalesce(text, F.lit("null"))
    # What is replaced by what, in this order.
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        shown = F.replace(shown, F.lit(plain), F.lit(escaped))
    return shown


def snippet(
    text: Column, pos: Column, before: int = 10, after: int = 10, left: str = "-->", right: str = "<--", escape: bool = True
) -> Column:
    """The character at ``pos`` between marks, with some context on both sides."""
    start = F.greatest(pos - before, F.lit(0))
    marked = F.concat(
        F.substring(text, start + 1, pos - start),
        F.lit(left),
        F.substring(text, pos + 1, F.lit(1)),
        F.lit(right),
        F.substring(text, pos + 2, F.lit(after)),
    )
    # The two messages, brackets as in the original output.
    too_far = F.concat(F.lit("(pos "), pos.cast("string"), F.lit(" >) string length "), F.length(text).cast("string"), F.lit(")"))
    too_low = F.concat(F.lit("(pos "), pos.cast("string"), F.lit(" < 0)"))
    return (
        F.when(pos >= F.length(text), too_far)
        .when(pos < 0, too_low)
        .otherwise(escape_controls(marked) if escape else marked)
    )
