"""Removing occurrences from a text, with the white space around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import let, let_sql, literal
from marginalia.functions.scan import inner_newlines_sql, occurrences_sql
from marginalia.functions.text import (
    BLANK_START,
    blank_sql,
    first_line_sql,
    last_line_sql,
    line_after_sql,
    line_before_sql,
    tail_sql,
)

_BLOCK = 1024


def _removal(before: str, after: str, multi: str, line_comment: str) -> str:
    """What the removal of a comment depends on.

    ``left`` and ``right`` are the widths of the text before and after it on its lines if
    that is blank, and -1 if not; nothing counts as standing behind a line comment.
    """
    return let_sql(
        "before",
        before,
        let_sql(
            "after",
            after,
            f"""named_struct(
                'left', if({blank_sql("before")}, length(before), -1),
                'right', case when {line_comment} then 0 when {blank_sql("after")} then length(after) else -1 end,
                'multi', {multi},
                'ended', {line_comment},
                'spaced', startswith(after, ' '))""",
        ),
    )


def _separator(removal: str) -> str:
    """What is put in the place of a comment."""
    return f"""case
        when {removal}.left >= 0 then ''
        when {removal}.ended then chr(10)
        when {removal}.right >= 0 then ''
        when {removal}.multi then chr(10)
        when {removal}.spaced then ''
        else ' ' end"""


def _left_side(text: str, removal: str) -> str:
    """The text before a comment once the comment is gone."""
    cut = f"{removal}.left > 0 and ({removal}.multi or {removal}.right >= 0)"
    return f"rtrim(concat(' ', chr(9)), if({cut}, substring({text}, 1, length({text}) - {removal}.left), {text}))"


def _right_side(text: str, removal: str) -> str:
    """The text after a comment once the comment is gone."""
    cut = f"{removal}.right > 0 and ({removal}.multi or {removal}.left >= 0)"
    kept = f"if({cut}, {tail_sql(text, f'{removal}.right')}, {text})"
    # A line break is one CR, if there is one, and then one LF.
    no_cr = f"if(startswith({kept}, chr(13)), substring({kept}, 2), {kept})"
    no_break = let_sql("rest", no_cr, "if(startswith(rest, chr(10)), substring(rest, 2), rest)")
    return f"if({removal}.multi and {removal}.left >= 0 and {removal}.right >= 0, {no_break}, {kept})"


def _without(text: str, item: str) -> str:
    """``text`` without one comment."""
    first, last = f"{item}.pos.first", f"{item}.pos.last"
    removal = _removal(
        line_before_sql(text, first),
        line_after_sql(text, last),
        f"{item}.lines.first < {item}.lines.last",
        f"endswith({item}.comment_text, chr(10))",
    )
    left = let_sql("head", f"substring({text}, 1, {first})", _left_side("head", "removal"))
    right = let_sql("rest", tail_sql(text, f"{last} + 1"), _right_side("rest", "removal"))
    return let_sql("removal", removal, f"concat({left}, {_separator('removal')}, {right})")


def _one_by_one(text: str, items: str) -> str:
    return f"aggregate(reverse(array_sort({items})), {text}, (done, item) -> {_without('done', 'item')})"


def remove_comment(text: Column, item: Column) -> Column:
    """``text`` without one comment given by its ``pos``, ``lines`` and ``comment_text``."""
    return let(F.struct(text.alias("text"), item.alias("item")), f"file -> {_without('file.text', 'file.item')}")


def remove_comments(text: Column, items: Column) -> Column:
    """``text`` without the given comments, as if removed one by one from the last to the first.

    The text is cut at the ranges once and put together again, like a scanned one. Ranges that overlap or run past
    the end of the text have no such cut; those texts are copied once per comment.
    """
    sound = """forall(sequence(0, size(ranges) - 1), i -> ranges[i].last < size and
        if(i = 0, ranges[i].first >= 0, ranges[i].first > ranges[i - 1].last))"""
    ranges = "array_sort(transform(file.items, item -> item.pos))"
    cut = let_sql("segs", _cut_sql("file.text", "ranges", "size"), _cleaned_sql("segs"))
    body = f"""case when file.text is null or size(file.items) = 0 then file.text
        when {sound} then {cut} else {_one_by_one('file.text', 'file.items')} end"""
    body = let_sql("ranges", ranges, let_sql("size", "length(file.text)", body))
    return let(F.struct(text.alias("text"), items.alias("items")), f"file -> {body}")


def _cut_sql(text: str, ranges: str, size: str) -> str:
    """SQL text of plain piece, range, plain piece, ...; characters are found through blocks of ``_BLOCK``, so the
    cost of a piece does not depend on where it stands."""

    def part(first: str, stop: str) -> str:
        low, high = f"int(({first}) div {_BLOCK})", f"int(({stop} - 1) div {_BLOCK})"
        return f"""case when {first} >= {stop} then ''
            when {low} = {high} then substring(blocks[{low}], ({first}) % {_BLOCK} + 1, {stop} - ({first}))
            else concat(substring(blocks[{low}], ({first}) % {_BLOCK} + 1), array_join(slice(blocks, {low} + 2, {high} - {low} - 1), ''),
                substring(blocks[{high}], 1, ({stop} - 1) % {_BLOCK} + 1)) end"""

    pieces = f"""transform({ranges}, (range, i) -> array({part(f"if(i = 0, 0, {ranges}[i - 1].last + 1)", "range.first")},
        {part("range.first", "(range.last + 1)")}))"""
    rest = part(f"(element_at({ranges}, -1).last + 1)", size)
    blocks = f"regexp_extract_all({text}, {literal(f'(?s).{{1,{_BLOCK}}}+')}, 0)"
    return let_sql("blocks", blocks, f"concat(flatten({pieces}), array({rest}))")


def cleaned(pieces: Column) -> Column:
    """The text of a scanned file without its occurrences.

    What a removal does to a plain piece that is not blank depends on that piece alone, so such pieces part the
    occurrences into groups that do not meet. Nearly always a group is one occurrence and all pieces are cut at
    once; where pieces are blank (say, a lone no-break space) the few occurrences around them are removed one by one
    within their group.
    """
    return let(pieces, f"segs -> {_cleaned_sql('segs')}")


def _cleaned_sql(segs: str) -> str:
    # Plain pieces between occurrences: not the first one, and not the one behind the last occurrence.
    inner = f"slice(filter({segs}, (seg, i) -> i % 2 = 0 and i > 0), 1, size({segs}) div 2 - 1)"
    return f"""case
        when size({segs}) < 2 then array_join({segs}, '')
        when exists({inner}, seg -> {blank_sql('seg')}) then {_in_groups(segs)}
        else {_spliced(segs)} end"""


def _in_groups(segs: str) -> str:
    """SQL text of the cleaned text, group by group.

    A group is removed from a text of its own: its occurrences and the blank pieces between them, behind what is
    blank at the end of the piece before and in front of what is blank at the start of the piece after. A mark on
    either side stands for the rest of those pieces, which no removal looks at or changes.
    """
    tail = let_sql(
        "line",
        last_line_sql("piece"),
        f"if({blank_sql('line')}, line, substring(line, length(rtrim(concat(' ', chr(9)), line)) + 1))",
    )
    sides = f"""transform(filter(all, (piece, i) -> i % 2 = 0), (piece, i) -> named_struct(
        'at', 2 * i, 'text', piece, 'head', regexp_extract(piece, {literal(BLANK_START)}, 0), 'tail', {tail},
        'blank', {blank_sql('piece')}, 'last_blank', {blank_sql(last_line_sql('piece'))}))"""
    bounds = "filter(sides, (side, i) -> i = 0 or i = size(sides) - 1 or not side.blank)"
    local = """concat(array(concat(if(a.last_blank, chr(10), 'x'), a.tail)), slice(all, a.at + 2, b.at - a.at - 1),
        array(concat(b.head, if(b.blank, '', 'x'))))"""
    removed = let_sql("own", local, let_sql("left", _one_by_one("array_join(own, '')", occurrences_sql("own")),
        "substring(left, 2, length(left) - if(b.blank, 1, 2))"))
    plain = """substring(a.text, if(i = 0, 0, length(a.head)) + 1,
        length(a.text) - if(i = 0, 0, length(a.head)) - length(a.tail))"""
    middle = f"""transform(sequence(0, size(bounds) - 2), i ->
        {let_sql('a', 'bounds[i]', let_sql('b', 'bounds[i + 1]', f"concat({plain}, {removed})"))})"""
    end = let_sql("z", "element_at(bounds, -1)", "substring(z.text, length(z.head) + 1)")
    whole = f"concat(array_join({middle}, ''), {end})"
    closed = f"if(size({segs}) % 2 = 0, concat({segs}, array('')), {segs})"
    return let_sql("all", closed, let_sql("sides", sides, let_sql("bounds", bounds, whole)))


def _spliced(segs: str) -> str:
    removal = _removal(
        last_line_sql(f"{segs}[at - 1]"),
        first_line_sql(f"coalesce(get({segs}, at + 1), '')"),
        f"{inner_newlines_sql(f'{segs}[at]')} > 0",
        f"endswith({segs}[at], chr(10))",
    )
    # Plain pieces stand between the removals i - 1 and i.
    piece = let_sql(
        "text",
        f"if(side.left is null, side.text, {_right_side('side.text', 'side.left')})",
        f"if(side.right is null, text, concat({_left_side('text', 'side.right')}, {_separator('side.right')}))",
    )
    sides = f"""transform(filter({segs}, (seg, i) -> i % 2 = 0),
        (text, i) -> named_struct('text', text, 'left', get(removals, i - 1), 'right', get(removals, i)))"""
    return let_sql(
        "removals",
        f"transform(sequence(1, size({segs}) - 1, 2), at -> {removal})",
        f"array_join(transform({sides}, side -> {piece}), '')",
    )
