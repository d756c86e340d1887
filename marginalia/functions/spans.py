"""Tagged regions of a text: take them out, strip them, mask them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrays import let, literal, running_sum_sql
from marginalia.functions.patterns import closed_span, open_spans, span_tiles, start_tag

Pairs = Mapping[str, str | Sequence[str]]


def _pairs(tags: Pairs) -> dict[str, list[str]]:
    pairs = {start: [ends] if isinstance(ends, str) else list(ends) for start, ends in tags.items()}
    if not pairs or "" in pairs or any(not ends or "" in ends for ends in pairs.values()):
        raise ValueError("start and end tags may not be empty")
    return pairs


def extract_spans(text: Column, tags: Pairs, ignore_case: bool = False) -> Column:
    """Tagged spans: tags, content, and the content's start (inclusive) and end (exclusive) offset.

    The earliest start tag opens a span, the nearest of its end tags closes it; of tags
    at one place the one listed first wins.  A start tag that is never closed ends the search.
    """
    pairs = _pairs(tags)
    tiles = F.regexp_extract_all(text, F.lit(span_tiles(pairs, ignore_case=ignore_case)), F.lit(0))
    # Only the last tile can be a span that never closes.
    closed = f"i < size(tiles) - 1 or rlike(tile, {literal(closed_span(pairs, ignore_case=ignore_case))})"
    return let(
        tiles,
        f"""tiles -> transform(
            filter(
                zip_with(
                    transform(tiles, (tile, i) -> if({_opens("tile", pairs, ignore_case)} and ({closed}), tile, null)),
                    {running_sum_sql("transform(tiles, tile -> length(tile))", "0")},
                    (span, at) -> named_struct('span', span, 'at', at, 'tag', {_tags_of('span', pairs, ignore_case)})),
                piece -> piece.span is not null),
            piece -> named_struct(
                'start_tag', piece.tag.start_tag,
                'end_tag', piece.tag.end_tag,
                'start_pos', piece.at + length(piece.tag.start_tag),
                'end_pos', piece.at + length(piece.span) - length(piece.tag.end_tag),
                'content', substring(piece.span, length(piece.tag.start_tag) + 1,
                    length(piece.span) - length(piece.tag.start_tag) - length(piece.tag.end_tag))))""",
    )


def _opens(tile: str, pairs: Mapping[str, Sequence[str]], ignore_case: bool) -> str:
    """SQL text that is true for tiles that begin with a start tag, which plain ones never do."""
    return f"rlike({tile}, {literal(start_tag(pairs, ignore_case=ignore_case))})"


def _tags_of(span: str, pairs: Mapping[str, Sequence[str]], ignore_case: bool) -> str:
    """SQL text that tells the start and the end tag of a span, in the order in which tags win."""

    def folded(text: str) -> str:
        return f"upper({text})" if ignore_case else text

    cases = [
        f"when startswith({folded(span)}, {folded(literal(start))}) and endswith({folded(span)}, {folded(literal(end))}) "
        f"and length({span}) >= {len(start) + len(end)} "
        f"then named_struct('start_tag', {literal(start)}, 'end_tag', {literal(end)})"
        for start in pairs
        for end in sorted(pairs[start], key=len, reverse=True)
    ]
    return f"case {' '.join(cases)} end"


def strip_spans(text: Column, tags: Pairs, ignore_case: bool = False) -> Column:
    """``text`` without its tagged regions; the end tags stay (``a<b>c`` -> ``a>c``).

    A region that never closes is stripped to the end of the text.
    """
    pairs = _pairs(tags)
    fold = str.lower if ignore_case else str
    for start, ends in pairs.items():
        for end in ends:
            if fold(start).startswith(fold(end)) or fold(end).startswith(fold(start)):
                raise ValueError(f"{start!r} and {end!r}: one tag may not begin with the other")
    return F.regexp_replace(text, open_spans(pairs, ignore_case=ignore_case), "")


def mask_spans(text: Column, tags: Pairs, mask: str, ignore_case: bool = False) -> Column:
    """``text`` with every tagged region, tags included, overwritten by ``mask`` characters.

    The result is as long as the text, so offsets stay valid; the mask is one character.
    """
    if len(mask) != 1:
        raise ValueError(f"the mask has to be one character, not {mask!r}")
    pairs = _pairs(tags)
    tiles = F.regexp_extract_all(text, F.lit(span_tiles(pairs, ignore_case=ignore_case)), F.lit(0))
    masked = f"if({_opens('tile', pairs, ignore_case)}, repeat({literal(mask)}, length(tile)), tile)"
    return F.array_join(F.call_function("transform", tiles, F.expr(f"tile -> {masked}")), "")
