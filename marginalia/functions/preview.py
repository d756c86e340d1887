"""Previews of occurrences and of whole files as text and as markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes and marks of the previews.
ONE_LINE_LENGTH = 40
LINES_AT_START = 2
LINES_AT_END = 2
INDENT = "    "
CUT = "[...]"
ELLIPSIS = "..."
NO_COMMENTS = '<span class="plain">(No comments to be removed)</span>'


def one_line(relative_path: Column, line: Column, comment_text: Column) -> Column:
    """``path:line> beginning of the comment``."""
    shown = F.replace(F.replace(comment_text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))
    short = F.concat(F.substring(shown, 1, ONE_LINE_LENGTH - len(ELLIPSIS)), F.lit(ELLIPSIS))
    shown = F.when(F.length(shown) > ONE_LINE_LENGTH, short).otherwise(shown)
    return F.concat(relative_path, F.lit(":"), line.cast("string"), F.lit("> "), shown)


def multi_line(relative_path: Column, first_line: Column, last_line: Column, comment_text: Column) -> Column:
    """``path:first-last>`` and the comment's lines; of a long one the first and the last two."""
    plain = F.replace(F.replace(comment_text, F.lit("\r"), F.lit("")), F.lit("\t"), F.lit("    "))
    lines = F.split(F.regexp_replace(plain, r"\n\z", ""), "\n", -1)
    cut = F.concat(
        F.slice(lines, 1, LINES_AT_START), F.array(F.lit(CUT)), F.slice(lines, -LINES_AT_END, LINES_AT_END)
    )
    shown = F.when(F.size(lines) <= LINES_AT_START + 1 + LINES_AT_END, lines).otherwise(cut)
    header = F.concat(relative_path, F.lit(":"), first_line.cast("string"), F.lit("-"), last_line.cast("string"), F.lit(">"))
    return F.concat(header, F.lit("\n" + INDENT), F.array_join(shown, "\n" + INDENT))


def sections(segments: Column) -> Column:
    """Plain and highlighted sections of a scanned text, numbered from 1; a plain one at the end only if not empty."""
    numbered = F.transform(
        segments,
        lambda text, i: F.struct((i + 1).alias("seq"), text.alias("text"), (i % 2 == 1).alias("highlight")),
    )
    return F.filter(numbered, lambda s, i: (s["text"] != "") | (i < F.size(segments) - 1))


def escape_markup(text: Column) -> Column:
    # Replacements in the order in which they apply.
    replacements = (
        ("\r", ""),
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        (" ", "&nbsp;"),
        ("\t", "&nbsp;&nbsp;&nbsp;&nbsp;"),
        ("\n", "<br/>"),
    )
    for plain, escaped in replacements:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def section_markup(text: Column, highlight: Column) -> Column:
    css_class = F.when(highlight, "occurrence").otherwise("plain")
    return F.concat(F.lit('<span class="'), css_class, F.lit('">'), escape_markup(text), F.lit("</span>\n"))


def file_markup(path: Column, segments: Column) -> Column:
    """Title and sections of one file."""
    title = F.concat(F.lit('\n<h2 class="file">'), path, F.lit("</h2>\n"))
    body = F.transform(sections(segments), lambda s: section_markup(s["text"], s["highlight"]))
    return F.concat(title, F.array_join(body, ""))
