"""The same results in DuckDB's SQL.

The statements follow another way than the engine: a text is cut at tags with
sentinel characters, every piece is a row, offsets are running sums, and
neighbours are merged as gaps and islands.
"""

from __future__ import annotations

import re

from marginalia.functions.patterns import RAW_STRING_QUOTE, STRING_QUOTE
from marginalia.rules import LINE_END, CommentRules
from workload import corpora as c

NL = "chr(10)"


def lit(text: str) -> str:
    """SQL text for any string."""
    parts = []
    for piece in re.split("([\n\r\t])", text):
        if piece in ("\n", "\r", "\t"):
            parts.append(f"chr({ord(piece)})")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts) if parts else "''"


def _tokens(rules: CommentRules) -> list[tuple[str, str, str]]:
    found = [(RAW_STRING_QUOTE, RAW_STRING_QUOTE, "keep"), (STRING_QUOTE, "", "string")]
    found += [(start, end, "remove") for start, end in rules.remove]
    found += [(start, end, "keep") for start, end in rules.keep]
    return sorted(found, key=lambda t: -len(t[0]))


def _regex(rules: CommentRules) -> str:
    shapes = []
    for start, end, kind in _tokens(rules):
        if kind == "string":
            shapes.append(r'"[^"\\]*(?:\\[\s\S][^"\\]*)*(?:"|\\?\z)')
        else:
            stop = r"\n" if end == LINE_END else re.escape(end)
            shapes.append(rf"{re.escape(start)}[\s\S]*?(?:{stop}|\z)")
    return "(" + "|".join(shapes) + ")"


def _is_removable(rules: CommentRules) -> str:
    cases = []
    for start, end, kind in _tokens(rules):
        if kind != "remove":
            value = "false"
        elif end == LINE_END:
            value = "true"
        else:
            value = f"ends_with(seg, {lit(end)}) AND length(seg) >= {len(start) + len(end)}"
        cases.append(f"WHEN starts_with(seg, {lit(start)}) THEN {value}")
    return f"i % 2 = 0 AND CASE {' '.join(cases)} ELSE false END"


def occurrences(corpus: c.Corpus) -> str:
    """Common table expressions up to ``occ``."""
    rules = corpus.rules
    return f"""
WITH corpus AS ({corpus.sql}),
cut AS (SELECT path, string_split_regex(regexp_replace(text, '{_regex(rules)}', chr(57344) || '\\1' || chr(57345), 'g'),
    '[' || chr(57344) || chr(57345) || ']') AS segs FROM corpus),
seg AS (SELECT path, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM cut),
kind AS (SELECT *, {_is_removable(rules)} AS rem FROM seg),
meta AS (SELECT path, i, rem, length(seg) AS len, length(seg) - length(replace(seg, {NL}, '')) AS nl,
    ends_with(seg, {NL})::int AS endnl,
    (NOT rem AND regexp_matches(seg, '[^\\t\\r\\n ]') OR (i % 2 = 0 AND NOT rem))::int AS brk FROM kind),
run AS (SELECT *, coalesce(sum(len) OVER w, 0) AS start, coalesce(sum(nl) OVER w, 0) AS l0,
    sum(brk) OVER (PARTITION BY path ORDER BY i) AS island FROM meta
    WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranges AS (SELECT path, min(start)::int AS first, (max(start + len) - 1)::int AS last, (min(l0) + 1)::int AS line_first,
    (max(l0 + nl - endnl) + 1)::int AS line_last FROM run WHERE rem GROUP BY path, island),
occ AS (SELECT r.*, substr(text, first + 1, last - first + 1) AS comment_text, text
    FROM ranges r JOIN corpus USING (path))"""


def context(corpus: c.Corpus) -> str:
    """... and ``ctx`` with the text around each occurrence on its lines."""
    return f"""{occurrences(corpus)},
ctx AS (SELECT *, string_split(substr(text, 1, first), {NL})[-1] AS before,
    CASE WHEN ends_with(comment_text, {NL}) THEN '' ELSE string_split(substr(text, last + 2), {NL})[1] END AS after
    FROM occ)"""


_BLANK = r"NOT regexp_matches({}, '[^\x09-\x0d\x1c-\x20\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')"


def cleaned(corpus: c.Corpus) -> str:
    """... and ``clean`` with one row per file that has occurrences."""
    return f"""{context(corpus)},
flag AS (SELECT *, line_first < line_last AS multi, ends_with(comment_text, {NL}) AS line_comment,
    {_BLANK.format('before')} AS bb, {_BLANK.format('after')} AS ab FROM ctx),
edge AS (SELECT *, first - CASE WHEN bb AND (multi OR ab) THEN length(before) ELSE 0 END AS f,
    last + CASE WHEN ab AND (multi OR bb) THEN length(after) ELSE 0 END AS l1 FROM flag),
cr AS (SELECT *, l1 + (multi AND ab AND bb AND substr(text, l1 + 2, 1) = chr(13))::int AS l2 FROM edge),
lf AS (SELECT *, l2 + (multi AND ab AND bb AND substr(text, l2 + 2, 1) = {NL})::int AS l FROM cr),
piece AS (SELECT *, rtrim(substr(text, coalesce(lag(l) OVER w, -1) + 2, f - coalesce(lag(l) OVER w, -1) - 1), ' ' || chr(9))
    || CASE WHEN bb THEN '' WHEN line_comment THEN {NL} WHEN ab THEN '' WHEN multi THEN {NL}
       WHEN starts_with(after, ' ') THEN '' ELSE ' ' END AS kept
    FROM lf WINDOW w AS (PARTITION BY path ORDER BY first)),
clean AS (SELECT path, count(*)::int AS comments,
    string_agg(kept, '' ORDER BY first) || substr(any_value(text), max(l)::int + 2) AS cleaned, any_value(text) AS text
    FROM piece GROUP BY path),
done AS (SELECT *, CASE WHEN cleaned = '' THEN 'file removed' WHEN comments = 1 THEN '1 comment removed'
    ELSE comments || ' comments removed' END AS label FROM clean)"""


def sections(corpus: c.Corpus) -> str:
    """... and ``section`` with plain and highlighted pieces of files with occurrences."""
    return f"""{occurrences(corpus)},
placed AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY path ORDER BY first), -1) AS before_last,
    row_number() OVER (PARTITION BY path ORDER BY first) AS k FROM occ),
tails AS (SELECT path, max(last) AS last, count(*) AS k, any_value(text) AS text FROM occ GROUP BY path),
section AS (
    SELECT path, (2 * k - 1)::int AS seq, substr(text, before_last + 2, first - before_last - 1) AS text, false AS highlight FROM placed
    UNION ALL SELECT path, (2 * k)::int, comment_text, true FROM placed
    UNION ALL SELECT path, (2 * k + 1)::int, substr(text, last + 2), false FROM tails WHERE last + 1 < length(text))"""


_ESCAPED = "{}"
for _plain, _html in (
    ("chr(13)", "''"),
    ("'&'", "'&amp;'"),
    ("'<'", "'&lt;'"),
    ("'>'", "'&gt;'"),
    ("chr(34)", "'&quot;'"),
    ("' '", "'&nbsp;'"),
    ("chr(9)", "'&nbsp;&nbsp;&nbsp;&nbsp;'"),
    ("chr(10)", "'<br/>'"),
):
    _ESCAPED = f"replace({_ESCAPED}, {_plain}, {_html})"


def markup(corpus: c.Corpus) -> str:
    return f"""{sections(corpus)},
markup AS (SELECT path, {NL} || '<h2 class="file">' || path || '</h2>' || {NL} || string_agg('<span class="'
    || CASE WHEN highlight THEN 'occurrence' ELSE 'plain' END || '">' || {_ESCAPED.format('text')} || '</span>' || {NL}, '' ORDER BY seq) AS html
    FROM section GROUP BY path)"""


def relative(corpus: c.Corpus, path: str = "path") -> str:
    return f"regexp_replace(substr({path}, {len(corpus.base) + 1}), '^\\\\?/?', '')"
