"""Licence notices and identifiers.

An Aho-Corasick automaton finds notice phrases among the words of a text; expressions after an identifier tag are
parsed by a shunting-yard parser and evaluated against the permissive identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marginalia.llm.common import ship, words_of

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases: label, and how sure a licence is if only this phrase is there.
PHRASES = {
    "apache license": ("apache", 0.9),
    "boost software license": ("bsl", 0.9),
    "bsd license": ("bsd", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc0": ("cc0", 0.9),
    "copyright": ("copyright", 0.3),
    "creative commons": ("cc", 0.7),
    "dedicated to the public domain": ("public-domain", 0.9),
    "eclipse public license": ("epl", 0.9),
    "isc license": ("isc", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "licensed under": ("licensed", 0.5),
    "mit license": ("mit", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "released under": ("licensed", 0.4),
    "spdx license identifier": ("spdx", 0.5),
}
BASE_SURE = {"cc-by": 0.9, "gpl": 0.9, "reserved": 0.8}
#: Identifiers, in lower case, that ask for no more than a notice.
PERMISSIVE = frozenset({"0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"})
_TAG = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9.+:\-]+))")
_BINDS = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """A licence expression that cannot be read."""


def postfix(expression: str) -> list[str]:
    """The expression's identifiers and operators in postfix order, by the shunting-yard method, in lower case."""
    out: list[str] = []
    waiting: list[str] = []
    want_name, at = True, 0
    expression = expression.rstrip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}")
        at = m.end()
        token = (m[1] or m[2]).lower()
        if token == "(":
            if not want_name:
                raise ExpressionError("operator expected")
            waiting.append(token)
        elif token == ")":
            if want_name:
                raise ExpressionError("identifier expected")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ExpressionError("no opening bracket")
            waiting.pop()
        elif token in _BINDS:
            if want_name:
                raise ExpressionError("identifier expected")
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            want_name = True
        else:
            if not want_name:
                raise ExpressionError("operator expected")
            out.append(token)
            want_name = False
    if want_name or "(" in waiting:
        raise ExpressionError("incomplete")
    return out + waiting[::-1]


def evaluate(order: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, set[str]]:
    """Whether the allowed identifiers satisfy a postfix expression, and the identifiers in it.

    ``and`` wants both sides, ``or`` one; an exception behind ``with`` only adds permissions, so it changes nothing."""
    stack: list[bool] = []
    names: set[str] = set()
    for k, token in enumerate(order):
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if token == "and" else a or b if token == "or" else a)
        else:
            stack.append(token in allowed)
            if not (k + 1 < len(order) and order[k + 1] == "with"):
                names.add(token)
    return stack[0], names


@lru_cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **PHRASES}:
        found.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    found.make_automaton()
    return found


def examine(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive) of a whole text."""
    words = words_of(text)
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    n_base, first, last, base, more, doubt = 0, None, None, set(), set(), 1.0
    at = index = 0
    for end, (phrase, size) in _automaton().iter(joined):
        if phrase in BASE:
            start = end - size + 1
            # matches come by their ends; of nested phrases a later one may begin earlier
            index = index + joined.count(" ", at, start) if start >= at else index - joined.count(" ", start, at)
            at = start
            n_base += 1
            first = index if first is None else min(first, index)
            last = index if last is None else max(last, index)
            if BASE[phrase] not in base:
                doubt *= 1 - BASE_SURE[BASE[phrase]]
            base.add(BASE[phrase])
        else:
            label, sure = PHRASES[phrase]
            if label not in more:
                doubt *= 1 - sure
            more.add(label)
    permissive = None
    if "spdx" in more:
        for m in _TAG.finditer(text or ""):
            try:
                fine, names = evaluate(postfix(m[1].strip(" \t*/#<>!-")))
            except ExpressionError:
                continue
            permissive = fine if permissive is None else permissive and fine
            more |= {n.replace(",", "") for n in names}
            doubt = 0.0
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), 1 - doubt, permissive


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive) for every row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; n_base counts all places of base
    phrases, first_word and last_word are their smallest and largest first words (null without one). ``score`` is
    how sure it is that the text bears a notice, 1 with a readable identifier tag. ``permissive`` tells whether all
    readable expressions of the text can be met by permissive licences; null without one. Null and empty texts have
    no words and score 0. One pass without a shuffle; rows do not depend on each other, and other columns play no part.
    """
    ship(docs.sparkSession)
    slim = docs.select(doc_id, text)
    kinds = {
        "n_words": (T.LongType(), pa.int64()), "n_base": (T.LongType(), pa.int64()), "first_word": (T.LongType(), pa.int64()),
        "last_word": (T.LongType(), pa.int64()), "base_labels": (T.StringType(), pa.string()), "labels": (T.StringType(), pa.string()),
        "score": (T.DoubleType(), pa.float64()), "permissive": (T.BooleanType(), pa.bool_()),
    }
    schema = T.StructType([T.StructField("doc_id", slim.schema[0].dataType), *[T.StructField(n, k) for n, (k, _) in kinds.items()]])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            cols = list(zip(*[examine(t) for t in b.column(1).to_pylist()], strict=True)) or [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, (_, k) in zip(cols, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *kinds])

    return slim.mapInArrow(run, schema)
