"""States of the scan between the chunks of a text that is cut into many rows.

A text that is cut can be scanned chunk by chunk once it is known in which construct each chunk begins: plain text, a
string, a kept or removed block, a line. What a chunk does to each state that it may begin in is worked out without its
neighbours (a transition: for every state the one at the chunk's end); transitions compose, so the states at all cuts
follow from numbers alone, and then each chunk is cut into its pieces from its one true state.

Cuts stand behind a character that no tag has and that is no backslash, so no tag and no escape is ever parted.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from marginalia.functions.patterns import RAW_STRING_QUOTE, STRING_QUOTE
from marginalia.rules import LINE_END, CommentRules

PLAIN = 0
#: What may stand between comments that are merged.
_BETWEEN = "\t\r\n "


@dataclass(frozen=True)
class Construct:
    start: str
    end: str
    removed: bool
    escapes: bool = False


@dataclass(frozen=True)
class Part:
    """An occurrence, or the part of one in a chunk, or white space at a chunk's edge that may part two of them.

    ``at_edge``: what follows or comes before it in the neighbouring chunk may belong to the same occurrence.
    """

    first: int
    text: str
    comment: bool
    at_edge: bool


class Lexer:
    """The constructs of some rules, numbered from 1; 0 is plain text."""

    def __init__(self, rules: CommentRules) -> None:
        remove = dict(rules.remove)
        keep = {start: end for start, end in rules.keep if start not in remove}
        if RAW_STRING_QUOTE not in remove:
            keep[RAW_STRING_QUOTE] = RAW_STRING_QUOTE
        found = [Construct(s, e, True) for s, e in remove.items()] + [Construct(s, e, False) for s, e in keep.items()]
        if STRING_QUOTE not in remove and STRING_QUOTE not in keep:
            found.append(Construct(STRING_QUOTE, STRING_QUOTE, False, escapes=True))
        self.constructs = found
        self.number = {c.start: k for k, c in enumerate(found, 1)}
        self.starts = re.compile("|".join(re.escape(s) for s in sorted(self.number, key=lambda s: (-len(s), s))))
        self.string = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
        #: Characters that a cut may not stand behind.
        self.tight = frozenset("\\").union(*(c.start + c.end for c in found))

    def states(self) -> int:
        return len(self.constructs) + 1

    def closes(self, state: int) -> bool:
        """Whether a construct that is open at the end of the text is no comment: a removed block has to end."""
        return state != PLAIN and self.constructs[state - 1].removed and self.constructs[state - 1].end != LINE_END

    def end(self, text: str, at: int, state: int) -> int:
        """The place behind the construct that is open at ``at``, or -1."""
        own = self.constructs[state - 1]
        if own.escapes:
            found = self.string.match(text, at)
            return found.end() if found else -1
        found = text.find(own.end, at)
        return found + len(own.end) if found >= 0 else -1

    def walk(self, text: str, at: int = 0, state: int = PLAIN) -> Iterator[tuple[int, int, int, bool]]:
        """(begin, end, state, closed) of plain text and constructs in turn; plain text may be empty. The last one is not closed."""
        begin = at
        while True:
            if state == PLAIN:
                found = self.starts.search(text, at)
                if not found:
                    yield begin, len(text), PLAIN, False
                    return
                yield begin, found.start(), PLAIN, True
                begin, at, state = found.start(), found.end(), self.number[found.group()]
            else:
                at = self.end(text, at, state)
                if at < 0:
                    yield begin, len(text), state, False
                    return
                yield begin, at, state, True
                begin, state = at, PLAIN

    def transition(self, text: str) -> list[int]:
        """For each state at the start: twice the state at the end, and 1 more if the construct of the start is left.

        Walks from different states meet as soon as one is in plain text where the other is; the rest is the same.
        """
        plain, last = [], PLAIN
        for begin, end, state, _ in self.walk(text):
            last = state
            if state == PLAIN:
                plain.append((begin, end))
        out = [2 * last]
        known: dict[int, int] = {}
        for start in range(1, self.states()):
            at = self.end(text, 0, start)
            if at < 0:
                out.append(2 * start)
                continue
            path, result = [], None
            for begin, end, state, closed in self.walk(text, at):
                if state == PLAIN:
                    here = bisect_right(plain, (begin, len(text) + 1)) - 1
                    if here >= 0 and begin <= plain[here][1]:
                        result = last
                    elif begin in known:
                        result = known[begin]
                    if result is not None:
                        break
                    path.append(begin)
                if not closed:
                    result = state
            for p in path:
                known[p] = result
            out.append(2 * result + 1)
        return out

    def parts(self, text: str, state: int, open_is_plain: bool) -> list[Part]:
        """The occurrences in a chunk that begins in ``state``, and what at its edges may belong to some.

        ``open_is_plain``: the construct that is open at the chunk's end is never closed and so is no comment.
        """
        runs: list[list[tuple[int, int, bool]]] = [[]]  # what only white space parts
        for begin, end, own, closed in self.walk(text, 0, state):
            comment = own != PLAIN and self.constructs[own - 1].removed and (closed or not (open_is_plain and self.closes(own)))
            if comment or (own == PLAIN and not text[begin:end].strip(_BETWEEN)):
                if end > begin:
                    runs[-1].append((begin, end, comment))
            else:
                runs.append([])
        out = []
        for k, run in enumerate(runs):
            left, right = k == 0, k == len(runs) - 1
            while run and not run[0][2] and not left:
                run.pop(0)
            while run and not run[-1][2] and not right:
                run.pop()
            if not run:
                continue
            comments = [i for i, (_, _, c) in enumerate(run) if c]
            if not comments:
                out.append(Part(run[0][0], text[run[0][0] : run[-1][1]], False, True))
                continue
            first, last = run[comments[0]][0], run[comments[-1]][1]
            if left and run[0][0] < first:
                out.append(Part(run[0][0], text[run[0][0] : first], False, True))
            out.append(Part(first, text[first:last], True, left or right))
            if right and last < run[-1][1]:
                out.append(Part(last, text[last : run[-1][1]], False, True))
        return out
