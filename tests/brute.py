"""Plain Python statements of the expected results, one character position at a time."""

import bisect
import random

WHITE = set("\t\r\n ")
BLANK = {chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def blank(text):
    return all(c in BLANK for c in text)


def tokens(text, remove, keep):
    """(kind, start, stop) of every construct; an unclosed one has stop None and is the last."""
    ends = {'"': None, **dict(keep), '"""': '"""', **dict(remove)}
    i = 0
    while i < len(text):
        here = [tag for tag in ends if text.startswith(tag, i)]
        if not here:
            i += 1
            continue
        tag = max(here, key=len)
        kind = "remove" if tag in dict(remove) else "other"
        stop = i + len(tag)
        if kind == "other" and tag == '"' and tag not in dict(keep):
            while stop < len(text) and text[stop] != '"':
                stop += 2 if text[stop] == "\\" else 1
            stop = stop + 1 if stop < len(text) else None
        else:
            at = text.find(ends[tag], stop)
            stop = at + len(ends[tag]) if at >= 0 else None
            if stop is None and kind == "remove" and ends[tag] == "\n":
                stop = len(text)
        yield kind, i, stop
        if stop is None:
            return
        i = stop


def occurrences(text, remove, keep):
    """(first, last, first line, last line, text) of every merged occurrence."""
    ranges = []
    for kind, start, stop in tokens(text, remove, keep):
        if kind != "remove" or stop is None:
            continue
        if ranges and set(text[ranges[-1][1]:start]) <= WHITE:
            ranges[-1][1] = stop
        else:
            ranges.append([start, stop])
    breaks = [i for i, c in enumerate(text) if c == "\n"]

    def line_of(pos):
        return bisect.bisect_left(breaks, pos) + 1

    return [(a, b - 1, line_of(a), line_of(b - 1), text[a:b]) for a, b in ranges]


def without(text, occurrence):
    """``text`` without one occurrence, following the written rules."""
    first, last, line_first, line_last, comment = occurrence
    multi, line_comment = line_first < line_last, comment.endswith("\n")
    before = text[:first].split("\n")[-1]
    if line_comment or text[last:last + 1] == "\n":
        after = ""
    else:
        after = text[last + 1:].split("\n")[0]
    head, rest = text[:first], text[last + 1:]
    own_start, own_end = blank(before), blank(after)
    if own_start and (multi or own_end):
        head = head[:len(head) - len(before)]
    if own_end and (multi or own_start):
        rest = rest[len(after):]
    if multi and own_start and own_end:
        rest = rest.removeprefix("\r").removeprefix("\n")
    head = head.rstrip(" \t")
    if own_start:
        return head + rest
    if line_comment:
        return head + "\n" + rest
    if own_end:
        return head + rest
    if multi:
        return head + "\n" + rest
    return head + ("" if rest.startswith(" ") else " ") + rest


def cleaned(text, found):
    for occurrence in sorted(found, reverse=True):
        text = without(text, occurrence)
    return text


def random_texts(count, alphabet, longest=25, seed=7):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(count)})


def spans(text, pairs, fold=str):
    """(start tag, end tag, start, end, content) of tagged spans, up to the first that does not close."""
    low, found, i = fold(text), [], 0
    while i < len(text):
        start = next((s for s in pairs if low.startswith(fold(s), i)), None)
        if start is None:
            i += 1
            continue
        begin = i + len(start)
        stops = [(low.find(fold(e), begin), n, e) for n, e in enumerate(pairs[start]) if low.find(fold(e), begin) >= 0]
        if not stops:
            break
        at, _, end = min(stops)
        found.append((start, end, begin, at, text[begin:at]))
        i = at + len(end)
    return found


def stripped(text, pairs, fold=str):
    low, out, i = fold(text), [], 0
    while i < len(text):
        start = next((s for s in pairs if low.startswith(fold(s), i)), None)
        if start is None:
            out.append(text[i])
            i += 1
            continue
        i = min((at for at in (low.find(fold(e), i) for e in pairs[start]) if at >= 0), default=len(text))
    return "".join(out)


def masked(text, pairs, mask, fold=str):
    low, out, i = fold(text), [], 0
    while i < len(text):
        start = next((s for s in pairs if low.startswith(fold(s), i)), None)
        if start is None:
            out.append(text[i])
            i += 1
            continue
        begin = i + len(start)
        ends = [(low.find(fold(e), begin), n) for n, e in enumerate(pairs[start]) if low.find(fold(e), begin) >= 0]
        if ends:
            at, n = min(ends)
            stop = at + len(pairs[start][n])
        else:
            stop = len(text)
        out.append(mask * (stop - i))
        i = stop
    return "".join(out)
