import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from marginalia.llm import alignment, queries
from tokenizers import Tokenizer

FILES = (queries.BYTE_TOKENIZER, queries.PIECE_MODEL, public_tokenizers.PATTERN)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def characters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(rows, libraries):
    """All columns of (doc_id, text) rows, byte range by byte range."""
    a, b = libraries
    byte_of = characters()
    per, counts = [], Counter()
    for doc_id, text in rows:
        sides = [[], []]
        if text:
            for i in a.encode(" " + text, add_special_tokens=False).ids:
                sides[0].append((i, bytes(byte_of[c] for c in a.id_to_token(i))))
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                sides[1].append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
                sides = [[], []]
        spans = []
        for side in sides:
            at, own = 0, []
            for i, raw in side:
                own.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links, start = [], 0
        for s, e, i in spans[0]:
            while start < len(spans[1]) and spans[1][start][1] <= s:
                start += 1
            k = start
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        groups, places = [], [0, 0]
        for end in ends:
            sides_text = []
            for k in (0, 1):
                first = places[k]
                while places[k] < len(spans[k]) and spans[k][places[k]][1] <= end:
                    places[k] += 1
                sides_text.append(",".join(str(i) for _, _, i in spans[k][first : places[k]]))
            groups.append("|".join(sides_text))
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        per.append((doc_id, len(spans[0]), len(spans[1]), len(ends), links, digest))
    highest = {}
    for (_, j), c in counts.items():
        highest[j] = max(c, highest.get(j, 0))
    return sorted(
        ((d, na, nb, ng, len(ls), sum(counts[p] == highest[p[1]] for p in ls), sum(counts[p] for p in ls), h) for d, na, nb, ng, ls, h in per), key=str
    )


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_awkward_rows(awkward, libraries, head):
    """With all counts sent to the tasks, with most of them joined, and with all of them joined."""
    want = plain([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], libraries)
    assert rows_of(alignment.aligned(awkward, *FILES, head_pairs=head)) == want


def test_whole_table(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert rows_of(queries.op12_alignment(spark, sf_dir)) == plain([tuple(r) for r in docs.collect()], libraries)


def test_ids_are_those_of_the_libraries(libraries):
    a, b = libraries
    both = alignment.tokenizers(*FILES)
    rng = random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "23", ",", "é", "日本", "　", "\xa0", "<|endoftext|>", "<s>", "<0x41>", "▁", "\x85", "😀", "...", "\r\n", "\0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(4000)]
    for text, got in zip(texts, both.encode(texts), strict=True):
        right = b.encode(text)
        same = b"".join(both.bytes_b[i] for i in right) == (" " + text).encode()
        assert got == ((a.encode(" " + text, add_special_tokens=False).ids, right) if same else ([], []))


def test_stretches_of_random_ends():
    rng = random.Random(9)
    for _ in range(500):
        last = rng.randint(1, 120)
        sides = [sorted({*rng.sample(range(1, last + 1), rng.randint(0, last)), last}) for _ in range(2)]
        if rng.random() < 0.5:  # long equal stretches
            sides[1] = sorted({*sides[0], *rng.sample(range(1, last + 1), min(2, last))})
        stretches, left, right = alignment.align(*sides)
        common = set(sides[0]) & set(sides[1])
        assert sum(run or 1 for _, _, run in stretches) == len(common)
        starts = [[0, *side[:-1]] for side in sides]
        want = [(i, j) for i in range(len(sides[0])) for j in range(len(sides[1])) if starts[0][i] < sides[1][j] and starts[1][j] < sides[0][i]]
        assert list(zip(left, right, strict=True)) == want


def test_half_a_surrogate_pair_has_no_tokens():
    assert alignment.tokenizers(*FILES).encode(["a\ud800", None, "", "x"])[:3] == [([], [])] * 3


def test_empty_table(nothing):
    frame = alignment.aligned(nothing, *FILES)
    assert frame.columns == COLUMNS and frame.count() == 0
