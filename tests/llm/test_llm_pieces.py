import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from marginalia.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


def test_random_texts(own, library):
    rng = random.Random(6)
    parts = ["a", "b", "t", "h", "e", " ", "  ", "\n", "\t", "é", "ß", "▁", "日", "\0", "😀", "1", ",", "!!", "    ", "ing", "aaaa", "́", "<0x41>", "<s>"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert own.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_001, "ab aab" * 5000, "=" * 3001, "日" * 500, "\t" * 999, "aaab" * 2000])
def test_long_runs(own, library, text):
    assert own.encode(text).tolist() == library.encode(text)


def test_runs_of_blanks(own, library):
    for k in range(1, 80):
        assert own.encode(" " * k).tolist() == library.encode(" " * k)


def test_digests(awkward, library):
    want = []
    for r in awkward.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in pieces.digests(awkward, PATH).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_round_trip_of_tables(awkward, nothing):
    rows = pieces.decode(pieces.encode(awkward, PATH, name="piece_ids"), PATH, ids="piece_ids").collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert pieces.encode(nothing, PATH, name="piece_ids").count() == pieces.digests(nothing, PATH).count() == 0


def test_caches_have_bounds(monkeypatch):
    small = pieces.Pieces(PATH)
    monkeypatch.setattr(pieces, "_WORDS_KEPT", 10)
    first = small.learn({f"▁w{k}" for k in range(50)})
    assert len(first) == 50
    small.learn({"▁x", "y" * 100})
    assert len(small.known) <= 10 and "y" * 100 not in small.known


def test_hash_table_finds_every_pair(own):
    keys = own.keys
    assert np.array_equal(own.look_up(keys // own.width, keys % own.width), np.arange(len(keys)))
