import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from marginalia.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, pieces, tokenizer, length):
    ids = {}
    for i, text in rows:
        ids[i] = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at, copies = 0, [r for r, _ in rows].count(i)
        own.sort(key=lambda p: p.start)
        assert sum(p.length for p in own) == copies * len(ids[i])
        for p in own:
            assert p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes())
            assert p.ids == ids[i][p.start : p.start + p.length].tolist()
            if copies == 1:
                assert p.start == at
                at += p.length
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        total = sum(p.length for p in own)
        assert total <= length and total & (total - 1) == 0  # no sequence needs padding


@pytest.mark.parametrize(("length", "window"), [(2048, 256), (64, 4), (8, 2)])
def test_every_id_lies_in_one_piece(awkward, tokenizer, length, window):
    docs = awkward.where("doc_id is not null").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, packing.pack(docs, PATH, length=length, window=window).collect(), tokenizer, length)


def test_null_ids_and_texts(awkward):
    pieces = packing.pack(awkward.where("doc_id is null"), PATH).collect()
    assert sorted(p.doc_tokens for p in pieces if p.start == 0) == [1, 4]


def test_empty_table(nothing):
    assert packing.pack(nothing, PATH).count() == 0


def test_words_are_encoded_as_whole_texts_are(tokenizer):
    encoder = packing.Encoder(PATH)
    texts = ["It's A test of <|endoftext|>x", "Ünḯ  cöde\x1c\x85é", "a" * 5000, "1234 ... !!??", "日本語 テスト", "ΣΑΣ σας", None, " ", "Straße ÀÉÎ x÷y×z µ ª º İ Ÿ",
             "e\u0301 é “quoted” we'll WE'VE can't'd ''s '!s", "a\x0bb\x1dc\u2028d\xa0e", "<|startoftext|> x", "１２ Ⅷ ½ 3²", "_under_score__ a_b"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert max(map(len, encoder.known)) <= 128


def test_random_words_are_encoded_as_whole_texts_are(tokenizer):
    encoder = packing.Encoder(PATH)
    rng = np.random.default_rng(4)
    parts = ["a", "B", "é", "É", "'s", "'", "1", ".", "!", " ", "\n", "the", "ß", "日", "“", "\u0301", "_", "'LL", "\xa0", "\x1c", "÷", "😀"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(1500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    for text, ids in zip(texts, got, strict=True):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [1], repr(text)


def test_assignment_balances_costs_and_fills():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 200).tolist()
    total = sum(sizes)
    limits = [2048] * (total // 2048) + packing.powers(total % 2048)
    dealt = packing.assign(sizes, limits)
    assert [sum(n for _, _, n in x) for x in dealt] == limits
    costs = [sum(packing.cost(n) for _, _, n in x) for x, m in zip(dealt, limits, strict=True) if m == 2048]
    assert max(costs) < 1.5 * min(costs)
    whole = sum(1 for x in dealt for _, _, n in x)
    assert whole < 200 + 2 * len(limits)  # few documents are cut


def test_encoder_is_let_go_by_the_next_job(spark, awkward):
    """A worker that packed texts holds no encoder in a task of another job."""
    docs = awkward.where("doc_id is not null").select("doc_id", "text").repartition(8)
    assert packing.pack(docs, PATH).count() > 0

    def left(batches):
        import gc

        import pyarrow as pa
        from marginalia.llm.packing import Encoder

        for _ in batches:
            pass
        gc.collect()
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(isinstance(x, Encoder) for x in gc.get_objects())], pa.int64())})

    assert [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(left, "n long").collect()] == [0] * 8


def test_portions_hold_all_rows_in_order():
    import pyarrow as pa
    from marginalia.llm.common import portions

    batches = [pa.RecordBatch.from_pydict({"n": pa.array(range(lo, hi), pa.int64())}) for lo, hi in ((0, 2500), (2500, 2500), (2500, 3100))]
    found = list(portions(iter(batches), 1000))
    assert [b.num_rows for b in found] == [1000, 1000, 500, 600]
    assert [n for b in found for n in b.column(0).to_pylist()] == list(range(3100))
