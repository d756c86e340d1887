import random
import time

import numpy as np
import pytest
from marginalia.llm import minhash, queries
from marginalia.llm.setlinks import linked_sets


def plain_sets(text, width=3):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def groups_of(sets, share=(17, 20)):
    """Smallest index that links reach, for each set; empty sets reach themselves alone."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and share[1] * common >= share[0] * (len(a) + len(sets[j]) - common):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def plain(rows):
    sets = [plain_sets(t) for _, t in rows]
    groups = groups_of(sets)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    out = []
    for (i, _), s, g in zip(rows, sets, groups, strict=True):
        component = least.get(g) if s else i
        out.append((i, len(s), component, i == component))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def near_copies(n, rng, words=120, changes=4):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert rows_of(minhash.near_duplicates(awkward)) == plain(rows)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 16, "crowd_shingles": 4000}])
def test_groups_of_near_copies(spark, sizes):
    """Clouds around the threshold, chains of small changes, in one task and dealt out as chunks."""
    rng = random.Random(5)
    texts = [t for n in (70, 40, 9) for t in near_copies(n, rng)]
    chain = [f"c{k}" for k in range(150)]
    for k in range(40):
        chain[rng.randrange(150)] = f"d{k}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **sizes))
    assert got == plain(rows)
    assert 4 < len({r[2] for r in got}) < len(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert rows_of(queries.op13_minhash(spark, sf_dir)) == plain([tuple(r) for r in docs.collect()])


def test_one_of_each_keeps_the_smallest_id_and_all_columns(awkward):
    left = minhash.one_of_each(awkward)
    assert left.columns == awkward.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == sorted({r[0] for r in rows_of(minhash.near_duplicates(awkward)) if r[3] and r[0] is not None})


def test_empty_table(nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.one_of_each(nothing).count() == 0


def test_links_of_sets_against_all_pairs():
    rng = random.Random(3)
    for share in ((17, 20), (4, 5)):
        for own in (None, 3):
            pool = [rng.getrandbits(64) for _ in range(60)]
            sets = [set(rng.sample(pool, rng.randint(0, 40))) for _ in range(30)]
            for _ in range(40):
                one = set(rng.choice(sets))
                one ^= set(rng.sample(pool, rng.randint(0, 4)))
                sets.append(one)
            chunks = np.array([k % own for k in range(len(sets))]) if own else None
            a, b = linked_sets([np.array(sorted(s), np.uint64) for s in sets], share, chunks)
            root = list(range(len(sets)))
            for i in range(len(sets)):
                for j in range(i):
                    common = len(sets[i] & sets[j])
                    if sets[i] and share[1] * common >= share[0] * len(sets[i] | sets[j]) and (own is None or chunks[i] != chunks[j]):
                        low, high = sorted((root[i], root[j]))
                        root = [low if r == high else r for r in root]
            got = list(range(len(sets)))
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                got[x] = y
            assert got == root


def test_thousands_of_near_copies_take_seconds():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for kept in (480, 440):  # nearly all link, and hardly any
        sets = [np.unique(np.r_[rng.permutation(base)[:kept], rng.integers(0, 2**63, 500 - kept, dtype=np.uint64)]) for _ in range(8000 if kept == 480 else 2500)]
        start = time.perf_counter()
        a, _ = linked_sets(sets, (4, 5))
        assert time.perf_counter() - start < 30
        assert (len(a) == len(sets) - 1) == (kept == 480)
