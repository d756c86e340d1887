import random
import re

import numpy as np
import pandas as pd
import xxhash
from marginalia.llm import simhash
from marginalia.llm.components import components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, radius=4):
    """Smallest index that links reach, for each fingerprint."""
    root = list(range(len(prints)))
    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            a, b = i, int(j)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    return [find(i) for i in range(len(prints))]


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(prints)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((str(i), f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, groups, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(awkward).collect())
    assert got == want


def test_one_of_each_keeps_the_smallest_id_and_all_columns(awkward):
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(awkward).collect()}
    left = simhash.one_of_each(awkward)
    assert left.columns == awkward.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == sorted({g for i, g in groups.items() if i is not None})


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def test_no_link_is_lost_in_crowded_keys(spark):
    """Chains and clouds of fingerprints, in keys far above the chunk size."""
    rng = random.Random(8)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(60):
            near = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                near ^= 1 << b
            prints.add(near)
        for _ in range(30):  # a chain: each differs from the last in 4 bits
            for b in rng.sample(range(64), 4):
                base ^= 1 << b
            prints.add(base)
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), chunk=16).collect()
    for r in links:
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 64  # links of a task join members of one component
    want = plain_groups(prints)
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    got = [find(p) for p in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_long_texts_in_portions(monkeypatch):
    text = " ".join(f"w{k * 7919 % 101}" for k in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 64)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000), 5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(rng, words, share):
    """A text and a copy with about ``share`` of its words replaced."""
    return " ".join(words), " ".join(f"z{rng.getrandbits(40)}" if rng.random() < share else w for w in words)


def plain_shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b)


def test_pairs_by_jaccard_that_differ_in_more_than_four_bits(spark):
    rng = random.Random(5)
    rows, wanted, others = [], [], []
    for k in range(150):
        a, b = variants(rng, [f"w{rng.getrandbits(30)}" for _ in range(300)], rng.choice([0.005, 0.015, 0.02, 0.05]))
        rows += [(2 * k, a), (2 * k + 1, b)]
        (wanted if jaccard(a, b) >= 0.8 else others).append(2 * k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5, similarity=0.8).collect()}
    narrow = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert wanted and others and len(got) == len(rows)
    assert sum(got[k + 1] == k for k in wanted) >= 0.95 * len(wanted) > sum(narrow[k + 1] == k for k in wanted)
    assert all(got[k + 1] == k + 1 for k in others)


def test_jaccard_forest_is_exact():
    rng = np.random.default_rng(6)
    for own in (None, np.arange(60) % 2):
        sets = [np.unique(rng.choice(40, rng.integers(1, 30))).astype(np.uint64) for _ in range(30)]
        sets += [np.setdiff1d(s, s[:1]) for s in sets]
        a, b = simhash.jaccard_forest(sets, 0.8, own)
        root = list(range(60))

        def find(x, root=root):
            return x if root[x] == x else find(root[x])

        for i in range(60):
            for j in range(i):
                if len(sets[i]) and len(sets[j]) and (own is None or own[i] != own[j]):
                    if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
        got = dict(zip(a.tolist(), b.tolist(), strict=True))
        assert [got.get(k, k) for k in range(60)] == [find(k) for k in range(60)]


def test_crowds_in_chunks_and_awkward_rows(spark, awkward, nothing):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, variants(rng, base, 0.01)[1]) for k in range(80)] + [(None, " ".join(base)), (90, "a b"), (91, "A  b"), (92, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, simhash.near_duplicates(docs, width=5, similarity=0.8).collect()))
    parted = simhash.similar_texts(docs, "text", "doc_id", 0.8, 5, chunk=8, crowd=3000).collect()
    assert sorted(map(str, parted)) == whole
    alone = {i for i, x in rows[:80] if max(jaccard(x, y) for j, y in rows if j != i) < 0.8}
    group = {r.doc_id: r.component_id for r in parted}
    assert group == {**{k: k if k in alone else 0 for k in range(80)}, None: 0, 90: 90, 91: 90, 92: 92} and 0 not in alone
    got = simhash.near_duplicates(awkward, width=5, similarity=0.8).collect()
    assert len(got) == awkward.count()
    by_words = {}
    for r in awkward.where("doc_id is not null").collect():
        by_words.setdefault(" ".join((r.text or "").lower().split()), set()).add(r.doc_id)
    group = {r.doc_id: r.component_id for r in got}
    assert all(len({group[i] for i in same}) == 1 for same in by_words.values())
    assert simhash.one_of_each(nothing, width=5, similarity=0.8).count() == 0


def test_wide_pairs_go_by_the_distances_to_the_references(monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2, (30, 128))
    bits = np.concatenate([base, *[base ^ (rng.random(base.shape) < 0.06) for _ in range(9)]]).astype(np.uint8)
    halves = np.packbits(bits, axis=1).view(np.int64)
    halves = halves[np.unique(halves[:, 0], return_index=True)[1]]  # a node is told by its first half
    prints = halves.view(np.uint64)
    pivots = simhash.wide_pivots()
    assert pivots.shape == (16, 2)
    table = np.bitwise_count(prints[:, None] ^ pivots).sum(axis=2, dtype=np.int64)
    own = rng.integers(0, 2, len(halves))
    for radius in (6, 20):
        for cross in (False, True):
            frame = pd.DataFrame({"cell": 1, "own": own, "cross": cross, "d0": table[:, 0], "f1": halves[:, 0], "f2": halves[:, 1]})
            measured = []
            apart = simhash._apart

            def spy(a1, a2, b1, b2, measured=measured, apart=apart):
                if np.ndim(b1):
                    measured.append(len(a1))
                return apart(a1, a2, b1, b2)

            monkeypatch.setattr(simhash, "_apart", spy)
            sorted_ = frame.sort_values("d0")
            links = pd.concat(simhash._wide_links(iter([sorted_.iloc[:100], sorted_.iloc[100:]]), radius))
            monkeypatch.setattr(simhash, "_apart", apart)
            far = np.abs(table[:, None] - table).max(axis=2)
            pair = np.triu(~(cross & (own[:, None] == own)), 1)
            assert sum(measured) == (pair & (far <= radius)).sum() < pair.sum()  # the others are discarded by the references
            root = {f: f for f in halves[:, 0].tolist()}

            def find(x, root=root):
                return x if root[x] == x else find(root[x])

            for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
                root[find(a)] = find(b)
            got = [find(f) for f in halves[:, 0].tolist()]
            near = pair & (np.bitwise_count(prints[:, None] ^ prints).sum(axis=2) <= radius)
            want = list(range(len(halves)))
            for a, b in zip(*np.nonzero(near), strict=True):
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
            assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
