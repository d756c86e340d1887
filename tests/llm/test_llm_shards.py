import random
import zlib
from collections import defaultdict

from marginalia.llm import shards


def test_awkward_rows(awkward):
    rows = awkward.collect()
    got = shards.shard(awkward, bundles=64).collect()
    want = sorted(str((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r.slot)
        homes[r.text_crc32].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())  # no group of copies is larger than a shard here
    assert set(slots) <= set(range(8))


def test_sizes_are_near_equal_and_a_huge_group_is_cut(spark):
    rng = random.Random(1)
    rows = [(k, "same text " * 20) for k in range(600)] + [(1000 + k, "x" * rng.randint(0, 300) + str(k)) for k in range(1500)]
    rows += [(9000 + k, None) for k in range(700)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), bundles=512).collect()
    sums = defaultdict(int)
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(got) == len(rows) and len(sums) == 8
    assert max(sums.values()) < 1.02 * min(sums.values())


def test_capacity(spark):
    rows = [(k, "y" * (k % 90)) for k in range(3000)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=None, capacity=20_000).collect()
    sums = defaultdict(int)
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) <= 20_000
    assert len(sums) <= sum(sums.values()) // 20_000 + 2


def test_empty_table(nothing):
    assert shards.shard(nothing).count() == 0


def test_tree_against_a_sorted_list():
    rng = random.Random(5)
    tree, plain = shards.RoomTree(), []
    for k in range(3000):
        if plain and rng.random() < 0.5:
            size = rng.randint(0, 120)
            want = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            if want:
                plain.remove(want)
        elif plain and rng.random() < 0.1:
            most = max(x[0] for x in plain)
            want = min(x for x in plain if x[0] == most)
            assert tree.take_widest() == want
            plain.remove(want)
        else:
            x = (rng.randint(0, 100), k)
            tree.add(*x)
            plain.append(x)


def test_best_fit_decreasing_is_the_textbook_one():
    sizes = dict(enumerate([7, 6, 5, 4, 3, 3, 2]))
    homes = shards.best_fit_decreasing(sizes, 10)
    assert max(homes.values()) == 2  # 7+3, 6+4, 5+3+2
    assert shards.best_fit_decreasing({0: 50, 1: 1}, 10, 2) == {0: 0, 1: 1}
