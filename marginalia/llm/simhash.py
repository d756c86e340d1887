"""Near duplicates by SimHash, with pivot distance tables.

A pair of fingerprints can only differ in 4 bits if its distances to every reference fingerprint ("pivot") differ
by 4 at most. Distances to 16 pivots are computed once for each distinct fingerprint. Pairs are looked for among
fingerprints that agree in 2 of 6 bit blocks (4 differing bits leave at least 2 blocks whole), in the order of the
first pivot distance, so that a window of 4 is looked at; the other coordinates then discard most of what is left
and the true distance settles the survivors.

With a ``similarity``, texts link by the Jaccard similarity of their sets of shingles instead. Fingerprints of 128
bits are compared where they agree in one of many samples of bits, in the same way: in the order of the first pivot
distance, the other 15 discard pairs, the true distance settles the survivors. What links at a wide radius is only a
crowd of candidates, and within it every link is verified by exact Jaccard.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import PORTION, fresh, kept, portions, ship, utf8
from marginalia.llm.components import components
from marginalia.llm.setlinks import linked_sets

SEED = 42
PIVOTS = 16
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: A key with more distinct fingerprints than this is dealt out as pairs of chunks of about this size.
CHUNK = 4096
_SHINGLES_AT_ONCE = 1 << 16
#: Bits of the wide fingerprints, and the standard deviations that a pair at the wanted similarity may lie beyond the
#: number of differing bits to be expected of it.
WIDE = 128
DEVIATIONS = 3.0
#: Share of the pairs at the wanted similarity that all samples of bits may miss, by expectation.
MISSED = 0.005
#: Distinct fingerprints that a sample of bits leaves together by chance, about.
BESIDE = 64
#: A crowd with more shingles than this is dealt out as pairs of chunks.
CROWD_SHINGLES = 4_000_000


@lru_cache
def pivots() -> np.ndarray:
    """The reference fingerprints: fixed by a seed, half of the bits set in each."""
    rng = np.random.default_rng(20240601)
    out = []
    for _ in range(PIVOTS):
        bits = rng.permutation(np.repeat([0, 1], 32))
        out.append(int("".join(map(str, bits)), 2))
    return np.array(out, dtype=np.uint64)


@lru_cache
def wide_pivots() -> np.ndarray:
    """The reference fingerprints of 128 bits, as rows of two halves."""
    rng = np.random.default_rng(20240603)
    bits = np.stack([rng.permutation(np.repeat([0, 1], WIDE // 2)) for _ in range(PIVOTS)])
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of a whole text; shingles are hashed in portions, so that long texts need little memory."""
    words = utf8(text).lower().split()  # bytes: lower() touches A-Z only, split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for start in range(0, total, _SHINGLES_AT_ONCE):
        part = words[start : min(start + _SHINGLES_AT_ONCE, total) + width - 1]
        raw = b"".join([digest(join(s), SEED) for s in zip(*(part[k:] for k in range(width)))])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = 4) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; one pass, no shuffle. Null and empty texts get zero."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in portions(batches):
            prints = np.array([fingerprint(t, width) for t in b.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints)], schema=b.schema.append(pa.field(name, pa.int64())))

    return docs.mapInArrow(run, schema)


def _key_columns(fp: str) -> list:
    """One key for each choice of 2 blocks: the choice's number above the bits of both blocks."""
    part = lambda lo, n: F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << n) - 1))
    keys = []
    for k, ((a, na), (b, nb)) in enumerate(combinations(BLOCKS, 2)):
        keys.append(F.lit(k << 24).cast("long") + F.shiftleft(part(a, na), nb) + part(b, nb))
    return keys


def _near_pairs(frame: pd.DataFrame, coords: list[np.ndarray], distance: Callable, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at ``radius`` or fewer differing bits within the cells of a frame that is sorted by cell, then by the first
    pivot distance. ``coords``: the distances to all pivots; ``distance`` gives that of pairs."""
    n = len(frame)
    cell, own, cross = (frame[c].to_numpy() for c in ("cell", "own", "cross"))
    first = coords[0].astype(np.int16)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    alive, shift = np.arange(n), 0
    while True:
        shift += 1
        alive = alive[alive + shift < n]
        if not len(alive):
            break
        other = alive + shift
        # sorted by cell, then by the first coordinate: once a partner is too far, all later ones are
        near = (cell[alive] == cell[other]) & (first[other] - first[alive] <= radius)
        alive = alive[near]
        a, b = alive, alive + shift
        both = ~cross[a] | (own[a] != own[b])  # cells of two chunks leave pairs within a chunk to the chunk's own cell
        a, b = a[both], b[both]
        for c in coords[1:]:
            if not len(a):
                break
            ok = np.abs(c[a] - c[b]) <= radius
            a, b = a[ok], b[ok]
        if len(a):
            ok = distance(a, b) <= radius
            found_a.append(a[ok])
            found_b.append(b[ok])
    return np.concatenate(found_a), np.concatenate(found_b)


def _links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links within cells of a sorted stream (cell, own, cross, d0, fp)."""
    for frame in _whole_cells(batches):
        prints = frame["fp"].to_numpy(np.int64).view(np.uint64)
        coords = [np.bitwise_count(prints ^ p).astype(np.int8) for p in pivots()]
        a, b = _near_pairs(frame, coords, lambda a, b, x=prints: np.bitwise_count(x[a] ^ x[b]), radius)
        a, b = _forest(len(frame), a, b)
        signed = prints.view(np.int64)
        yield pd.DataFrame({"a": signed[a], "b": signed[b]})


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the links as keep the same nodes together: one from each node to the least node that it reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]


def fingerprint_links(prints: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that keep together exactly those which pairs at
    ``radius`` or fewer differing bits connect. Only a spanning set of links leaves a task."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("6 blocks leave two whole for at most 4 differing bits")
    ship(prints.sparkSession)
    rows = prints.select("fp", F.explode(F.array(*_key_columns("fp"))).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, "k")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    rows = rows.select("k", "fp", parts.alias("c"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    rows = rows.select("k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivots().view(np.int64)[0]))))
    rows = rows.select(
        F.xxhash64("k", F.least("own", "o"), F.greatest("own", "o")).alias("cell"),
        "own",
        (F.col("own") != F.col("o")).alias("cross"),
        first.alias("d0"),
        "fp",
    )
    # A cell is (key, chunk, chunk); the chunk's own cell has own = o. Cells of two chunks hold both, told by "own".
    parted = rows.repartition("cell").sortWithinPartitions("cell", "d0")
    return parted.mapInPandas(lambda it: _links(it, radius), "a long, b long").distinct()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, as of ``fingerprint``; a text of fewer words is one shingle."""
    words = utf8(text).lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(x), SEED) for x in zip(*(words[k:] for k in range(width)))), np.uint64))


def wide_fingerprint(text: str | None, width: int) -> tuple[int, int]:
    """A fingerprint of 128 bits over the distinct shingles, as two signed longs."""
    own = shingles(text, width)
    ones = np.zeros(WIDE, dtype=np.int64)
    for start in range(0, len(own), _SHINGLES_AT_ONCE):
        part = own[start : start + _SHINGLES_AT_ONCE]
        both = np.stack([part, _mixed(part)], axis=1)
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    high, low = np.packbits(ones * 2 > len(own)).view(np.int64).tolist()
    return high, low


def _mixed(x: np.ndarray) -> np.ndarray:
    """Other 64 bits for each hash (the finalizer of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _share(similarity: float) -> float:
    """The share of bits that sets of the same size and this Jaccard similarity are expected to differ in."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float) -> int:
    p = _share(similarity)
    return math.ceil(WIDE * p + DEVIATIONS * math.sqrt(WIDE * p * (1 - p)))


def samples(n: int, similarity: float) -> list[tuple[int, ...]]:
    """The bits of each key for ``n`` fingerprints: so many a key that about ``BESIDE`` meet by chance, and so many
    keys that pairs at ``similarity`` agree in one but for ``MISSED`` of them."""
    bits = min(48, max(10, math.ceil(math.log2(max(n, 1) / BESIDE))))
    agree = (1 - _share(similarity)) ** bits
    rng = np.random.default_rng(20240602)
    return [tuple(int(b) for b in rng.choice(WIDE, bits, replace=False)) for _ in range(math.ceil(math.log(MISSED) / math.log(1 - agree)))]


def _wide_cells(prints: DataFrame, keys: list[tuple[int, ...]], chunk: int) -> DataFrame:
    """(cell, own, cross, d0, f1, f2): a row for every fingerprint and key, dealt out like those of ``fingerprint_links``."""
    choices = np.array(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = np.ascontiguousarray(b[["f1", "f2"]].to_numpy(np.int64))
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 16), axis=1)
            weights = np.int64(1) << np.arange(choices.shape[1], dtype=np.int64)
            for k, own in enumerate(choices):
                yield pd.DataFrame({"k": (bits[:, own] @ weights) * 4096 + k, "f1": raw[:, 0], "f2": raw[:, 1]})

    rows = prints.select("f1", "f2").mapInPandas(run, "k long, f1 long, f2 long")
    counts = kept(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > chunk))
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(chunk)), F.lit(1)).cast("int")
    crowded = F.broadcast(counts) if counts.count() <= 100_000 else counts
    rows = rows.join(crowded, "k", "left").select("k", "f1", "f2", parts.alias("c"), F.pmod(F.xxhash64("f1"), parts).cast("int").alias("own"))
    rows = rows.select("k", "f1", "f2", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    first = sum(F.bit_count(F.col(f).bitwiseXOR(F.lit(int(p)))) for f, p in zip(("f1", "f2"), wide_pivots()[0].view(np.int64), strict=True))
    cell = F.xxhash64("k", F.least("own", "o"), F.greatest("own", "o"))
    return rows.select(cell.alias("cell"), "own", (F.col("own") != F.col("o")).alias("cross"), first.alias("d0"), "f1", "f2")


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a sorted stream, so that no cell is parted."""
    rest: list[pd.DataFrame] = []
    for frame in batches:
        if not len(frame):
            continue
        cell = frame["cell"].to_numpy()
        if rest and rest[-1]["cell"].iloc[-1] == cell[-1]:
            rest.append(frame)
            continue
        cut = int(np.argmax(cell == cell[-1]))
        whole = [*rest, frame.iloc[:cut]]
        rest = [frame.iloc[cut:]]
        whole = pd.concat(whole, ignore_index=True)
        if len(whole):
            yield whole
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _apart(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """In how many of 128 bits fingerprints differ."""
    return np.bitwise_count(a1 ^ b1).astype(np.int16) + np.bitwise_count(a2 ^ b2)


def _wide_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links within cells of a sorted stream (cell, own, cross, d0, f1, f2)."""
    for frame in _whole_cells(batches):
        f1, f2 = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("f1", "f2"))
        coords = [_apart(f1, f2, *p) for p in wide_pivots()]
        a, b = _near_pairs(frame, coords, lambda a, b, x=f1, y=f2: _apart(x[a], y[a], x[b], y[b]), radius)
        a, b = _forest(len(frame), a, b)
        signed = f1.view(np.int64)
        yield pd.DataFrame({"a": signed[a], "b": signed[b]})


def jaccard_forest(sets: list[np.ndarray], similarity: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that keep together exactly the sets which pairs at ``similarity`` or more connect; with ``own``,
    only pairs of different chunks count.

    The work is that of ``linked_sets``, which bounds pairs by bitmaps and compares what is left.
    """
    exact = Fraction(similarity).limit_denominator(1000)
    a, b = linked_sets(sets, (exact.numerator, exact.denominator), own)
    empty = np.flatnonzero([not len(x) for x in sets])
    if len(empty) > 1 and (own is None or len(np.unique(own[empty])) > 1):  # sets without shingles are alike
        a, b = np.r_[a, empty[1:]], np.r_[b, np.full(len(empty) - 1, empty[0])]
    return a, b


def _verified(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Links between texts ``t`` of a cell, of sorted rows (cell, own, cross, t, shingles)."""
    for frame in _whole_cells(batches):
        for _, rows in frame.groupby("cell", sort=False):
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
            a, b = jaccard_forest(sets, similarity, rows["own"].to_numpy() if rows["cross"].iloc[0] else None)
            t = rows["t"].to_numpy(np.int64)
            yield pd.DataFrame({"a": t[a], "b": t[b]})


def similar_texts(docs: DataFrame, text: str, doc_id: str, similarity: float, width: int, chunk: int = CHUNK, crowd: int = CROWD_SHINGLES) -> DataFrame:
    """(doc_id, fingerprint, component_id) as ``near_duplicates`` has them, for links by Jaccard similarity."""
    ship(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # t: the same words, so the same shingles
    schema = T.StructType([ids.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("t", "f1", "f2")]])

    def prints(batches):
        import pyarrow as pa

        for b in portions(batches):
            out = [(xxhash.xxh64_intdigest(b" ".join(utf8(x).lower().split()), SEED), *wide_fingerprint(x, width)) for x in b.column(1).to_pylist()]
            t = np.array([x[0] for x in out], dtype=np.uint64).view(np.int64)
            f1, f2 = (pa.array([x[k] for x in out], pa.int64()) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t), f1, f2], names=["doc_id", "t", "f1", "f2"])

    printed = kept(ids.mapInArrow(prints, schema))
    texts = kept(printed.groupBy("t").agg(F.min("doc_id").alias("least"), F.min("f1").alias("f1"), F.min("f2").alias("f2")))
    distinct = kept(texts.groupBy("f1").agg(F.min("f2").alias("f2"), F.count("*").alias("n")))
    cells = _wide_cells(distinct, samples(distinct.count(), similarity), chunk)
    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell", "d0")
    near = wide_radius(similarity)
    links = sorted_cells.mapInPandas(lambda it: _wide_links(it, near), "a long, b long").distinct()
    # texts of equal fingerprints are a crowd without any link
    lone = distinct.where("n > 1").select(F.col("f1").alias("node"), F.col("f1").alias("root"))
    crowds = kept(components(links).unionAll(lone).groupBy("node").agg(F.min("root").alias("root")))
    members = texts.select("t", "f1").join(crowds, F.col("f1") == F.col("node")).select("t", F.col("root").alias("crowd"))
    one = kept(printed.select("t", "doc_id").join(members, "t").groupBy("t", "crowd").agg(F.min("doc_id").alias("id")))
    spelled = ids.join(one.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    # a text that only rows without an id have is looked for among these
    orphans = ids.where(F.col("doc_id").isNull()) if one.where("id is null").count() else None
    spelled = spelled if orphans is None else spelled.unionAll(orphans)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in (b["text"].iloc[at : at + PORTION] for b in batches for at in range(0, len(b), PORTION)):
            t = np.array([xxhash.xxh64_intdigest(b" ".join(utf8(x).lower().split()), SEED) for x in texts], dtype=np.uint64).view(np.int64)
            own = [shingles(x, width) for x in texts]
            yield pd.DataFrame({"t": t, "size": [len(x) for x in own], "shingles": [x.tobytes() for x in own]})

    found = spelled.select("text").mapInPandas(sets, "t long, size long, shingles binary").dropDuplicates(["t"])
    found = kept(found.join(one.select("t", "crowd"), "t"))
    parts = F.ceil(F.col("total") / F.lit(crowd)).cast("int")
    totals = found.groupBy("crowd").agg(F.greatest(F.sum("size"), F.lit(1)).alias("total"))
    dealt = found.join(totals, "crowd").withColumn("c", parts).withColumn("own", F.pmod(F.xxhash64("t"), F.col("c")).cast("int"))
    dealt = dealt.select("crowd", "t", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o")).select(
        F.xxhash64("crowd", F.least("own", "o"), F.greatest("own", "o")).alias("cell"), "own", (F.col("own") != F.col("o")).alias("cross"), "t", "shingles"
    )
    verified = dealt.repartition("cell").sortWithinPartitions("cell").mapInPandas(lambda it: _verified(it, similarity), "a long, b long").distinct()
    roots = components(verified)
    grouped = texts.join(roots.withColumnRenamed("node", "t"), "t", "left").select("t", F.coalesce("root", "t").alias("root"), "least")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_text = grouped.join(least, "root").select("t", "component_id")
    return printed.join(by_text, "t").select(
        "doc_id", F.lower(F.concat(F.lpad(F.hex("f1"), 16, "0"), F.lpad(F.hex("f2"), 16, "0"))).alias("fingerprint"), "component_id"
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 4, width: int = 4, similarity: float | None = None
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id that links reach, itself
    included. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat an
    id keep a row each; null ids count for no minimum (a component of nulls alone has a null id). Other columns of
    ``docs`` play no part. An empty table gives no rows.

    Equal fingerprints are put together first (with partial sums, so any number of copies is cheap); only distinct
    ones are compared, and only a spanning set of links is shuffled. The join back to the documents is a plain
    equality join that Spark may split where one fingerprint has most rows.

    With a ``similarity``, texts link whose sets of ``width``-word shingles have that Jaccard similarity or more
    (texts of fewer words are one shingle; blank texts are alike); ``radius`` plays no part, and the fingerprint has
    32 digits. No pair below it links. Pairs are found by samples of bits, which miss some: the README has the share.
    """
    if similarity is not None:
        return similar_texts(docs, text, doc_id, similarity, width)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    printed = fingerprints(ids, "text", "fp", width).select("doc_id", "fp")
    printed = kept(printed)
    distinct = kept(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = grouped.join(least, "root").select("fp", "component_id")
    return printed.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 4, width: int = 4, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat that id one stays. Documents of a component without any id stay as they are, for want of a
    smallest one. All columns stay.
    """
    row = fresh(docs, "row")
    groups = near_duplicates(docs, text, doc_id, radius, width, similarity).where("doc_id = component_id").select(
        F.col("doc_id").alias(row)
    ).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(groups, F.col(doc_id) == F.col(row), "left_semi")
    return named.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
