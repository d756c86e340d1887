"""Near duplicates by MinHash, with an inverted join over signature coordinates.

A text's signature has 32 coordinates, each the least hash of its shingles under one permutation; two texts agree in a
coordinate with the probability of their Jaccard similarity. Texts are posted under (coordinate, value). Pairs that
agree in ``match_threshold`` coordinates or more are candidates, and such a pair has to meet in the lists of the first
33 - threshold of either's coordinates, counted from the rarest: only these are posted (prefix). Lists that one text
alone has are no lists, and a text with fewer shared lists than the threshold has no partner at all. Within a list
collisions are counted coordinate by coordinate, and a pair is skipped as soon as what is left cannot lift it to the
threshold.

Candidates only say which texts to hold against each other: those that hang together form a crowd, and within it every
link is settled by the whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import fresh, kept, ship, utf8
from marginalia.llm.components import components
from marginalia.llm.setlinks import linked_sets, similar

SEED = 42
COORDINATES = 32
#: Coordinates that candidates agree in: a pair at 0.85 misses it in one of 50,000 cases.
MATCHES = 18
#: A list or crowd with more members than this, or a crowd with more shingles, is dealt out as pairs of chunks.
CHUNK, CROWD_SHINGLES = 4096, 4_000_000
_SHINGLES_AT_ONCE = 1 << 15
_BROADCAST = 100_000
#: Cells of up to so many rows are worked on together.
_SMALL = 24


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, without words none."""
    words = utf8(text).lower().split()  # bytes: lower() touches A-Z only, split() cuts at \x20 and \x09-\x0D
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(x), SEED) for x in zip(*(words[k:] for k in range(width)))), np.uint64))  # noqa: B905


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240603)
    return rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


_FACTORS, _SUMMANDS = _permutations()


def signature(own: np.ndarray) -> np.ndarray:
    """The coordinates of a set that is not empty, as 32-bit numbers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), _SHINGLES_AT_ONCE):
        part = own[start : start + _SHINGLES_AT_ONCE]
        for k in range(COORDINATES):
            x = (part ^ _SUMMANDS[k]) * _FACTORS[k]
            least[k] = min(least[k], (x ^ (x >> np.uint64(32))).min())
    return (least >> np.uint64(32)).astype(np.uint32) ^ least.astype(np.uint32)


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of a stream that is sorted by cell, so that no cell is parted, and where their cells begin and end."""
    held: list[pd.DataFrame] = []

    def whole(frames: list[pd.DataFrame]):
        frame = pd.concat(frames, ignore_index=True)
        cell = frame["cell"].to_numpy()
        return frame, np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(frame)]

    for frame in batches:
        if not len(frame):
            continue
        cell = frame["cell"].to_numpy()
        if held and held[-1]["cell"].iloc[-1] == cell[-1]:
            held.append(frame)
            continue
        cut = int(np.argmax(cell == cell[-1]))
        if held or cut:
            yield whole([*held, frame.iloc[:cut]])
        held = [frame.iloc[cut:]]
    if held:
        yield whole(held)


def _agree(columns: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which pairs have ``least`` equal coordinates or more: four are counted at a time, and of a pair that cannot get
    there any more the rest is skipped."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int8)
    for k in range(0, len(columns), 4):
        if not len(alive):
            break
        equal += (columns[k : k + 4, a[alive]] == columns[k : k + 4, b[alive]]).sum(axis=0, dtype=np.int8)
        ok = equal + (len(columns) - k - 4) >= least
        alive, equal = alive[ok], equal[ok]
    return alive


def colliding(signatures: np.ndarray, least: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that keep together exactly the signatures which pairs with ``least`` equal coordinates or more
    connect; with ``own``, only pairs of different chunks count.

    A signature is held against all those that are not together with it.
    """
    n = len(signatures)
    root = np.arange(n)
    columns = np.ascontiguousarray(signatures.T)
    for i in range(n):
        js = np.flatnonzero(root != root[i])
        js = js[js > i] if own is None else js[(js > i) & (own[js] != own[i])]
        js = js[_agree(columns, np.full(len(js), i), js, least)]
        if len(js):
            both = np.unique(np.r_[root[i], root[js]])
            root[np.isin(root, both)] = both[0]
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]


def _collisions(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Links within the cells of a sorted stream (cell, own, cross, node, sig)."""
    for frame, bounds in _whole_cells(batches):
        node, own, cross = (frame[c].to_numpy() for c in ("node", "own", "cross"))
        signatures = np.stack(frame["sig"].to_list())
        sizes = np.diff(bounds)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        # small cells: all of them at once, a row against the one that stands so many places further
        columns, end = np.ascontiguousarray(signatures.T), np.repeat(bounds[1:], sizes)
        alive = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
        for shift in range(1, _SMALL):
            alive = alive[alive + shift < end[alive]]
            if not len(alive):
                break
            a, b = alive, alive + shift
            pairs = np.flatnonzero(~cross[a] | (own[a] != own[b]))
            pairs = pairs[_agree(columns, a[pairs], b[pairs], least)]
            found.append((a[pairs], b[pairs]))
        for lo, hi in zip(bounds[:-1][sizes > _SMALL], bounds[1:][sizes > _SMALL], strict=True):
            a, b = colliding(signatures[lo:hi], least, own[lo:hi] if cross[lo] else None)
            found.append((a + lo, b + lo))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pd.DataFrame({"a": node[a], "b": node[b]})


def _dealt(rows: DataFrame, group: str, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(cell, own, cross, columns): ``rows`` with a chunk ``own`` each, dealt out so that any two chunks of a group meet.

    ``chunks`` has (group, chunks, apart): the number of a group's chunks, of which only the first ``apart`` hold rows
    that still have to meet others; the rest need not meet among themselves.
    """
    dealt = rows.join(chunks, group, "left").select(
        group, *columns, F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("chunks", F.lit(1)).alias("chunks"), F.coalesce("apart", F.lit(1)).alias("apart")
    )
    meets = F.when(F.col("own") < F.col("apart"), F.col("chunks")).otherwise(F.col("apart"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.greatest(meets, F.lit(1)) - 1)))
    cell = F.xxhash64(group, F.least("own", "o"), F.greatest("own", "o"))
    return dealt.select(cell.alias("cell"), "own", (F.col("own") != F.col("o")).alias("cross"), *columns)


def candidate_links(sets: DataFrame, least: int = MATCHES, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the nodes of ``sets`` (node, sig) that keep together all pairs that agree in ``least``
    coordinates or more.

    A list with more than ``chunk`` texts has a leader, its least node: texts that agree with it are together and need
    not meet; the others meet them and each other, chunk by chunk.
    """
    ship(sets.sparkSession)
    posted = sets.select("node", F.posexplode("sig").alias("k", "v")).select("node", F.struct("k", "v").alias("post"))
    often = posted.groupBy("post").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    shared = kept(posted.join(often, "post").select("node", "post", "n", "lead"))
    # the lists of a text from the rarest on; those without a partner are the first of all
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "post", "lead"))).alias("lists"))
    prefix = F.slice("lists", F.lit(1), F.size("lists") - F.lit(least - 1))
    lists = lists.where(F.size("lists") >= least).select("node", F.inline(prefix))
    posts = kept(lists.join(sets, "node").select("node", "sig", "n", "lead", F.xxhash64("post.k", "post.v").alias("list")))
    hot = posts.where(F.col("n") > chunk)
    leaders = hot.select("lead").distinct().join(sets.select(F.col("node").alias("lead"), F.col("sig").alias("lead_sig")), "lead")
    leaders = F.broadcast(kept(leaders)) if leaders.count() <= _BROADCAST else leaders
    equal = F.aggregate(F.zip_with("sig", "lead_sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda done, x: done + x)
    with_leader = hot.join(leaders, "lead").withColumn("core", equal >= least)
    core = with_leader.where("core and node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    sizes = kept(with_leader.groupBy("list").agg(F.count_if(~F.col("core")).alias("rest"), F.count_if("core").alias("cores")))
    of = lambda n: F.ceil(F.col(n) / F.lit(chunk)).cast("int")
    chunks = sizes.select("list", (of("rest") + of("cores")).alias("chunks"), of("rest").alias("apart"), of("cores").alias("core_chunks"))
    chunks = F.broadcast(chunks) if sizes.count() <= _BROADCAST else chunks
    deal = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    large = with_leader.join(chunks, "list").where("apart > 0").withColumn(
        "own", F.when(F.col("core"), F.col("apart") + deal("core_chunks")).otherwise(deal("apart"))
    )
    small = posts.where(F.col("n") <= chunk).select("list", "node", "sig", F.lit(0).alias("own"))
    rows = small.unionByName(large.select("list", "node", "sig", "own"))
    cells = _dealt(rows, "list", chunks.select("list", "chunks", "apart"), ["node", "sig"])

    found = cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(lambda it: _collisions(it, least), "a long, b long")
    return found.unionAll(core).distinct()


def verified_links(members: DataFrame, share: tuple[int, int], chunk: int = CHUNK, crowd_shingles: int = CROWD_SHINGLES) -> DataFrame:
    """Links (a, b) between the nodes of ``members`` (crowd, node, size, shingles) that keep together exactly what pairs of
    one crowd with a Jaccard similarity of ``share`` or more connect.

    A crowd beyond ``chunk`` members or ``crowd_shingles`` has a leader, its largest set: members that are similar to it
    are together and need not meet; the others meet them and each other, chunk by chunk.
    """
    totals = members.groupBy("crowd").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.max(F.struct("size", "node")).alias("lead"))
    parts = F.greatest(F.ceil(F.col("total") / F.lit(crowd_shingles)), F.ceil(F.col("n") / F.lit(chunk)))
    hot = kept(totals.withColumn("parts", parts.cast("int")).where("parts > 1").select("crowd", "parts", F.col("lead.node").alias("lead")))
    few = hot.count() <= _BROADCAST
    hot = F.broadcast(hot) if few else hot
    small = members.join(hot, "crowd", "left_anti").select("crowd", "node", "shingles", F.lit(0).alias("own"))
    large = members.join(hot, "crowd")
    leaders = large.where("node = lead").select("lead", F.col("shingles").alias("lead_shingles"))
    dealt = large.join(leaders, "lead")  # Spark may split a crowd that has most of the rows

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            core = []
            for x, y in zip(b["shingles"], b["lead_shingles"], strict=True):
                one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                core.append(bool(similar(np.int64(common), np.int64(len(one)), len(other), share)))
            yield b.drop(columns="lead_shingles").assign(core=core)

    told = kept(dealt.select("crowd", "node", "lead", "parts", "size", "shingles", "lead_shingles").mapInPandas(near, "crowd long, node long, lead long, parts int, size long, shingles binary, core boolean"))
    core = told.where("core and node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    sizes = told.groupBy("crowd").agg(*[F.greatest(F.ceil(F.sum(F.when(c, F.col("size")).otherwise(0)) / F.lit(crowd_shingles)), F.ceil(F.count_if(c) / F.lit(chunk))).cast("int").alias(n) for c, n in ((~F.col("core"), "apart"), (F.col("core"), "core_chunks"))])
    chunks = kept(sizes.select("crowd", "apart", "core_chunks", (F.col("apart") + F.col("core_chunks")).alias("chunks")))
    chunks = F.broadcast(chunks) if few else chunks
    deal = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    large = told.join(chunks, "crowd").where("apart > 0").withColumn("own", F.when(F.col("core"), F.col("apart") + deal("core_chunks")).otherwise(deal("apart")))
    rows = small.unionByName(large.select("crowd", "node", "shingles", "own"))
    cells = _dealt(rows, "crowd", chunks.select("crowd", "chunks", "apart"), ["node", "shingles"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in _whole_cells(batches):
            node, own, cross, raw = (frame[c].to_numpy() for c in ("node", "own", "cross", "shingles"))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    a, b = linked_sets([np.frombuffer(x, np.uint64) for x in raw[lo:hi]], share, own[lo:hi] if cross[lo] else None)
                    yield pd.DataFrame({"a": node[a + lo], "b": node[b + lo]})

    found = cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long")
    return found.unionAll(core).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: tuple[int, int] = (17, 20), width: int = 3, least: int = MATCHES,
    chunk: int = CHUNK, crowd_shingles: int = CROWD_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts link whose sets of ``width``-word shingles have a Jaccard similarity of ``share`` or more; a text of fewer
    words is one shingle. component_id is the smallest id that links reach, itself included; kept is whether that is the
    row's own. Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an id keep a row
    each; null ids count for no minimum, and a component of nulls alone has a null id and is kept. Other columns play no
    part. An empty table gives no rows.

    Texts of equal sets are put together first (with partial sums, so any number of copies is cheap). No pair below
    ``share`` links; of pairs at 0.85 one in 50,000 agrees in fewer than ``least`` coordinates and is missed.
    """
    ship(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long = T.LongType()
    schema = T.StructType([ids.schema["doc_id"], *[T.StructField(c, long) for c in ("t1", "t2", "n")], T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def digests(own: np.ndarray) -> tuple[int, int]:
        raw = xxhash.xxh128_digest(own.tobytes())
        return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)

    def prints(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                own = shingles(x, width)
                rows.append((*digests(own), len(own), signature(own).view(np.int32) if len(own) else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "t1", "t2", "n", "sig"])

    printed = kept(ids.mapInArrow(prints, schema))
    texts = printed.where("n > 0").groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    texts = kept(texts.withColumn("node", F.monotonically_increasing_id()))
    crowds = kept(components(candidate_links(texts.select("node", "sig"), least, chunk)))
    members = kept(texts.join(crowds, "node").select("node", F.col("root").alias("crowd"), "t1", "t2", "least"))
    # the text of one row of each member is read again; a text that only rows without an id have is looked for among these
    spelled = ids.join(members.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if members.where("least is null").count():
        spelled = spelled.unionAll(ids.where("doc_id is null"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [shingles(x, width) for x in b["text"]]
            keys = [digests(x) for x in own]
            yield pd.DataFrame({"t1": [k[0] for k in keys], "t2": [k[1] for k in keys], "size": [len(x) for x in own], "shingles": [x.tobytes() for x in own]})

    found = spelled.select("text").mapInPandas(sets, "t1 long, t2 long, size long, shingles binary")
    found = found.join(members.select("t1", "t2", "node", "crowd"), ["t1", "t2"]).select("crowd", "node", "size", "shingles").dropDuplicates(["node"])
    roots = components(verified_links(kept(found), share, chunk, crowd_shingles))
    grouped = texts.select("t1", "t2", "node", "least").join(roots, "node", "left").select("t1", "t2", F.coalesce("root", "node").alias("root"), "least")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_text = grouped.join(smallest, "root").select("t1", "t2", "component_id", F.lit(True).alias("there"))
    joined = printed.drop("sig").join(by_text, ["t1", "t2"], "left")
    component = F.when(F.col("there"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: tuple[int, int] = (17, 20), width: int = 3) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat that id one stays. Rows without an id stay as they are. All columns stay.
    """
    row = fresh(docs, "row")
    first = near_duplicates(docs, text, doc_id, share, width).where("kept and doc_id is not null").select(F.col("doc_id").alias(row)).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(first, F.col(doc_id) == F.col(row), "left_semi")
    return named.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
