"""Shards of near-equal size by best-fit-decreasing bin packing.

Groups of equal texts do not part. Groups that are large against a shard are packed one by one; the many small
ones are first bundled by their hash, so the number of things to pack has a bound whatever the number of documents.
Things go by falling size to the shard with the tightest room that takes them, found in a balanced tree.
"""

from __future__ import annotations

import random
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import hash_pair, kept

SHARDS = 8
BUNDLES = 4096


class RoomTree:
    """The shards by (room, number) in a treap: random heap priorities keep it balanced."""

    def __init__(self) -> None:
        self._root = None
        self._random = random.Random(3)

    @classmethod
    def _split(cls, node, key):
        """Nodes below the key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = cls._split(node[3], key)
            return (node[0], node[1], node[2], a), b
        a, b = cls._split(node[2], key)
        return a, (node[0], node[1], b, node[3])

    @classmethod
    def _join(cls, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return (a[0], a[1], a[2], cls._join(a[3], b))
        return (b[0], b[1], cls._join(a, b[2]), b[3])

    def add(self, room: int, shard: int) -> None:
        a, b = self._split(self._root, (room, shard))
        self._root = self._join(self._join(a, ((room, shard), self._random.random(), None, None)), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the shard with the least room of ``size`` or more."""
        a, b = self._split(self._root, (size, -1))
        if b is None:
            return None
        node = b
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(b, (node[0][0], node[0][1] + 1))
        self._root = self._join(a, rest)
        return node[0]

    def take_widest(self) -> tuple[int, int]:
        """Remove and return the shard with the most room, of equals the first."""
        node = self._root
        while node[3] is not None:
            node = node[3]
        return self.take_tightest(node[0][0])


def best_fit_decreasing(sizes: dict[int, int], capacity: int, shards: int | None = None) -> dict[int, int]:
    """The shard of each thing. Without ``shards``, a new one opens whenever none has room (a thing larger than the
    capacity has one to itself). With ``shards``, a thing that fits nowhere goes where most room is left."""
    tree = RoomTree()
    opened = shards or 0
    for k in range(opened):
        tree.add(capacity, k)
    out = {}
    for thing in sorted(sizes, key=lambda t: (-sizes[t], t)):
        found = tree.take_tightest(sizes[thing])
        if found is None:
            if shards is None:
                found, opened = (capacity, opened), opened + 1
            else:
                found = tree.take_widest()
        room, shard = found
        out[thing] = shard
        tree.add(room - sizes[thing], shard)
    return out


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id", bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. Give the number of ``shards`` (sizes come out near
    equal: law ``bytes``), or ``shards=None`` and a ``capacity`` in bytes (as few shards as best fit needs). Equal
    texts share a shard, but for a text whose copies hold more than a shard's capacity: its rows are dealt out by
    the hash of their ids. Null and empty texts are equal. ``slot`` numbers a shard's rows from 0 without gaps;
    ``grown_shard`` is null, as one more shard would move rows between all. Rows that repeat an id have a row each.
    An empty table gives no rows.

    The driver sees at most some ``bundles`` numbers for groups, bundles and numbered cells each, never a document.
    Slots are numbered in cells of about rows / ``bundles`` rows and moved up by the counts of the cells before.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = kept(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"), *hash_pair(body), F.xxhash64(F.lit(7), F.col(doc_id)).alias("salt"),
        )
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total, n = total or 0, n or 0
    room = capacity if shards is None else max(1, ceil(total / shards))
    if room is None:
        raise ValueError("give the number of shards or a capacity")
    least = max(1, min(total // bundles, room // 16))  # bytes from which a group is a thing of its own
    bundles = max(bundles, ceil(total / max(1, room // 16)))
    big = (
        rows.groupBy("h1", "h2")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > least)
        .orderBy("h1", "h2")
        .collect()  # total / least groups at most
    )
    first, own = bundles, []
    for g in big:
        parts = 1 if g["bytes"] <= room else ceil(g["bytes"] / least)
        own.append((g["h1"], g["h2"], first, parts))
        first += parts
    groups = spark.createDataFrame(own, "h1 long, h2 long, base int, parts int")
    things = rows.join(F.broadcast(groups), ["h1", "h2"], "left").withColumn(
        "thing", F.coalesce(F.col("base") + F.pmod("salt", F.col("parts")), F.pmod("h1", F.lit(bundles))).cast("int")
    )
    sums = {r["thing"]: (r["bytes"], r["n"]) for r in things.groupBy("thing").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    home = best_fit_decreasing({t: b for t, (b, _) in sums.items()}, room, shards)
    cell_rows = max(1, ceil(n / bundles) * 2)
    placed = spark.createDataFrame([(t, home[t], max(1, ceil(k / cell_rows))) for t, (_, k) in sums.items()], "thing int, shard int, cells int")
    celled = things.join(F.broadcast(placed), "thing").withColumn("cell", F.pmod(F.xxhash64("salt", "h2"), F.col("cells")).cast("int"))
    counts = celled.groupBy("shard", "thing", "cell").agg(F.count("*").alias("n")).collect()
    offsets, at = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["thing"], r["cell"])):
        offsets.append((r["thing"], r["cell"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    before = spark.createDataFrame(offsets, "thing int, cell int, before long")
    place = F.row_number().over(Window.partitionBy("thing", "cell").orderBy("text_crc32", "h2", "doc_id"))
    return celled.join(F.broadcast(before), ["thing", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + place - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
