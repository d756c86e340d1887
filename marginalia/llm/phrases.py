"""Phrase collocations from count streams in prefix and suffix order.

Words stand in pieces of text; a gram is one to three words in a row. Grams are counted by external sorting: a task
sorts the windows of some texts and writes them as runs, one for each bucket that holds some of its words' pairs;
a bucket's runs are then merged and their counts added. What is frequent forms one stream of rows (lang, w1, w2, w3, f)
with nulls behind the words of a shorter gram, and the empty gram with the number of words in front.

The stream is laid out twice. In prefix order a gram follows directly on its own beginnings, in suffix order on its
own endings, so one pass through each layout reads off the counts of all left parts and of all right parts: the streams
of one-, two- and three-word grams go forward in lockstep, and nothing is looked up. A layout is cut into ranges
anywhere, even between the grams of one word; the last gram of each length that the ranges before a range hold is
handed on to it, three numbers a range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import kept, ship, utf8

#: Where texts are cut into pieces, and the blanks between words.
_CUTS = re.compile(rb"[.,;:!?\x0a-\x0d]+")
#: Bytes of text whose windows a task sorts at a time, and bytes of text whose windows a bucket gets, about.
RUN_BYTES, BUCKET_BYTES = 16 << 20, 12 << 20
_RUN = "bucket int, lang string, n int, words binary, grams binary, counts binary"
_GRAM = "lang string, w1 string, w2 string, w3 string, f long"
#: Parts of a language that are ranked by themselves before the last ranking.
_PARTS = 32


def pieces_of(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text, A-Z in lower case; null counts as empty."""
    parts = _CUTS.split(utf8(text).lower())  # bytes: lower() touches A-Z only
    return [words for p in parts if (words := [w for w in p.replace(b"\t", b" ").split(b" ") if w])]


def _tally(columns: list[np.ndarray], counts: np.ndarray | None, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of some columns of numbers below ``base``, sorted, and how often each occurs."""
    if not len(columns[0]):
        return np.zeros((len(columns), 0), np.int64), np.zeros(0, np.int64)
    if base ** len(columns) < 1 << 63:  # a row is one number
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * base + c
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total, key, rows = len(key), key[starts], []
        for _ in columns:
            key, low = np.divmod(key, base)
            rows.append(low)
        rows = np.stack(rows[::-1])
    else:
        order = np.lexsort(columns[::-1])
        rows = np.stack([c[order] for c in columns]).astype(np.int64)
        counts = None if counts is None else counts[order]
        starts = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)])
        total, rows = rows.shape[1], rows[:, starts]
    often = np.diff(np.r_[starts, total]) if counts is None else np.add.reduceat(counts, starts)
    return rows, often


class _Windows:
    """Windows of the texts of one language, until they are written as runs."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        number, codes = self.number, []
        for words in pieces_of(text):
            codes += [number.setdefault(w, len(number) + 1) for w in words]
            codes.append(0)
        self.codes.append(np.array(codes, np.int32))

    def runs(self, lang: str, buckets: int) -> Iterator[tuple]:
        """(bucket, lang, n, words, grams, counts): sorted windows of 1 and of 3 words (the third may be missing)."""
        words = sorted(self.number)
        if not words:
            return
        rank = np.zeros(len(words) + 1, np.int64)
        rank[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        codes = rank[np.concatenate([*self.codes, np.zeros(2, np.int32)])]
        dealt = np.array([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64)
        salt = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7))
        grams, often = _tally([codes[codes > 0]], None, len(words) + 1)
        yield from self._dealt(lang, 1, words, grams.T, often, _mixed(dealt[grams[0] - 1] ^ salt) % np.uint64(buckets))
        at = (codes[:-2] > 0) & (codes[1:-1] > 0)
        grams, often = _tally([codes[:-2][at], codes[1:-1][at], codes[2:][at]], None, len(words) + 1)
        to = _mixed(_mixed(dealt[grams[0] - 1] ^ salt) + dealt[grams[1] - 1]) % np.uint64(buckets)
        yield from self._dealt(lang, 3, words, grams.T, often, to)

    @staticmethod
    def _dealt(lang: str, n: int, words: list[bytes], grams: np.ndarray, counts: np.ndarray, to: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(to, kind="stable")
        grams, counts, to = grams[order], counts[order], to[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
        for lo, hi in zip(starts, np.r_[starts[1:], len(to)], strict=True):
            used, own = np.unique(grams[lo:hi], return_inverse=True)  # 0, a missing word, stays 0 or is not there
            table = b" ".join([words[k - 1] for k in used.tolist() if k])
            own = (own.reshape(-1, n) + (used[0] > 0)).astype(np.uint32)
            # columns one after the other: sorted ones compress well
            yield int(to[lo]), lang, n, table, own.T.tobytes(), counts[lo:hi].astype(np.uint32).tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _packed(rows: list[tuple]):
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    values = [*cols[:3], *[[squeeze(x) for x in c] for c in cols[3:]]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(values, kinds, strict=True)], names=["bucket", "lang", "n", "words", "grams", "counts"])


def _runs(batches: Iterator, buckets: int, run_bytes: int) -> Iterator:
    """Runs of the windows of all texts (lang, text)."""
    held: dict[str, _Windows] = {}
    size = 0

    def flush() -> Iterator:
        rows, waiting = [], 0
        for lang in sorted(held):
            for run in held[lang].runs(lang, buckets):
                rows.append(run)
                waiting += len(run[3]) + len(run[4])
                if waiting > 8 << 20:
                    yield _packed(rows)
                    rows, waiting = [], 0
        if rows:
            yield _packed(rows)
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            held.setdefault(lang, _Windows()).add(text)
            size += len(text or "")
            if size >= run_bytes:
                yield from flush()
                size = 0
    yield from flush()


def _merge(rows: list[tuple], n: int, least: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Words, grams (a word's place in them, from 1) and counts of merged runs, and the sum of all their counts; grams
    below ``least`` go. Of windows of three words their first two count as well."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    tables = [t.split(b" ") if (t := open_(r[0])) else [] for r in rows]
    words = sorted(set().union(*tables))
    number = {w: k for k, w in enumerate(words, 1)}
    grams, counts = [], []
    for (_, g, c), table in zip(rows, tables, strict=True):
        own = np.array([0, *[number[w] for w in table]], np.int64)
        grams.append(own[np.frombuffer(open_(g), np.uint32).reshape(n, -1)])
        counts.append(np.frombuffer(open_(c), np.uint32).astype(np.int64))
    gram, count = _tally(list(np.concatenate(grams, axis=1)), np.concatenate(counts), len(words) + 1)
    total = int(count.sum())

    def added(width: int) -> tuple[np.ndarray, np.ndarray]:
        rows, sums = _tally(list(gram[:width]), count, len(words) + 1)
        often = (sums >= least) & (rows[width - 1] > 0)
        full = np.zeros((3, int(often.sum())), np.int64)
        full[:width] = rows[:, often]
        return full, sums[often]

    found = [added(width) for width in ((1,) if n == 1 else (2, 3))]
    return words, np.concatenate([f[0] for f in found], axis=1), np.concatenate([f[1] for f in found]), total


def _merged(batches: Iterator, least: int) -> Iterator:
    """Frequent grams of a stream of runs that is sorted by bucket, lang and n; the empty gram counts the words."""
    import pyarrow as pa

    def frame(key: tuple, rows: list[tuple]):
        _, lang, n = key
        words, gram, count, total = _merge(rows, n, least)
        table = pa.array([None, *[w.decode("utf-8", "surrogatepass") for w in words]], pa.string())
        cols = [table.take(pa.array(g)) for g in gram]
        cols = [pa.array([lang] * len(count), pa.string()), *cols, pa.array(count, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "w1", "w2", "w3", "f"])
        if n == 1:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((lang, None, None, None, total), [pa.string()] * 4 + [pa.int64()], strict=True)], names=["lang", "w1", "w2", "w3", "f"])

    key, rows = None, []
    for b in batches:
        for r in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
            if r[:3] != key:
                if rows:
                    yield from frame(key, rows)
                key, rows = r[:3], []
            rows.append(r[3:])
    if rows:
        yield from frame(key, rows)


def count_stream(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, w1, w2, w3, f): the grams of one to three words that occur ``least`` times or more in a language, and
    for each language the empty gram with the number of its words. A null language is ``und``.

    Only sorted and compressed runs are shuffled. A bucket gets the windows that begin with its pairs of words, so
    neither a language nor a word is ever in one task as a whole, and copies are added up before the shuffle.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, ceil(size / bucket_bytes))
    runs = slim.mapInArrow(lambda it: _runs(it, buckets, run_bytes), _RUN)
    sorted_runs = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang", "n")
    grams = kept(sorted_runs.mapInArrow(lambda it: _merged(it, least), _GRAM))
    totals = grams.where("w1 is null").groupBy("lang").agg(F.sum("f").alias("f"))
    none = F.lit(None).cast("string")
    return grams.where("w1 is not null").unionAll(totals.select("lang", *[none.alias(w) for w in ("w1", "w2", "w3")], "f"))


def _in_lockstep(batches: Iterator[pd.DataFrame], last: str, before: dict[int, list[int]], names: tuple[str, str, str]) -> Iterator[pd.DataFrame]:
    """A sorted stream with the counts of the gram without words, of the part of one and of that of two words that each
    row follows on, under ``names``. ``last`` tells the order's second word, whose nulls end a gram of one word."""
    state, part = [0, 0, 0], None
    second, third = ("w2", "w3") if last == "prefix" else ("s2", "s3")
    first = "w1" if last == "prefix" else "s1"
    for frame in batches:
        if not len(frame):
            continue
        parts = frame["part"].to_numpy()
        for at in np.split(np.arange(len(frame)), np.flatnonzero(parts[1:] != parts[:-1]) + 1):
            own = frame.iloc[at].reset_index(drop=True)
            if part != own["part"].iloc[0]:
                part = own["part"].iloc[0]
                state = list(before[int(part)])
            f = own["f"].to_numpy(np.int64)
            size = (own[first].notna().astype(int) + own[second].notna() + own[third].notna()).to_numpy()
            for k, name in enumerate(names):
                here = np.where(size == k, np.arange(len(own)), -1)
                seen = np.maximum.accumulate(here)
                own[name] = np.where(seen >= 0, f[np.maximum(seen, 0)], state[k])
                if seen[-1] >= 0:
                    state[k] = int(f[seen[-1]])
            yield own.drop(columns="part")


def _pass(stream: DataFrame, order: list[str], kind: str, names: tuple[str, str, str]) -> DataFrame:
    """The stream in this order with the counts of the parts that its grams follow on."""
    laid = stream.repartitionByRange("lang", *[F.col(c).asc_nulls_first() for c in order])
    laid = kept(laid.withColumn("part", F.spark_partition_id()))
    size = sum((F.col(c).isNotNull().cast("int") for c in order), F.lit(0))
    ends = [F.max(F.when(size == k, F.struct("lang", *order[:k], "f"))).alias(f"e{k}") for k in range(3)]
    rows = sorted(laid.groupBy("part").agg(*ends).collect(), key=lambda r: r["part"])  # a row a range
    before, state = {}, [0, 0, 0]
    for r in rows:
        before[r["part"]] = list(state)
        state = [r[f"e{k}"]["f"] if r[f"e{k}"] else state[k] for k in range(3)]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in laid.schema.fields if f.name != "part"] + [f"{n} long" for n in names])
    in_order = laid.sortWithinPartitions("part", "lang", *[F.col(c).asc_nulls_first() for c in order])
    return in_order.mapInPandas(lambda it: _in_lockstep(it, kind, before, names), schema)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, held: int = 50, top: int = 2000, **sizes: int) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    ``a`` counts a phrase, ``n`` all words of the language; ``l`` and ``r`` count the parts at the phrase's weakest cut,
    the one with the smallest score floor(1000000 * a * a / (l * r)), of equal ones the first. Phrases occur ``least``
    times at least. A phrase inside a longer one that has ``held`` percent of its occurrences or more is left out.
    Scores are exact for counts below 10^15. Ties go by a, then by the phrase's bytes.

    Null texts count as empty, null languages as ``und``; empty texts and tables give no phrases. Rows that are repeated
    count again. Other columns play no part.
    """
    stream = count_stream(docs, text, lang, least, **sizes)
    ordered = _pass(stream, ["w1", "w2", "w3"], "prefix", ("n", "l1", "l2"))
    grams = ordered.where("w2 is not null or w1 is not null")
    s1 = F.coalesce("w3", "w2", "w1")
    s2 = F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1"))
    s3 = F.when(F.col("w3").isNotNull(), F.col("w1"))
    turned = grams.select("lang", s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), "f", "n", "l1", "l2")
    both = _pass(turned, ["s1", "s2", "s3"], "suffix", ("none", "e1", "e2"))
    three = F.col("s3").isNotNull()
    phrases = kept(
        both.where("s2 is not null").select(
            "lang", three.alias("three"), F.col("f").alias("a"), "n",
            F.when(three, F.col("s3")).otherwise(F.col("s2")).alias("w1"), F.when(three, F.col("s2")).otherwise(F.col("s1")).alias("w2"),
            F.when(three, F.col("s1")).alias("w3"), "l1", "l2", "e1", "e2",
        )
    )
    scored = phrases.withColumns(
        {
            # the cut behind the first word leaves all but it on the right, the one behind the second leaves the last word
            "c1": F.struct(F.lit(1).alias("k"), F.col("l1").alias("l"), F.when(F.col("three"), F.col("e2")).otherwise(F.col("e1")).alias("r")),
            "c2": F.when(F.col("three"), F.struct(F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("e1").alias("r"))),
        }
    )
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = lambda c: F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide(c + '.l')} * {wide(c + '.r')})")
    scored = scored.withColumns({"s1": score("c1"), "s2": F.when(F.col("three"), score("c2"))})
    later = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    scored = scored.withColumns({"cut": F.when(later, F.col("c2")).otherwise(F.col("c1")), "score": F.when(later, F.col("s2")).otherwise(F.col("s1"))})
    # a phrase of three words knows how often its first two and its last two words occur
    inside = phrases.where("three")
    held_first = inside.where(100 * F.col("a") >= held * F.col("l2")).select("lang", "w1", "w2")
    held_last = inside.where(100 * F.col("a") >= held * F.col("e2")).select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))
    gone = held_first.unionAll(held_last).distinct().withColumn("three", F.lit(False))
    left = scored.join(gone, ["lang", "w1", "w2", "three"], "left_anti").select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", "score"
    )
    return _ranked(left, top)


def _ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language. Parts of a language are cut to as many first, so that the last ranking sees
    at most that number from each part."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))
    parted = phrases.withColumn("part", part)
    first = parted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
