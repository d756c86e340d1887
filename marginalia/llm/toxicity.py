"""Toxicity by the nearest labelled examples.

Texts become TF-IDF vectors over all words of the labelled examples. The 10 examples with the largest cosine are found
exactly with a block-max inverted index and vote with their cosine as weight; a logistic curve fitted by leave-one-out
turns the votes into a score. So that nearness is not nearness of topic alone, a word's weight grows, by a bounded
factor, with the share of toxic ones among the training texts that have it. No word is left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import first_rows, kept, portions, ship, utf8, words_of

#: Bounds of the model, and so of what is broadcast: examples, and their words, each counted once an example.
MAX_EXAMPLES = 3_072
MAX_POSTINGS = 1_500_000
NEIGHBOURS = 10
BLOCK = 32
#: The words of the most examples have their weights in a table of all blocks, without gaps.
FREQUENT = 128
THRESHOLD = 0.7
#: A word weighs up to 1 + CLASS_WEIGHT times its inverse document frequency; Z is how sure its share has to be.
CLASS_WEIGHT, Z = 30.0, 2.0
#: Strength of the prior among the votes.
STRENGTH = 0.5
#: Examples that stand in one block should be alike: they are laid out by which of so many frequent words they have.
SIGNATURE = 24
EVIDENCE = 3
#: Blocks scored before any is left out.
FIRST = 6
_CACHE = 1 << 13


@dataclass
class Examples:
    """Labelled vectors and their block-max inverted index. Examples stand in blocks of BLOCK; each word has its
    postings (example, weight) by example. The FREQUENT most frequent words have them as a row of a table of all
    blocks as well, and the largest weight in each block. A rarer word has about one posting in a block, if any, so its
    postings are the maxima."""

    spelled: pa.Array  # the words; as a dict they are wanted in the tasks alone
    factor: np.ndarray  # inverse document frequency times class weight
    labels: np.ndarray
    ids: np.ndarray
    starts: np.ndarray  # postings of word w: starts[w] to starts[w + 1]
    rows: np.ndarray
    weights: np.ndarray
    frequent: np.ndarray  # row of a word in the two tables, or -1
    table: np.ndarray  # row, block, place in the block: weight
    table_tops: np.ndarray  # row, block: largest weight
    prior: float
    slope: float
    shift: float
    unknown: float  # score of a text that shares no word with an example

    @cached_property
    def words(self) -> dict[bytes, int]:
        return _numbers(self.spelled)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a text: word numbers and weights, empty if it shares none with an example."""
        own = [k for k in map(self.words.get, words_of(text)) if k is not None]
        if not own:
            return np.empty(0, np.int64), np.empty(0)
        at, n = np.unique(np.array(own, np.int64), return_counts=True)
        x = (1 + np.log(n)) * self.factor[at]
        return at, x / np.sqrt((x * x).sum())

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosine, ties to the smaller number: numbers and cosines.

        A block's bound is the sum of the frequent words' block maxima and the largest sum of the other words' weights
        in it. The blocks with the largest bounds are scored first, then those whose bound is not below the k-th best
        cosine found."""
        row = self.frequent[at]
        often, y, row = row >= 0, x[row >= 0], row[row >= 0]
        spots, size = _spread(self.starts[at[~often]], self.starts[at[~often] + 1])
        n = self.table_tops.shape[1]
        rare = np.bincount(self.rows[spots], self.weights[spots] * np.repeat(x[~often], size), minlength=n * BLOCK).reshape(n, BLOCK)
        total = np.einsum("i,ij->j", y, self.table_tops[row]) + rare.max(axis=1)
        falling = np.argsort(-total, kind="stable")
        falling = falling[total[falling] > 0]
        found, cosines, least = np.empty(0, np.int64), np.empty(0), 0.0
        for step in falling[:FIRST], falling[FIRST:]:
            own = step[total[step] >= least - 1e-9]
            if not len(own):
                break
            score = np.einsum("i,ijk->jk", y, self.table[row[:, None], own]) + rare[own]
            who, score = (own[:, None] * BLOCK + np.arange(BLOCK)).ravel(), score.ravel()
            new = np.minimum(score, 1.0).round(9)
            good = (score > 0) & (new >= least) & (who != but)
            found, cosines = np.concatenate([found, who[good]]), np.concatenate([cosines, new[good]])
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            least = cosines[-1] if len(found) == k else 0.0
        return found, cosines

    def score(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The calibrated share of toxic votes, drawn to the prior where the neighbours are far."""
        if not len(found):
            return self.unknown
        odds = _log_odds(float(cosines @ self.labels[found]), float(cosines.sum()), self.prior)
        return float(_logistic(self.slope * odds + self.shift))


def _numbers(words: pa.Array) -> dict[bytes, int]:
    return {w.as_py(): k for k, w in enumerate(words)}


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and the ranges' lengths."""
    size = stop - start
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum()), size


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(votes, total, prior: float):
    share = (votes + STRENGTH * prior) / (total + STRENGTH)
    return np.log(share / (1 - share))


def _class_weights(size: int, found: list[tuple], alike: list[int]) -> np.ndarray:
    """1 to 1 + CLASS_WEIGHT for each word, by the lower end of a confidence interval (Wilson) for the share of toxic
    ones among the different texts with the word; ``alike`` has a hash of each example's text."""
    n, toxic = np.zeros(size), np.zeros(size)
    once: dict[int, tuple] = {}
    for (_, y, at, _), k in zip(found, alike, strict=True):
        once[k] = max(y, once[k][0]) if k in once else y, at
    for y, at in once.values():
        n[at] += 1
        toxic[at] += y
    n = np.maximum(n, 1)
    share = toxic / n
    sure = (share + Z * Z / (2 * n) - Z * np.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return 1 + CLASS_WEIGHT * np.clip(sure, 0, 1)


def _index(words: pa.Array, factor: np.ndarray, found: list[tuple]) -> Examples:
    """found: (id, label, word numbers, counts) of each example, in a fixed order."""
    n, size = len(found), len(words)
    spread = np.bincount(np.concatenate([f[2] for f in found]), minlength=size) if size else np.empty(0, np.int64)
    frequent = np.argsort(-spread, kind="stable")[:SIGNATURE]
    found = sorted(found, key=lambda f: np.isin(frequent, f[2]).tobytes(), reverse=True)
    rows, cols, values = [], [], []  # by row
    for row, (_, _, at, counts) in enumerate(found):
        if len(at):
            x = (1 + np.log(counts)) * factor[at]
            rows.append(np.full(len(at), row, np.int32))
            cols.append(at.astype(np.int32))
            values.append(x / np.sqrt((x * x).sum()))
    r, c, v = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((rows, np.int32), (cols, np.int32), (values, float)))
    del rows, cols, values
    order = np.argsort(c, kind="stable")
    r, c, v = r[order].astype(np.int64), c[order], v[order]
    del order
    starts = np.searchsorted(c, np.arange(size + 1))
    labels = np.array([y for _, y, _, _ in found], float)
    blocks = -(-n // BLOCK)
    often = np.argsort(-np.diff(starts), kind="stable")[:FREQUENT]
    frequent = np.full(size, -1)
    frequent[often] = np.arange(len(often))
    table = np.zeros((len(often), blocks * BLOCK))
    own = frequent[c] >= 0
    table[frequent[c[own]], r[own]] = v[own]
    table = table.reshape(len(often), blocks, BLOCK)
    bare = np.array([not len(at) for _, _, at, _ in found], bool)
    prior = (labels.sum() + 0.5) / (n + 1)
    out = Examples(
        words, factor, labels, np.array([i for i, _, _, _ in found], dtype=object), starts, r, v,
        frequent, table, table.max(axis=2), prior, 1.0, 0.0, min(prior, (labels[bare].sum() + prior) / (bare.sum() + 1)),
    )
    return _calibrated(out)


def _calibrated(model: Examples) -> Examples:
    """Fit slope and shift of the logistic curve on up to 2000 examples, each with the votes of the others (Newton's
    method, drawn a little to slope 1 and shift 0)."""
    by_row = np.argsort(model.rows, kind="stable")
    word = np.repeat(np.arange(len(model.starts) - 1), np.diff(model.starts))[by_row]
    bounds = np.searchsorted(model.rows[by_row], np.arange(len(model.labels) + 1))
    near = []
    for r in range(0, len(model.labels), max(1, len(model.labels) // 2000)):
        s = slice(bounds[r], bounds[r + 1])
        found, cosines = model.nearest(word[s], model.weights[by_row[s]], but=r)
        if len(found):
            near.append((model.labels[r], float(cosines @ model.labels[found]), float(cosines.sum())))
    if near:
        y, votes, total = map(np.array, zip(*near, strict=True))
        z, at = _log_odds(votes, total, model.prior), np.array([1.0, 0.0])
        for _ in range(50):
            p = _logistic(at[0] * z + at[1])
            pull = np.array([((p - y) * z).sum(), (p - y).sum()]) + 0.1 * (at - [1.0, 0.0])
            w = p * (1 - p)
            bend = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
            at = at - np.clip(np.linalg.solve(bend, pull), -1, 1)
        model.slope, model.shift = float(max(at[0], 0.1)), float(at[1])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    max_examples: int = MAX_EXAMPLES,
    max_postings: int = MAX_POSTINGS,
) -> Examples:
    """Learn from the labelled rows whose crc32 of the id as text is not 1 modulo 3.

    At most ``max_examples`` labelled rows are used (those whose ids have the smallest hashes), and of these, in that
    order, those whose different words stay within ``max_postings`` in all. Every word of an example has its place; the
    inverse document frequencies are counted over all documents. An id with several labels counts as toxic if one says
    so; rows that repeat an id are an example each, rows without an id or label are none. Equal texts count once for
    the words' class weights. With no labelled rows every score is 0.5 or less.
    """
    spark = docs.sparkSession
    ship(spark)
    known = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .where(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1)
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    known = first_rows(known, max_examples, F.xxhash64("id"), F.col("id"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    schema = T.StructType([texts.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("w", T.ArrayType(T.BinaryType())), T.StructField("n", T.ArrayType(T.IntegerType()))])

    def counted(batches: Iterator) -> Iterator:
        for b in portions(batches):
            found = [sorted(Counter(words_of(t.as_py())).items()) for t in b.column("text")]
            w = pa.array([[w for w, _ in f] for f in found], pa.list_(pa.binary()))
            n = pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), b.column("k"), w, n], ["id", "y", "k", "w", "n"])

    rows = texts.select("id", "y", F.xxhash64("text").alias("k"), "text").mapInArrow(counted, schema)
    order = [F.xxhash64("id"), F.col("id"), F.col("k")]
    rows = kept(first_rows(rows, max_examples, *order).withColumn("size", F.size("w")))
    fits, left = [], max_postings
    for r in rows.select("id", "k", "size").orderBy(*order, "size").collect():  # max_examples rows of three numbers
        fits.append(r["size"] <= left)
        left -= r["size"] if fits[-1] else 0
    table = rows.orderBy(*order, "size").select("id", "y", "k", F.when(F.col("size") <= max_postings, F.col("w")).alias("w"), "n").toArrow()
    table = table.filter(pa.array(fits, pa.bool_()))
    flat = table["w"].combine_chunks().flatten()
    words = pc.unique(flat)
    words = words.take(pc.sort_indices(words))
    numbers = pc.index_in(flat, words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum([0, *pc.list_value_length(table["w"]).to_pylist()])
    table = table.drop_columns(["w"])
    del flat
    everywhere = spark.sparkContext.broadcast(words)

    def frequencies(batches: Iterator) -> Iterator:
        own = _numbers(everywhere.value)
        counts, n = np.zeros(len(own), np.int64), 0
        for b in portions(batches):
            for t in b.column(0):
                n += 1
                met = own.keys() & set(words_of(t.as_py()))
                counts[np.fromiter(map(own.__getitem__, met), np.int64, len(met))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, counts[at]])], ["w", "n"])

    seen = docs.select(text).mapInArrow(frequencies, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    everywhere.destroy()
    at, n = seen["w"].to_numpy(), seen["n"].to_numpy()
    frequency = np.zeros(len(words))
    frequency[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / (1 + frequency)) + 1

    counts = table["n"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    found = [
        (i, y, numbers[a:b], counts[a:b]) for i, y, a, b in zip(table["id"].to_pylist(), table["y"].to_pylist(), ends[:-1], ends[1:], strict=True)
    ]
    return _index(words, idf * _class_weights(len(words), found, table["k"].to_pylist()), found)


def score(docs: DataFrame, model: Examples, text: str = "text", names: tuple[str, str, str] = ("score", "predicted", "evidence"), threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the score (0 to 1), whether it reaches ``threshold`` (1 or 0), and the evidence: the nearest
    examples as (id, cosine, label). One pass; the model, whose size is bounded, is broadcast. Null and empty texts,
    and texts that share no word with an example, get the share of toxic ones among such examples and no evidence."""
    at = docs.columns.index(text)
    ship(docs.sparkSession)
    model_everywhere = docs.sparkSession.sparkContext.broadcast(model)
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.ArrayType(item))])

    def run(batches: Iterator) -> Iterator:
        m = model_everywhere.value
        memo: dict[bytes, tuple] = {}
        for b in portions(batches):
            out = []
            for t in b.column(at):
                t = t.as_py()
                key = hashlib.blake2b(utf8(t), digest_size=16).digest()
                if key not in memo:
                    if len(memo) >= _CACHE:
                        memo.clear()
                    found, cosines = m.nearest(*m.vector(t))
                    memo[key] = m.score(found, cosines), [
                        {"id": str(m.ids[f]), "cosine": float(c), "label": int(m.labels[f])}
                        for f, c in zip(found[:EVIDENCE], cosines[:EVIDENCE], strict=True)
                    ]
                out.append(memo[key])
            scores = np.array([s for s, _ in out], float)
            kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))
            more = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array([e for _, e in out], kind)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
