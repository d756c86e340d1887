"""Alignment of two tokenizers over the same bytes, by runs along a diagonal.

Both tokenizers cut a text's bytes into tokens, which gives two ascending arrays of ends. A place where both have an
end closes a group. As long as tokens are the same on both sides, the arrays agree at a constant shift of their indexes:
such a stretch is measured by comparing blocks that double in length, then halve down to the first difference, and is
jumped over as a whole. Where the arrays differ, two pointers walk to the next common end, which closes an irregular
group, and the shift becomes the difference of the pointers there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import kept, scratch, ship

#: Pairs of ids whose counts are sent to every task, at most; the rarer ones beyond are joined.
HEAD_PAIRS = 1 << 20
#: Tokens that a first probe compares.
_PROBE = 8
#: Texts encoded at a time.
_TEXTS = 200


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """(stretches, left, right) of two ascending arrays of ends with the same last value.

    A stretch is (i, j, length): ``length`` one-to-one groups that begin with token i of A and token j of B, or, with
    length 0, one irregular group up to where the next stretch begins. ``left`` and ``right`` are the places of the
    tokens of A and of B whose bytes overlap, for every pair that does.
    """
    stretches: list[tuple[int, int, int]] = []
    left: list[int] = []
    right: list[int] = []
    n, i, shift = len(ends_a), 0, 0
    while i < n:
        # double while whole blocks agree, then halve down to the first difference
        start, step = i, _PROBE
        while (block := ends_a[i : i + step]) and block == ends_b[i + shift : i + shift + step]:
            i += len(block)
            step += step
        while step > 1:
            step >>= 1
            block = ends_a[i : i + step]
            if block and block == ends_b[i + shift : i + shift + step]:
                i += len(block)
        j = i + shift
        if i > start:
            stretches.append((start, start + shift, i - start))
            left += range(start, i)
            right += range(start + shift, j)
            if i == n:
                break
        stretches.append((i, j, 0))
        end_a, end_b = ends_a[i], ends_b[j]
        left.append(i)
        right.append(j)
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = ends_a[i]
            else:
                j += 1
                end_b = ends_b[j]
            left.append(i)
            right.append(j)
        i += 1
        shift = j + 1 - i
    if i + shift != len(ends_b):
        raise ValueError("the ends of both sides differ")
    return stretches, left, right


class _Written(dict):
    """The way groups are written: a pair of ids, as one number, or the ids of both sides, as two tuples."""

    def __init__(self, size_b: int) -> None:
        self.size_b = size_b

    def __missing__(self, pair: int | tuple[tuple[int, ...], tuple[int, ...]]) -> str:
        if isinstance(pair, tuple):
            text = f"{','.join(map(str, pair[0]))}|{','.join(map(str, pair[1]))}"
        else:
            text = f"{pair // self.size_b}|{pair % self.size_b}"
        if len(self) < 200_000 and (not isinstance(pair, tuple) or len(pair[0]) + len(pair[1]) < 12):
            self[pair] = text
        return text


def written(stretches: list[tuple[int, int, int]], a: list[int], b: list[int], pairs: list[int], known: _Written) -> str:
    """The groups as text: ``a1,a2|b1;a3|b2,b3``. ``pairs`` has the links' pairs of ids in order."""
    out: list[str] = []
    at = 0
    for (i, j, run), (to_i, to_j, _) in zip(stretches, [*stretches[1:], (len(a), len(b), 0)], strict=True):
        if run:
            out += map(known.__getitem__, pairs[at : at + run])
            at += run
        else:
            own = tuple(a[i:to_i]), tuple(b[j:to_j])
            out.append(known[own])
            at += to_i - i + to_j - j - 1
    return ";".join(out)


def _byte_of_character() -> dict[str, int]:
    """The bytes that a byte-level vocabulary writes as characters: printable ones as themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """A byte-level tokenizer (A) and a piece model (B) with the bytes of each of their tokens.

    A is run from the ranks of its vocabulary, which is the same if merges stand in the order of the ids they make.
    """

    def __init__(self, byte_level: str, pieces: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of_character()
        vocabulary = {bytes([byte_of[c] for c in t]): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("merges in another order than their ids")
        merged = set(made)
        ranks = {t: i for t, i in vocabulary.items() if len(t) == 1 or i in merged}
        self.a = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size_b = self.b.vocab_size()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = t
        own = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(own)]
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.known = _Written(self.size_b)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none if it is empty or one side does not give its bytes back."""
        whole: dict[int, bytes] = {}
        for k, text in enumerate(texts):
            try:
                if text:
                    whole[k] = (" " + text).encode()
            except UnicodeEncodeError:  # half of a surrogate pair has no bytes
                continue
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        sides = self.b.encode([texts[k] for k in whole], num_threads=1) if whole else []
        for (k, own), b in zip(whole.items(), sides, strict=True):
            # A cuts the bytes and nothing else; B may know another form of a character
            if b"".join(map(self.bytes_b.__getitem__, b)) == own:
                out[k] = (self.a.encode_ordinary(" " + texts[k]), b)
        return out

    def row(self, a: list[int], b: list[int]) -> tuple:
        """n_a, n_b, n_groups, n_links, the digest of the groups, the different pairs of ids and how often each is linked."""
        if not a:
            return 0, 0, 0, 0, "", b"", b""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        stretches, left, right = align(np.cumsum(self.length_a[ids_a]).tolist(), np.cumsum(self.length_b[ids_b]).tolist())
        pairs = ids_a[left] * self.size_b + ids_b[right]
        digest = hashlib.sha256(written(stretches, a, b, pairs.tolist(), self.known).encode()).hexdigest()
        pair, often = np.unique(pairs, return_counts=True)
        return len(a), len(b), sum([run or 1 for _, _, run in stretches]), len(left), digest, pair.tobytes(), often.tobytes()


_loaded: dict[tuple[str, str, str], Tokenizers] = {}


def tokenizers(*files: str) -> Tokenizers:
    """Both tokenizers, read once in each worker."""
    if files not in _loaded:
        _loaded[files] = Tokenizers(*files)
    return _loaded[files]


def _aligned(batches: Iterator, files: tuple[str, str, str]) -> Iterator:
    """Of rows (row, doc_id, text): the numbers of each text, its groups' digest, and its different pairs of ids."""
    import pyarrow as pa

    both = tokenizers(*files)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often"]
    for batch in batches:
        for lo in range(0, batch.num_rows, _TEXTS):
            some = batch.slice(lo, _TEXTS)
            cols = list(zip(*[both.row(a, b) for a, b in both.encode(some.column(2).to_pylist())], strict=True))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)


def _summed(batches: Iterator, size_b: int) -> Iterator:
    """Counts of the pairs of many texts, added up before they are shuffled."""
    import pyarrow as pa

    def sums(keys: list[np.ndarray], counts: list[np.ndarray]):
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        return own, np.bincount(at, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64) if len(own) else own

    keys, counts, waiting = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for batch in batches:
        for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(np.frombuffer(p, np.int64))
            counts.append(np.frombuffer(c, np.int64))
            waiting += len(keys[-1])
        if waiting > 4_000_000:
            own, often = sums(keys, counts)
            keys, counts, waiting = [own], [often], 0
            if len(own) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own % size_b), pa.array(often)], names=["pair", "b", "n"])
                keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    own, often = sums(keys, counts)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own % size_b), pa.array(often)], names=["pair", "b", "n"])


def _head(pairs: DataFrame, most: int) -> tuple[int, DataFrame]:
    """A count from which on at most ``most`` pairs are, as many as can be, and these pairs."""
    # a row for each size class of counts: at most 64 * 64 of them, whatever the corpus
    step = F.floor(F.log2("n") * 64).cast("int")
    classes = sorted(((r["c"], r["pairs"], r["least"]) for r in pairs.groupBy(step.alias("c")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()), reverse=True)
    total, least = 0, None
    for _, held, low in classes:
        if total + held > most:
            break
        total, least = total + held, low
    return total, pairs.where(F.col("n") >= least) if least is not None else pairs.where("false")


def aligned(docs: DataFrame, byte_level: str, pieces: str, pattern: str, text: str = "text", doc_id: str = "doc_id", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """For every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level vocabulary with its splitting pattern) encodes a blank and the text, B the text; tokens are compared as bytes. ``n_links`` counts pairs of tokens whose
    bytes overlap, a pair of ids counts as often as it is linked in the corpus, ``n_best`` counts links whose pair has the
    highest count of its id of B (ties included), ``count_sum`` adds the counts up over the links. Null and empty
    texts, and texts that one side does not give back byte for byte, have no tokens: zeros and an empty digest. Rows
    that repeat an id keep a row each and count each; other columns play no part. An empty table gives no rows.

    Texts are encoded once; what is kept of them in the shared folder are their numbers and different pairs. Counts of
    the ``head_pairs`` most frequent pairs are sent to the tasks, which is all of them in most corpora; texts with
    rarer ones get these by a join.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, often binary"
    folder = scratch(spark)
    slim.mapInArrow(lambda it: _aligned(it, (byte_level, pieces, pattern)), schema).write.parquet(folder)
    texts = spark.read.parquet(folder)
    size_b = tokenizers(byte_level, pieces, pattern).size_b
    counted = texts.select("pairs", "often").mapInArrow(lambda it: _summed(it, size_b), "pair long, b long, n long")
    counted = counted.groupBy("pair", "b").agg(F.sum("n").alias("n"))
    counted = kept(counted)
    highest = counted.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B
    pairs = kept(counted.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    known, head = _head(pairs, head_pairs)
    table = head.orderBy("pair").toArrow()
    held = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair, n, best = held.value
        for batch in batches:
            sums, bests, rest, rest_often = [], [], [], []
            for p, c in zip(batch.column("pairs").to_pylist(), batch.column("often").to_pylist(), strict=True):
                own, often = np.frombuffer(p, np.int64), np.frombuffer(c, np.int64)
                at = np.searchsorted(pair, own)
                there = np.append(pair, -1)[at] == own
                at, seen = at[there], often[there]
                sums.append(int((n[at] * seen).sum()))
                bests.append(int(seen[best[at]].sum()))
                rest.append(own[~there])
                rest_often.append(often[~there])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rest, rest_often)]
            cols = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            cols += [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), batch.column("groups_sha256"), *lists]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest", "rest_often"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = "row long, doc_id " + kind + ", n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<long>, rest_often array<long>"
    result = texts.mapInArrow(scored, out)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if known == pairs.count():
        return result.select(columns)
    rarer = result.select("row", F.explode(F.arrays_zip("rest", "rest_often")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_often").alias("often"))
    added = rarer.join(pairs, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("often")).alias("more"), F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best")
    )
    whole = result.join(added, "row", "left").withColumns(
        {"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))}
    )
    return whole.select(columns)
