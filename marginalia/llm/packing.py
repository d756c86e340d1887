"""Token sequences of fixed length, packed so that their attention costs are alike.

Texts are cut to token ids and packed in the task that read them: there is no shuffle, and a task holds one window
of documents at a time, whatever the size of its input.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import portions, ship, utf8

LENGTH = 2048
END_ID = 1
#: Cost of a piece of n tokens: LINEAR * n for the layers, plus QUADRATIC * n * n for attention within the piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Sequences in a window.
WINDOW = 256
#: Words whose ids a worker keeps, and the longest of them in bytes.
_WORDS_KEPT, _LONGEST_KEPT = 400_000, 128


#: Texts of these characters alone are lower-cased and cut into words here, as the tokenizer would.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_CUT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file that lower-cases, cuts at white space, letters, digits and symbols, and
    ends every word with a marked piece. Words already met are looked up; new ones are encoded together and told
    apart by their last pieces. Texts with other than plain characters go to the tokenizer a blank-parted word at a time."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str | bytes, bytes] = {}

    def _words(self, text: str | None) -> list[str | bytes]:
        """Words to look up: text for words cut here, bytes for those that the tokenizer cuts."""
        text = text or ""
        if any(s in text for s in self.special):
            return utf8(text).split()  # at \x20 and \x09-\x0D only
        if _PLAIN.fullmatch(text):
            return _CUT.findall(text.lower())
        out: list[str | bytes] = []
        for w in utf8(text).split():
            plain = w.decode("utf-8", "replace")
            out.extend(_CUT.findall(plain.lower()) if _PLAIN.fullmatch(plain) else [w])
        return out

    def learn(self, words: set[str | bytes]) -> dict[str | bytes, bytes]:
        """Ids of at least these words."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > _WORDS_KEPT:
            self.known = {}
            new = list(words)
        plain = [w for w in new if isinstance(w, str)]
        for lo in range(0, len(plain), 8192):
            part = plain[lo : lo + 8192]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):
                raise ValueError("words do not end with a marked piece: another kind of tokenizer")
            raw, start = ids.tobytes(), 0
            for w, stop in zip(part, stops.tolist(), strict=True):
                self.known[w] = raw[start:stop]
                start = stop
        for w in new:
            if isinstance(w, bytes):
                ids = self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids
                self.known[w] = np.array(ids, dtype="<u4").tobytes()
        out = self.known
        if any(len(w) > _LONGEST_KEPT for w in new):
            self.known = {w: x for w, x in out.items() if len(w) <= _LONGEST_KEPT}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        split = [self._words(t) for t in texts]
        known = self.learn(set().union(*split))
        end = np.array([END_ID], dtype="<u4").tobytes()
        return [b"".join([known[w] for w in words]) + end for words in split]


@dataclass
class Loaded:
    """An encoder for the tasks of one job. It is broadcast as its path alone; a worker loads it when it is wanted, and
    lets go of it, with all the words met, when a task of another job comes."""

    path: str

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self.path)


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def powers(n: int) -> list[int]:
    """n as a sum of different powers of two, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def assign(sizes: list[int], limits: list[int]) -> list[list[tuple[int, int, int]]]:
    """Deal documents of these sizes to sequences of these limits, which sum to the sizes' sum.

    Falling by size, a document goes to the sequence of the lowest cost among those with room for all of it. What
    fits nowhere whole is cut over the sequences with the most room left. Returns (document, start, length) lists;
    all sequences come out full.
    """
    room = np.array(limits, dtype=np.int64)
    load = np.zeros(len(limits))
    out: list[list[tuple[int, int, int]]] = [[] for _ in limits]
    rest = []
    for d in sorted(range(len(sizes)), key=lambda d: (-sizes[d], d)):
        n = sizes[d]
        best = int(np.argmin(np.where(room >= n, load, np.inf)))
        if room[best] < n:
            rest.append(d)
            continue
        out[best].append((d, 0, n))
        room[best] -= n
        load[best] += cost(n)
    for d in rest:
        at, n = 0, sizes[d]
        while at < n:
            best = int(np.argmax(room))
            take = int(min(room[best], n - at))
            out[best].append((d, at, take))
            room[best] -= take
            load[best] += cost(take)
            at += take
    return out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of all documents.

    A document is its ids and the end id; a null or empty text is the end id alone, so every row has a piece, and
    rows that repeat an id are documents of their own. Whole lengths of a longer document fill sequences of their
    own. What is left goes through a window: once it holds ``window`` sequences' worth of tokens, full sequences are
    dealt out by cost (``assign``) and the window starts anew. The last window of a task also fills sequences whose
    lengths are the powers of two of the tokens left, so no sequence needs padding (a length that is a power of two
    needs none). The number of the task stands in the upper bits of sequence_id, so that it is unique and the same
    if a task runs again on the same input. Other columns play no part. An empty table gives no pieces.
    """
    if length & (length - 1):
        raise ValueError("the length has to be a power of two")
    ship(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [slim.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    names = [f.name for f in fields] + ["ids"] * with_ids
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    everywhere = docs.sparkSession.sparkContext.broadcast(Loaded(tokenizer))

    def run(batches: Iterator) -> Iterator:
        encoder = everywhere.value.encoder
        number = TaskContext.get().partitionId() << 40
        kind = None

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True)) or [[]] * 8
            arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            if with_ids:
                sizes = np.r_[0, np.cumsum([len(x) // 4 for x in cols[7]])].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(cols[7]), "<i4"))))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def dealt(held: list[tuple], limits: list[int]) -> list[tuple]:
            nonlocal number
            pieces = []
            for members in assign([len(raw) // 4 for _, _, _, raw in held], limits):
                offset = 0
                for d, at, n in members:
                    doc, start, total, raw = held[d]
                    own = raw[at * 4 : (at + n) * 4]
                    pieces.append((doc, start + at, n, zlib.crc32(own), total, number, offset, own))
                    offset += n
                number += 1
            return pieces

        held, tokens = [], 0
        for b in portions(batches):
            kind = b.schema.field(0).type
            pieces = []
            for doc, raw in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                total = len(raw) // 4
                whole = total // length * length
                for at in range(0, whole, length):
                    own = raw[at * 4 : (at + length) * 4]
                    pieces.append((doc, at, length, zlib.crc32(own), total, number, 0, own))
                    number += 1
                if whole < total:
                    held.append((doc, whole, total, raw[whole * 4 :]))
                    tokens += total - whole
                if tokens >= window * length:
                    # the document that overfills the window is cut; its end waits for the next one
                    over = tokens - window * length
                    last = held.pop()
                    keep = len(last[3]) // 4 - over
                    held.append((last[0], last[1], last[2], last[3][: keep * 4]))
                    pieces += dealt(held, [length] * window)
                    held, tokens = ([(last[0], last[1] + keep, last[2], last[3][keep * 4 :])], over) if over else ([], 0)
            if pieces:
                yield batch(pieces)
        if held:
            yield batch(dealt(held, [length] * (tokens // length) + powers(tokens % length)))

    return slim.mapInArrow(run, schema)
