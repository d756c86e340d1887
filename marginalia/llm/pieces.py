"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of all words that a batch meets for the first time stand in one flat array. A round looks up the rank of
every pair of neighbours, takes the smallest rank of each word (a segmented minimum), merges its places from left
to right all at once, and closes the gaps, until no pair is left that a piece stands for. Results equal the
library's, which merges one pair at a time: a word's places are merged up to and with the first one that brings
forth a pair of a rank as small, which the library would take next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marginalia.llm.common import ship

SPACE = "▁"
_NONE = np.iinfo(np.int64).max
#: Words whose pieces a worker keeps, and the longest of them in characters.
_WORDS_KEPT, _LONGEST_KEPT = 300_000, 64
_WIDE = 0x250


class Pieces:
    """A BPE model with byte fallback, an identity normaliser and a leading blank, read from a ``.model`` file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        text = [model.id_to_piece(i) for i in range(size)]
        score = [model.get_score(i) for i in range(size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_id[int(text[i][3:5], 16)] = i
        own = {text[i]: i for i in range(size) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError("pieces that go on after a blank are not supported")
        ranks = {s: k for k, s in enumerate(sorted({score[i] for i in own.values()}, reverse=True))}
        # Symbols: the pieces by id, then characters that are inside pieces but are none themselves.
        symbols = dict(own)
        for p in own:
            for c in p:
                symbols.setdefault(c, size + len(symbols))
        width = size + 2 * len(symbols) + 2
        self.other = width - 1  # any character that no piece has
        # Pieces of blanks alone that rank below all others wait until everything else is merged.
        self.blank = own.get(SPACE, -1)
        blanks = {len(p): i for p, i in own.items() if len(p) > 1 and set(p) == {SPACE}}
        late = self.blank >= 0 and all(score[i] == min(score[j] for j in own.values()) for i in blanks.values())
        self.blanks = {1: self.blank} | blanks if late else {}
        pairs = {}
        for p, i in own.items():
            for k in range(1, 1 if late and i in blanks.values() else len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * width + b] = (ranks[score[i]], i)
        keys = np.array(sorted(pairs), np.int64)
        self.width, self.keys = width, keys
        self.rank = np.array([*(pairs[k][0] for k in keys.tolist()), _NONE], np.int64)
        self.merged = np.array([*(pairs[k][1] for k in keys.tolist()), -1], np.int64)
        # an open hash table of the pairs: a look-up costs the same for every pair
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.table = np.full(1 << self.bits, len(keys), np.int64)
        self.spill = 0
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            place = (slot[todo] + self.spill) & ((1 << self.bits) - 1)
            free = self.table[place] == len(keys)
            self.table[place[free]] = todo[free]
            todo = todo[self.table[place] != todo]
            self.spill += 1
        self.character = symbols
        self.size = size
        # decoding: the bytes of each piece, flat
        raw = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(text)]
        self.raw = raw
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        # Neighbouring characters that some piece holds; between others a text can be cut. Characters from _WIDE on
        # count as one that may stand beside any other; blanks, which never need that, stand in their code.
        self.joined = np.zeros((_WIDE + 1, _WIDE + 1), bool)
        self.joined[_WIDE, :] = self.joined[:, _WIDE] = True
        for p in own:
            at = self._classes(p)
            self.joined[at[:-1], at[1:]] = True
        self.known: dict[str, tuple[bytes, int, bytes]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each pair in ``rank`` and ``merged``; their last entry stands for pairs that no piece has."""
        none = len(self.keys)
        if not none:
            return np.full(len(a), 0, np.int64)
        keys = a * self.width + b
        slot, out = self._slot(keys), np.full(len(keys), none, np.int64)
        todo = np.arange(len(keys))
        for k in range(self.spill):
            entry = self.table[(slot[todo] + k) & ((1 << self.bits) - 1)]
            hit = (entry < none) & (self.keys[np.minimum(entry, none - 1)] == keys[todo])
            out[todo[hit]] = entry[hit]
            todo = todo[~hit & (entry < none)]
            if not len(todo):
                break
        return out

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of each word after all merges."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, at = np.unique(codes, return_inverse=True)
        ids = np.array([self.character.get(chr(c), self.other) for c in chars.tolist()], np.int64)
        symbols = ids[at] if len(codes) else np.empty(0, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        origin = np.arange(len(symbols))  # first character of each symbol
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            same = word[:-1] == word[1:]
            pair = np.full(len(symbols), len(self.keys), np.int64)
            where = np.flatnonzero(same)
            pair[where] = self.look_up(symbols[where], symbols[where + 1])
            rank = self.rank[pair]
            starts = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == _NONE, np.diff(np.r_[starts, len(symbols)]))
            if over.any():  # words without a pair leave the array
                done.append((symbols[over], origin[over], word[over]))
                symbols, origin, word, rank, pair = (x[~over] for x in (symbols, origin, word, rank, pair))
                if not len(symbols):
                    break
                starts = np.flatnonzero(np.r_[True, word[:-1] != word[1:]])
                least = least[least != _NONE]
            lowest = np.repeat(least, np.diff(np.r_[starts, len(symbols)]))
            chosen = np.flatnonzero(rank == lowest)
            # of places that overlap, the first, third, ... of a run
            run = np.r_[True, np.diff(chosen) != 1]
            first = np.maximum.accumulate(np.where(run, chosen, -1))
            chosen = chosen[(chosen - first) % 2 == 0]
            new = self.merged[pair[chosen]]
            chosen, new = self._safe(symbols, word, chosen, new, lowest[chosen])
            symbols = symbols.copy()
            symbols[chosen] = new
            stay = np.ones(len(symbols), bool)
            stay[chosen + 1] = False
            symbols, origin, word = symbols[stay], origin[stay], word[stay]
        if len(symbols):
            done.append((symbols, origin, word))
        if not done:
            return [np.empty(0, np.int64) for _ in words]
        symbols, origin, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(origin, kind="stable")
        symbols, origin, word = symbols[order], origin[order], word[order]
        symbols, origin, word = self._blank_runs(symbols, origin, word)
        symbols, word = self._bytes(symbols, origin, word, codes)
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        return [symbols[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _safe(self, symbols, word, chosen, new, lowest):
        """Of each word's places, those up to and with the first whose merge makes a pair of a rank as small."""
        n = len(symbols)
        follows = np.r_[False, (chosen[1:] == chosen[:-1] + 2) & (word[chosen[1:]] == word[chosen[:-1]])]
        before = np.maximum(chosen - 1, 0)
        left = np.where(follows, np.r_[-1, new[:-1]], symbols[before])  # a place merged just before stands there
        has_left = (chosen > 0) & (word[before] == word[chosen])
        after = np.minimum(chosen + 2, n - 1)
        has_right = (chosen + 2 < n) & (word[after] == word[chosen])
        none = len(self.keys)
        made = np.full(len(chosen), False)
        for has, a, b in ((has_left, left, new), (has_right, new, symbols[after])):
            at = np.flatnonzero(has)
            pair = self.look_up(a[at], b[at])
            made[at] |= (pair < none) & (self.rank[pair] <= lowest[at])
        if not made.any():
            return chosen, new
        own = word[chosen]
        first = np.r_[True, own[1:] != own[:-1]]
        count = np.cumsum(made)
        base = np.repeat((count - made)[first], np.diff(np.r_[np.flatnonzero(first), len(own)]))
        ok = (count - made - base) == 0
        return chosen[ok], new[ok]

    def _blank_runs(self, symbols, origin, word):
        """Runs of blanks become the pieces that merging the leftmost pair again and again ends with."""
        if len(self.blanks) < 2:
            return symbols, origin, word
        blank = symbols == self.blank
        joined = np.r_[False, blank[1:] & blank[:-1] & (word[1:] == word[:-1])]
        starts = np.flatnonzero(~joined & np.r_[joined[1:], False])
        if not len(starts):
            return symbols, origin, word
        firsts = np.flatnonzero(~joined)
        lengths = np.diff(np.r_[firsts, len(symbols)])[np.searchsorted(firsts, starts)]
        symbols, stay = symbols.copy(), np.ones(len(symbols), bool)
        for at, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            ids = self._blank_pieces(n)
            symbols[at : at + len(ids)] = ids
            stay[at + len(ids) : at + n] = False
        return symbols[stay], origin[stay], word[stay]

    def _blank_pieces(self, n: int) -> list[int]:
        done: list[int] = []
        while True:
            if len(done) > 1 and done[-2] + done[-1] in self.blanks:
                done[-2:] = [done[-2] + done[-1]]
            elif not n:
                return [self.blanks[k] for k in done]
            elif done and done[-1] + 1 in self.blanks:
                done[-1] += 1
                n -= 1
            else:
                done.append(1)
                n -= 1

    def _bytes(self, symbols, origin, word, codes):
        """Symbols that are no piece become the byte pieces of their character."""
        odd = symbols >= self.size
        if not odd.any():
            return symbols, word
        raw = [chr(c).encode("utf-8", "replace") for c in codes[origin[odd]].tolist()]
        lengths = np.ones(len(symbols), np.int64)
        lengths[odd] = [len(r) for r in raw]
        out, home = np.repeat(symbols, lengths), np.repeat(word, lengths)
        out[np.repeat(odd, lengths)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out, home

    @staticmethod
    def _classes(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(codes == ord(SPACE), ord(" "), np.minimum(codes, _WIDE)).astype(np.uint16)

    def words(self, text: str) -> list[str]:
        """A normalised text cut wherever no piece holds the characters on both sides; no merge reaches over a cut."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        at = self._classes(text)
        cuts = [0, *(np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null counts as empty."""
        found = self.merge(self.words(text or ""))
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids, without the blank that encoding puts in front."""
        out = self.decode_bytes(ids)
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, int, bytes]]:
        """Of at least these words: decimal ids joined by commas, their number, and the bytes they decode to."""
        new = sorted(w for w in words if w not in self.known)
        if len(self.known) + len(new) > _WORDS_KEPT:
            self.known = {}
            new = sorted(words)
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            for w, ids in zip(part, self.merge(part), strict=True):
                self.known[w] = (",".join(map(str, ids.tolist())).encode(), len(ids), self.decode_bytes(ids))
        out = self.known
        if any(len(w) > _LONGEST_KEPT for w in new):
            self.known = {w: x for w, x in out.items() if len(w) <= _LONGEST_KEPT}
        return out


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a file, read once in each worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array of ints; null and empty texts have none."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        p = pieces(model)
        for b in batches:
            out = [p.encode(t).astype(np.int32) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of ids; null arrays count as empty."""
    ship(docs.sparkSession)
    at = docs.columns.index(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        p = pieces(model)
        for b in batches:
            out = [p.decode(np.array(x or [], np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text's round trip through ids, as digests.

    One pass, no shuffle; a row of output for every row. A null text counts as empty, which has no ids and decodes
    to nothing. Long texts are taken as a whole. Words that a worker has met are not merged again.
    """
    ship(docs.sparkSession)
    slim = docs.select(doc_id, text)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = T.StructType([T.StructField("doc_id", slim.schema[0].dataType), T.StructField("n_tokens", T.LongType()), *[T.StructField(n, T.StringType()) for n in names[2:]]])

    def run(batches: Iterator) -> Iterator:
        p = pieces(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 500):
                split = [p.words(t or "") for t in texts[lo : lo + 500]]
                known = p.learn(set().union(*split))
                rows = []
                for words in split:
                    ids, counts, raw = zip(*[known[w] for w in words], strict=True) if words else ((), (), ())
                    out = b"".join(raw)
                    out = out[1:] if out[:1] == b" " else out
                    rows.append((sum(counts), hashlib.sha256(b",".join(ids)).hexdigest(), hashlib.sha256(out).hexdigest()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 500), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], names=names)

    return slim.mapInArrow(run, schema)
