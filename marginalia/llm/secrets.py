"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

The forest sees the length of a candidate, its character classes and how they follow each other, how likely its
character transitions are in ordinary words, how much of it dictionary words cover, the path it was found at and
the words beside it. It is trained by Spark's RandomForestClassifier from labelled findings, of which there is a
bounded number, as do the word odds; dictionary and transitions are counted over all documents. The trees are then
sent to the tasks as arrays, so a scan is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import first_rows, kept, portions, ship, utf8

MASK = "[SECRET]"
THRESHOLD = 0.5
#: Bounds of what training sees and of the model.
MAX_DOCUMENTS = 10_000
MAX_FINDINGS = 20_000
MAX_DICTIONARY = 50_000
TREES, DEPTH = 30, 8
CONTEXT = 60

#: Runs of 12 or more characters with a digit, and runs of 8 or more that are assigned in quotes.
CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}={0,2}"
    r"|(?:(?<=[=:][\"'])|(?<=[=:] [\"']))[A-Za-z0-9+/_\-]{8,}={0,2}(?=[\"']))"
)
#: After a credential's name and in addresses, any run of 6 or more characters without blanks; in quotes up to the quote.
_NAMED = re.compile(
    r"(?i:tok(?:en)?|secret|pass(?:w(?:or)?d)?|pwd|key|auth|cred(?:ential)?s?|bearer)[\w\-]{0,40}[\"']?[ \t]*(?:=>|:=|=|:)[ \t]*"
    r"(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"'<>]{6,}))"
    r"|://[^\s/:@]{0,200}:([^\s/@]{6,200})@"
)
_ASSIGNED = re.compile(r"([\w\-]+)[\"']?\s*(?:=|:|=>)\s*[\"']?$")
_ADDRESS = re.compile(r"://[^\s/:@]*:$")
_PASSWORD = re.compile(r"(?i)pass|pwd|secret")
_CREDENTIAL = re.compile(r"(?i)tok(en)?|secret|pass(w(or)?d)?|pwd|key|auth|cred|bearer")
#: Published shapes of keys that need no name beside them.
_SHAPED = re.compile(r"AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|xox[abp]-[A-Za-z0-9\-]{20,}|AIza[A-Za-z0-9_\-]{35}")
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"[a-z]{3,}")
_CLASSES = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}, **{c: "-" for c in "+/_-="}})
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "entropy", "distinct", "class_changes", "transition_odds",
    "dictionary", "hex", "assigned", "quoted", "credential_near", "neighbour_odds", "path_odds",
    "in_address", "password_near",
)


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Ranges (start, end) of all candidates in the whole text; none in null and empty texts."""
    text = text or ""
    named = [m.span(m.lastindex) for m in _NAMED.finditer(text)]
    # punctuation that ends a clause is no part of an unquoted value
    named = [(s, s + len(text[s:e].rstrip(".,;)]}"))) for s, e in named]
    found = sorted([x for x in named if x[1] - x[0] >= 6] + [m.span() for m in CANDIDATE.finditer(text)], key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for s, e in found:  # of two that overlap, the one that begins first
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


@dataclass
class Model:
    """What scoring needs; every part has a bound."""

    dictionary: set[str]
    transitions: np.ndarray
    odds: dict[str, float]
    path_odds: dict[str, float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def features(self, value: str, before: str, after: str, path: str | None) -> list[float]:
        n = len(value)
        kinds = re.sub(r"[^aA0]", "-", value.translate(_CLASSES))
        counts = np.array(list(Counter(value).values()), float) / n
        assigned = _ASSIGNED.search(before)
        near = _WORD.findall(before)[-3:]
        covered = 0
        for run in _LETTERS.findall(value.lower()):
            at = 0
            while at < len(run):
                size = next((k for k in range(min(14, len(run) - at), 2, -1) if run[at : at + k] in self.dictionary), 0)
                covered += size
                at += size or 1
        codes = np.frombuffer(utf8(value.lower()), np.uint8)
        return [
            float(n), kinds.count("0") / n, kinds.count("A") / n, kinds.count("a") / n, kinds.count("-") / n,
            float(-(counts * np.log2(counts)).sum()), len(counts) / n,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / n,  # noqa: B905
            float(self.transitions[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
            covered / n, float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))),
            float(assigned is not None), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
            float(bool(_CREDENTIAL.search((assigned[1] if assigned else "") + " " + " ".join(near)))),
            sum(self.odds.get(w.lower(), 0.0) for w in near) / max(1, len(near)),
            self.path_odds.get(path or "", 0.0),
            float(bool(_ADDRESS.search(before)) and after[:1] == "@"), float(bool(assigned and _PASSWORD.search(assigned[1]))),
        ]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Mean of the trees' leaf shares."""
        total = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for feature, limit, left, right, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                f = np.maximum(feature[at], 0)
                step = np.where(rows[everyone, f] <= limit[at], left[at], right[at])
                at = np.where(inner, step, at)
            total += share[at]
        return total / max(1, len(self.trees))


def findings(docs: DataFrame, text: str = "text", path: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, path, value, before, after) for every candidate, with the text beside it."""

    def run(batches: Iterator) -> Iterator:
        for b in portions(batches):
            out = [
                (i, p, t[s:e], t[max(0, s - CONTEXT) : s], t[e : e + CONTEXT])
                for i, t, p in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
                for s, e in candidates(t)
            ]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "path", "value", "before", "after"])

    ship(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(path).cast("string").alias("path"))
    schema = T.StructType([slim.schema["doc_id"], *[T.StructField(c, T.StringType()) for c in ("path", "value", "before", "after")]])
    return slim.mapInArrow(run, schema)


def presumed(value: str, before: str) -> int:
    """The label of a natural finding: 1 if a credential's name is assigned a mixed value of 16 or more characters, a
    password's name one of 6 or more, or if the value has the shape of a key that a provider marks."""
    if _SHAPED.fullmatch(value):
        return 1
    named = _ASSIGNED.search(before)
    mixed = len(value) >= (6 if named and _PASSWORD.search(named[1]) else 16) and bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value))
    return int(bool(named and mixed and _CREDENTIAL.search(named[1])))


def planted(rng: np.random.Generator, words: list[str], paths: list[str | None], n: int) -> list[Row]:
    """Labelled findings with known answers: random keys of usual shapes and passwords as secrets; numbers, dates,
    versions, joined words, file names, and words and placeholders after a credential's name as false positives; each
    between words of the corpus."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    some = lambda k: " ".join(rng.choice(words, k)) if words else "x"
    names = ["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "TOKEN", "Secret"]
    neutral = ["ref", "page", "order", "file", "name", "version", "phone", "card", "date", "id"]
    out = []
    signs = "!@#$%&*?.^~"
    word = lambda: str(rng.choice(words)) if words else "horse"

    def password() -> str:
        kind = int(rng.integers(4))
        base = word().capitalize() if rng.random() < 0.5 else word()
        spelled = "".join({"a": "4", "e": "3", "o": "0", "i": "1", "s": "5"}.get(c, c) if rng.random() < 0.6 else c for c in base)
        value = [
            lambda: base + str(rng.integers(10, 10_000)),
            lambda: spelled + pick(signs, 1) + str(rng.integers(100)),
            lambda: pick(alnum + signs, int(rng.integers(8, 20))),
            lambda: base + pick(signs, 1) + word() + str(rng.integers(100)),
        ][kind]()
        return value if len(value) >= 6 and re.search(r"\d", value) else value + pick("0123456789", 4)

    def harmless() -> str:
        value = [
            word, lambda: word() + word(), lambda: "${" + word().upper() + "}", lambda: "*" * int(rng.integers(6, 12)), lambda: f"{word()}.{word()}()",
            lambda: f"{word()}-{word()}",
        ][int(rng.integers(6))]()
        return value if len(value) >= 6 else value + "_" + word() + "_value"

    for k in range(n):
        if rng.random() < 0.25:  # what only a name or an address makes a candidate
            quote = str(rng.choice(["", "", '"', "'"]))
            name = str(rng.choice(["password", "passwd", "pwd", "db_password", "secret", "Password", "PASSWORD"]))
            head = f"{name}{rng.choice(['=', ': ', ' = ', ':'])}{quote}"
            value, tail = (password() if k % 2 else harmless()), quote
            if k % 2 and rng.random() < 0.3:
                head, tail = f"{rng.choice(['https', 'ftp', 'mysql', 'amqp', 'redis'])}://{word()}:", f"@{word()}.example/{word()}"
                value = password().replace("@", "!")
            elif not k % 2 and rng.random() < 0.5:
                head = f"{rng.choice(['key', 'token', 'Schlüssel-Key', 'auth', 'author', 'keyword'])}{rng.choice(['=', ': ', ' = '])}{quote}"
            path = paths[int(rng.integers(len(paths)))] if paths else None
            out.append(Row(path=path, value=value, before=(some(4) + " " + head)[-CONTEXT:], after=tail + " " + some(3), label=k % 2))
            continue
        if k % 2:
            shape = int(rng.integers(5))
            value = [
                lambda: pick("0123456789abcdef", int(rng.choice([32, 40, 64]))),
                lambda: pick(alnum, int(rng.integers(20, 64))),
                lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
                lambda: str(rng.choice(["ghp_", "sk_live_", "xoxb-"])) + pick(alnum, 36),
                lambda: pick(alnum + "+/", int(rng.integers(6, 16)) * 4) + str(rng.choice(["", "=", "=="])),
            ][shape]()
            value += "7" if not re.search(r"\d", value) else ""
            name = str(rng.choice(names))
            bare = [""] * (12 if shape in (2, 3) else 0)  # keys that a provider marks stand anywhere
            before = some(4) + " " + str(rng.choice([*bare, f'{name} = "', f"{name}: ", f"{name}='", f'"{name}": "', f"{name}=", f"{name} "]))
        else:
            shape = int(rng.integers(6))
            value = [
                lambda: pick("0123456789", int(rng.integers(12, 20))),
                lambda: f"20{rng.integers(10, 30)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(24):02d}",
                lambda: "_".join(rng.choice(words, 3)) + str(rng.integers(10)) if words else "abcdefghijk1",
                lambda: "/".join(rng.choice(words, 3)) + f"/v{rng.integers(9)}" if words else "abc/def/ghi/1",
                lambda: "".join(rng.choice(words, 3)) + str(rng.integers(100)) if words else "abcdefghijk12",
                lambda: f"{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}",
            ][shape]()
            name = str(rng.choice(neutral + names[:1]))
            before = some(4) + " " + str(rng.choice(["", "", f"{name} = ", f"{name}: ", f'{name} = "']))
        after = ('"' if before.endswith('"') else "'" if before.endswith("'") else "") + " " + some(3)
        path = paths[int(rng.integers(len(paths)))] if paths else None
        out.append(Row(path=path, value=value, before=before[-CONTEXT:], after=after, label=k % 2))
    return out


def _odds(pairs: list[tuple[str, int]]) -> dict[str, float]:
    """Smoothed log odds of each word with 5 or more findings."""
    seen: dict[str, list[int]] = {}
    for w, y in pairs:
        seen.setdefault(w, [0, 0])[y] += 1
    return {w: float(np.log((b + 1) / (a + 1))) for w, (a, b) in seen.items() if a + b >= 5}


def fit(spark: SparkSession, labelled: list[Row], words: Counter, max_findings: int = MAX_FINDINGS, transitions: Counter | None = None) -> Model:
    """Train from labelled findings (path, value, before, after, label) and the counts of ordinary words, both bounded.
    ``transitions`` counts pairs of letters; without it they are those of the words.

    At most ``max_findings`` are used. The neighbours' and paths' odds are worked out on the other half of the
    findings than the one that the forest sees with them, so that they do not give the label away.
    """
    order = np.random.default_rng(13).permutation(len(labelled))  # halves that know nothing of the rows' order
    labelled = [labelled[k] for k in order[:max_findings]]
    top = [w for w, n in words.most_common(MAX_DICTIONARY) if 3 <= len(w) <= 14]
    pairs = np.ones((256, 256))
    for pair, n in (transitions or {}).items():
        pairs[tuple(pair.encode())] += n
    for w in top if transitions is None else []:
        codes = np.frombuffer(w.encode(), np.uint8)
        np.add.at(pairs, (codes[:-1], codes[1:]), min(words[w], 100))
    model = Model(set(top), np.log(pairs / pairs.sum(axis=1, keepdims=True)), {}, {}, [])

    def learn(rows: list[Row]) -> tuple[dict, dict]:
        return (
            _odds([(w.lower(), r.label) for r in rows for w in _WORD.findall(r.before)[-3:]]),
            _odds([(r.path or "", r.label) for r in rows]),
        )

    table = []
    for own, other in ((labelled[::2], labelled[1::2]), (labelled[1::2], labelled[::2])):
        model.odds, model.path_odds = learn(other)
        table += [Row(label=float(r.label), features=Vectors.dense(model.features(r.value, r.before, r.after, r.path))) for r in own]
    model.odds, model.path_odds = learn(labelled)
    if len({r.label for r in table}) == 2:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt", maxBins=64)
        model.trees = [_flat(t) for t in forest.fit(spark.createDataFrame(table).coalesce(1)).trees]
    return model


def _flat(tree) -> tuple:
    """A trained tree as arrays: feature (-1 in leaves), threshold, left, right, share of label 1."""
    nodes: list[tuple] = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.getClass().getSimpleName() == "LeafNode":
            zero, one = node.impurityStats().stats()
            nodes[at] = (-1, 0.0, at, at, one / max(zero + one, 1e-12))
        else:
            split = node.split()
            feature, limit = split.featureIndex(), split.threshold()
            left = walk(node.leftChild())
            right = walk(node.rightChild())
            nodes[at] = (feature, limit, left, right, 0.0)
        return at

    walk(tree._call_java("rootNode"))
    return tuple(np.array(c) for c in zip(*nodes, strict=True))


def fit_on(docs: DataFrame, text: str = "text", path: str = "source", doc_id: str = "doc_id", max_documents: int = MAX_DOCUMENTS) -> Model:
    """A model for a corpus without a table of labelled findings.

    The labelled findings are the candidates of the ``max_documents`` documents whose ids have the smallest hashes,
    labelled by ``presumed``, and as many again (2,000 at least) that are planted with known answers. Words and pairs
    of letters are counted over all documents.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null")
    ids = first_rows(known, max_documents, F.xxhash64("doc_id"), F.col("doc_id")).distinct()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    sample = slim.join(F.broadcast(ids), "doc_id", "left_semi")
    fields = ["value", "before", "after", "path"]
    order = F.xxhash64(*fields)
    found = findings(sample, "text", "path", "doc_id").select(*fields).distinct()
    drawn = first_rows(found, MAX_FINDINGS // 2, order, *map(F.col, fields)).withColumn("order", order).collect()
    natural = [
        Row(path=r.path, value=r.value, before=r.before, after=r.after, label=presumed(r.value, r.before))
        for r in sorted(drawn, key=lambda r: (r["order"], *[(r[f] is not None, r[f]) for f in fields]))
    ]

    def count(batches: Iterator) -> Iterator:
        for b in batches:
            c: Counter = Counter()
            for part in portions([b]):
                for t in part.column(0).to_pylist():
                    c.update(w for w in re.findall(r"[a-z]{3,14}", (t or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["w", "n"])

    counted = kept(slim.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1"))
    rows = sorted(first_rows(counted, MAX_DICTIONARY, F.desc("n"), F.col("w")).collect(), key=lambda r: (-r["n"], r["w"].encode()))
    words = Counter({r["w"]: r["n"] for r in rows})
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("at")
    pairs = counted.select("w", "n", at).groupBy(F.expr("substring(w, at, 2)").alias("pair")).agg(F.sum("n").alias("n")).collect()
    rng = np.random.default_rng(11)
    extra = planted(rng, list(words)[:5000], [r.path for r in natural] or [None], min(MAX_FINDINGS // 2, max(2000, len(natural))))
    return fit(spark, natural + extra, words, transitions=Counter({r["pair"]: r["n"] for r in pairs}))


def scan(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    path: str = "source",
    threshold: float = THRESHOLD,
    names: tuple[str, str, str, str] = ("n_candidates", "secrets", "top_score", "redacted"),
) -> DataFrame:
    """``docs`` with the number of candidates, the secrets as (start, end, score) by code points, the highest score of
    any candidate (0 without one) and the text with every secret replaced by ``[SECRET]``.

    Null and empty texts have no candidate; a null text stays null. Rows are scored one by one, so copies come out
    alike, and a row's result does not depend on any other row.
    """
    at, place = docs.columns.index(text), docs.columns.index(path)
    ship(docs.sparkSession)
    everywhere = docs.sparkSession.sparkContext.broadcast(model)
    item = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    kinds = (T.LongType(), item, T.DoubleType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    arrow = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])), pa.float64(), pa.string())

    def run(batches: Iterator) -> Iterator:
        m = everywhere.value
        for b in portions(batches):
            texts, paths = b.column(at).to_pylist(), b.column(place).to_pylist()
            spans = [candidates(t) for t in texts]
            rows = [
                m.features(t[s:e], t[max(0, s - CONTEXT) : s], t[e : e + CONTEXT], None if p is None else str(p))
                for t, p, own in zip(texts, paths, spans, strict=True)
                for s, e in own
            ]
            chance = m.probability(np.array(rows)) if rows else np.empty(0)
            found, top, masked, k = [], [], [], 0
            for t, own in zip(texts, spans, strict=True):
                scores = chance[k : k + len(own)]
                k += len(own)
                hits = [(s, e, float(c)) for (s, e), c in zip(own, scores, strict=True) if c >= threshold]
                found.append([{"start": s, "end": e, "score": c} for s, e, c in hits])
                top.append(float(scores.max()) if len(own) else 0.0)
                cuts = [0, *[x for s, e, _ in hits for x in (s, e)], len(t or "")]
                masked.append(MASK.join(t[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)) if hits else t)
            more = [[len(s) for s in spans], found, top, masked]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, k) for x, k in zip(more, arrow, strict=True)]], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
