"""Occurrences in texts that are too large for a row: a text is many rows, its chunks, and several tasks scan it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.chunks import PLAIN, Lexer
from marginalia.functions.text import count_newlines
from marginalia.operators.files import wanted
from marginalia.plans.workspace import kept, ship
from marginalia.rules import CommentRules, JobConfig, root_path
from marginalia.sources.listing import file_system, listed, local

#: Characters (of a text) or bytes (of a file) in a chunk, about.
CHUNK = 1 << 20
_CHUNKS = "path string, seq long, text string"
#: Rows and characters that tasks hand on at once, about.
_ROWS_AT_ONCE, _CHARS_AT_ONCE = 1 << 13, 1 << 22


def _batches(rows: Iterator[tuple], names: list[str], kinds: list, text: int | None = None) -> Iterator:
    """Rows as Arrow batches; ``text``: the column that makes rows long. A batch for each row would cost far more than its work."""
    import pyarrow as pa

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 0 if text is None else len(row[text])
        if len(held) >= _ROWS_AT_ONCE or chars >= _CHARS_AT_ONCE:
            yield batch(held)
            held, chars = [], 0
    if held:
        yield batch(held)


def cut_texts(sources: DataFrame, rules: CommentRules, size: int = CHUNK) -> DataFrame:
    """Chunks (path, seq, text) of ``sources`` (path, text), of ``size`` characters and the few up to where a cut may stand.

    Paths are unique. A text of nothing but characters of tags is one chunk. A null text has none, and rows without a path
    are left out.
    """
    ship(sources.sparkSession)
    tight = Lexer(rules).tight

    def pieces(batches: Iterator) -> Iterator[tuple]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                begin, seq = 0, 0
                while begin < len(text) or not seq:
                    end = min(begin + size, len(text))
                    while end < len(text) and text[end - 1] in tight:
                        end += 1
                    yield path, seq, text[begin:end]
                    begin, seq = end, seq + 1

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from _batches(pieces(batches), ["path", "seq", "text"], [pa.string(), pa.int64(), pa.string()], 2)

    return sources.where("path is not null").select("path", "text").mapInArrow(cut, _CHUNKS)


def read_chunks(spark: SparkSession, root: str, config: JobConfig, size: int = CHUNK) -> DataFrame:
    """Chunks (path, seq, text) of the files under ``root`` that pass the rules of ``config``, read by ranges of ``size``
    bytes: no task holds a whole file. Bytes that are not UTF-8 become U+FFFD.

    A range ends behind the first byte from its nominal end on that is ASCII and in no tag, which its neighbour finds
    as well; a file without such bytes is one chunk.
    """
    tight = frozenset(c.encode()[0] for c in Lexer(config.comments).tight if ord(c) < 128)
    base, open_fs, ahead = local(root), file_system, 1 << 12
    path = F.when(F.col("rel_path") == "", F.lit(root_path(root))).otherwise(F.concat(F.lit(root_path(root) + "/"), "rel_path"))
    files = listed(spark, root).select("place", path.alias("path"), "length").where(wanted(F.col("path"), config))
    last = F.greatest(F.ceil(F.col("length") / F.lit(size)).cast("long") - 1, F.lit(0))
    ranges = files.select("place", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, _ = open_fs(base)

        def edge(f, at: int, length: int) -> int:
            """Where the range that nominally ends at ``at`` ends."""
            while 0 < at < length:
                f.seek(at - 1)
                some = f.read(ahead)
                for k, c in enumerate(some):
                    if c < 128 and c not in tight:
                        return at + k
                at += len(some)
                if not some:
                    break
            return min(at, length)

        for b in batches:
            for place, name, length, seq in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                with system.open_input_file(place) as f:
                    begin, end = edge(f, seq * size, length), edge(f, (seq + 1) * size, length)
                    f.seek(begin)
                    text = f.read(max(0, end - begin)).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([seq], pa.int64()), pa.array([text], pa.string())], names=["path", "seq", "text"])

    spread = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "seq")
    return spread.mapInArrow(read, _CHUNKS)


def _begins(batches: Iterator, lexer: Lexer) -> Iterator[tuple]:
    """What is known of each chunk of a file once all of them are: where it begins, in which state, and whether what is
    open at its end stays open.

    The rows (path, seq, step, chars, lines) come by path and seq. Of the file at hand a few numbers a chunk are held.
    """

    def settled(path: str, chunks: list[tuple], state: int) -> Iterator[tuple]:
        open_, stays = lexer.closes(state), []
        for _, own, left, _, _ in reversed(chunks):
            stays.append(open_)
            open_ = open_ and not left and lexer.closes(own)
        for (seq, own, _, chars, lines), open_is_plain in zip(chunks, reversed(stays), strict=True):
            yield path, seq, own, open_is_plain, chars, lines

    chunks, file, state, before, lines_before = [], None, PLAIN, 0, 0
    for b in batches:
        for path, seq, step, chars, lines in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            if path != file:
                yield from settled(file, chunks, state)
                chunks, file, state, before, lines_before = [], path, PLAIN, 0, 0
            chunks.append((seq, state, bool(step[state] % 2), before, lines_before))
            state, before, lines_before = step[state] // 2, before + chars, lines_before + lines
    yield from settled(file, chunks, state)


def find_occurrences(chunks: DataFrame, rules: CommentRules) -> DataFrame:
    """One row per occurrence: path, pos, lines, comment_text, as ``files.find_occurrences`` has them for whole texts, but
    with places as longs.

    Chunks are looked at twice, each by itself. In between only numbers are shuffled, a few for each chunk, and one
    file's are put in order by one task, file after file (some 200 bytes for each chunk, so 20 MB for a file of 100 GB).
    Occurrences that meet a cut are put together from their parts, two for each chunk at most.
    """
    ship(chunks.sparkSession)
    chunks = kept(chunks)

    def steps(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lexer = Lexer(rules)
        for b in batches:
            texts = b.column(2).to_pylist()
            cols = [pa.array([lexer.transition(t) for t in texts], pa.list_(pa.int32())), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["path", "seq", "step", "chars", "lines"])

    stepped = chunks.mapInArrow(steps, "path string, seq long, step array<int>, chars long, lines long")

    def begun(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["path", "seq", "state", "open_is_plain", "chars_before", "lines_before"]
        yield from _batches(_begins(batches, Lexer(rules)), names, [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()])

    begins = stepped.repartition("path").sortWithinPartitions("path", "seq").mapInArrow(
        begun, "path string, seq long, state int, open_is_plain boolean, chars_before long, lines_before long"
    )

    def parts_of(batches: Iterator) -> Iterator[tuple]:
        lexer = Lexer(rules)
        for b in batches:
            for path, text, state, open_is_plain, chars, lines in zip(*[b.column(c).to_pylist() for c in ("path", "text", "state", "open_is_plain", "chars_before", "lines_before")], strict=True):
                at, line = 0, lines + 1
                for p in lexer.parts(text, state, open_is_plain):
                    line += text.count("\n", at, p.first)
                    at = p.first
                    yield path, chars + p.first, line, p.text, p.comment, p.at_edge

    def located(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        yield from _batches(parts_of(batches), ["path", "first", "line", "text", "comment", "at_edge"], kinds, 3)

    # Spark's guess of the chunks' size can be far too low; to broadcast the texts would leave the scan to the numbers' few tasks
    parts = kept(chunks.hint("merge").join(begins, ["path", "seq"]).mapInArrow(located, "path string, first long, line long, text string, comment boolean, at_edge boolean"))
    whole = parts.where("comment and not at_edge").select("path", "first", "line", "text")
    # parts that touch without anything between them hang together, from the first comment to the last one
    in_order = W.partitionBy("path").orderBy("first")
    end = F.col("first") + F.length("text")
    touching = parts.where("at_edge").withColumn("new", F.coalesce((F.lag(end).over(in_order) < F.col("first")).cast("int"), F.lit(1)))
    numbered = touching.withColumn("run", F.sum("new").over(in_order))
    within = W.partitionBy("path", "run")
    place = F.when(F.col("comment"), F.col("first"))
    inner = numbered.withColumns({"low": F.min(place).over(within), "high": F.max(place).over(within)}).where("first between low and high")
    joined = inner.groupBy("path", "run").agg(
        F.min("first").alias("first"), F.min("line").alias("line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    found = whole.unionByName(joined.drop("run"))
    first, text = F.col("first"), F.col("text")
    inside = count_newlines(text) - F.endswith(text, F.lit("\n")).cast("int")
    return found.select(
        "path",
        F.struct(first.alias("first"), (first + F.length(text) - 1).alias("last")).alias("pos"),
        F.struct(F.col("line").alias("first"), (F.col("line") + inside).alias("last")).alias("lines"),
        text.alias("comment_text"),
    )
