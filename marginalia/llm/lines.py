"""Boilerplate lines: those that occur at many distinct sites.

A HyperLogLog sketch of the sites of each line is built in every task and merged by aggregation, so a line that
every page has costs one small sketch per task. Lines whose sketch comes out near the threshold are settled by
exact distinct counts; the others are so far from it that the sketch decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, hash_pair, kept

MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold (and within 2 sites) are counted exactly. A sketch of 2^12 registers
#: has a standard error of 1.6 %, so the margin is over 15 standard errors.
MARGIN = 0.25
#: Tables of at most so many line hashes (24 bytes each) are broadcast; larger ones are joined by shuffling.
BROADCAST_LINES = 100_000
#: The same for the removed lines' positions by text (under 100 bytes each, with the key of their text).
BROADCAST_POSITIONS = 200_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    """A line without the blanks, tabs and carriage returns around it."""
    return F.btrim(line, F.lit(" \t\r"))


def _small(lines: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted size is within the bound."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def spread_lines(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    doc_id: str = "doc_id",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    long_words: int | None = None,
) -> DataFrame:
    """(h1, h2, owner): the lines found at ``min_sites`` or more distinct sites, as two hashes each. ``owner`` is
    the smallest id of a document with that line. Blank lines are no lines; a null site is no site.

    With ``long_words``, lines of more words than that are there from two sites on if two different texts have them,
    and ``owner_text`` is a hash of the owner's text (null for other lines)."""
    lines = (
        docs.select(
            F.col(site).cast("string").alias("site"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.explode(_lines(F.col(text))).alias("line")
        )
        .select("site", "id", "t", _bare(F.col("line")).alias("line"))
        .where("line <> ''")
    )
    if long_words is not None:
        long = F.size(F.filter(F.split("line", "[ \t\r]+"), lambda w: w != "")) > long_words
        passages = (
            lines.where(long)
            .select(*hash_pair(F.col("line")), "site", "id", "t")
            .groupBy("h1", "h2")
            .agg(F.min("site").alias("s0"), F.max("site").alias("s1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "t"))).alias("first"))
            .where("s0 < s1 and t0 <> t1")
            .select("h1", "h2", F.col("first.id").alias("owner"), F.col("first.t").alias("owner_text"))
        )
        lines = lines.where(~long)
    rows = lines.select(*hash_pair(F.col("line")), "site", "id")
    sketched = rows.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min("id").alias("owner")
    )
    margin = max(2, MARGIN * min_sites)
    sketched = kept(sketched.where(F.col("sites") >= min_sites - margin))
    sure = sketched.where(F.col("sites") > min_sites + margin).select("h1", "h2", "owner")
    near = sketched.where(F.col("sites") <= min_sites + margin).select("h1", "h2", "owner")
    # Sites of a line are distinct before they are counted, so no line's rows meet in one task.
    exact = (
        rows.select("h1", "h2", "site")
        .join(_small(near), ["h1", "h2"])
        .groupBy("h1", "h2", "owner", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", "owner")
        .agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    found = sure.unionAll(exact.select("h1", "h2", "owner"))
    if long_words is not None:
        found = found.withColumn("owner_text", F.lit(None).cast("long")).unionAll(passages)
    return kept(found)


def remove_spread_lines(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    doc_id: str = "doc_id",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    counts: tuple[str, str] | None = None,
    long_words: int | None = None,
) -> DataFrame:
    """``docs`` without the lines that ``min_sites`` or more distinct sites have.

    Each such line stays in the document with the smallest id that has it, so nothing is lost to the corpus; a line
    that only documents without an id have goes everywhere. Lines are compared without the blanks, tabs and
    carriage returns around them; blank lines stay. No row goes: a text may become empty. Null texts stay null.
    Rows with the same text and id come out alike. ``counts`` names two columns to add: the lines of a text (0 for
    null and empty texts) and how many went.

    With ``long_words``, lines of more words than that (separated by blanks, tabs and carriage returns) go from two
    sites on if different texts have them. They stay in every copy of their owner's text, so that copies of a whole
    text stay copies.
    """
    found = _small(spread_lines(docs, text, site, doc_id, min_sites, lg_k, long_words))
    found = found if long_words is not None else found.withColumn("owner_text", F.lit(None).cast("long"))
    k1, k2, gone, lines, stay, own = (fresh(docs, n) for n in ("k1", "k2", "gone", "lines", "stay", "owner"))
    # the first hash of the pair is that of owner_text
    key = [c.alias(n) for c, n in zip(hash_pair(F.col(text)), (k1, k2), strict=True)]
    hits = kept(
        docs.where(F.col(text).isNotNull())
        .select(*key, F.posexplode(_lines(F.col(text))).alias("at", "line"))
        .select(k1, k2, "at", _bare(F.col("line")).alias("line"))
        .where("line <> ''")
        .select(k1, k2, "at", *hash_pair(F.col("line")))
        .join(found, ["h1", "h2"])
        .where(F.col("owner_text").isNull() | (F.col("owner_text") != F.col(k1)))
        .select(k1, k2, "at", "owner")
        .distinct()  # equal texts have equal lines: copies are put together before they meet
        .groupBy(k1, k2)
        .agg(F.collect_list(F.struct("at", "owner")).alias(gone))
    )
    positions = hits.agg(F.sum(F.size(gone))).first()[0] or 0
    # beyond the bound both sides are shuffled by text, and Spark may split the copies of a text
    hits = F.broadcast(hits) if positions <= BROADCAST_POSITIONS else hits
    joined = docs.select("*", *key).join(hits, [k1, k2], "left")
    mine = F.filter(F.col(gone), lambda x: ~F.coalesce(x["owner"] == F.col(doc_id), F.lit(False)))
    joined = joined.withColumn(own, F.transform(mine, lambda x: x["at"])).withColumn(
        lines, F.when(F.size(own) > 0, _lines(F.col(text)))
    )
    # what stays: all positions but those, by one hash set for each text
    joined = joined.withColumn(
        stay,
        F.when(F.size(own) > 0, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own))),
    )
    # the length of a split of the whole text is wanted for all texts, the split itself for few
    total = F.when(F.length(text) > 0, F.length(text) - F.length(F.translate(F.col(text), "\n", "")) + 1).otherwise(0)
    added = [] if counts is None else [
        F.coalesce(total, F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.when(F.size(own) > 0, F.size(own)), F.lit(0)).cast("long").alias(counts[1]),
    ]
    cleaned = F.when(
        F.size(own) > 0, F.array_join(F.transform(F.col(stay), lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    ).otherwise(F.col(text))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *added)
