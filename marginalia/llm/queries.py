"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import alignment, ann, licenses, lines, minhash, outliers, packing, phrases, pieces, secrets, shards, simhash, toxicity

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a forest trained on its candidates."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs, secrets.fit_on(docs))
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "top_score",
        F.transform("secrets", lambda s: s["start"]).alias("starts"), F.transform("secrets", lambda s: s["end"]).alias("ends"),
        F.crc32(F.col("redacted").cast("binary")).alias("redacted_crc32"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by its nearest labelled examples."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence"
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and identifiers of every document."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    return shards.shard(_read(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    return outliers.judged(_read(spark, sf_dir, "documents")).drop("distance")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return pieces.digests(_read(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more sources have."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = lines.remove_spread_lines(docs, counts=("n_lines", "n_removed"))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in token sequences of at most 2048."""
    return packing.pack(_read(spark, sf_dir, "documents"), WORD_TOKENIZER, with_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between two tokenizers."""
    return alignment.aligned(_read(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL, public_tokenizers.PATTERN)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by Jaccard 0.85 of three-word shingles."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_toxicity, op3_licenses, op4_shards, op5_nearest, op6_outliers, op7_pieces, op8_lines, op9_packing, op10_simhash,
        op11_phrases, op12_alignment, op13_minhash,
    )
}

ORACLES = {
    "op8_lines": """
with lined as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null
), bare as (
  select *, trim(line, ' ' || chr(9) || chr(13)) as b from lined
), spread as (
  select b, min(doc_id) as owner from bare where b <> '' group by b having count(distinct source) >= 10
), marked as (
  select bare.doc_id, bare.line, bare.pos, spread.b is not null and spread.owner is distinct from bare.doc_id as goes
  from bare left join spread on bare.b = spread.b
), cleaned as (
  select doc_id, count(*) filter (where goes) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not goes), '') as text
  from marked group by doc_id
)
select d.doc_id,
       case when coalesce(d.text, '') = '' then 0 else len(string_split(d.text, chr(10))) end::bigint as n_lines,
       coalesce(c.n_removed, 0)::bigint as n_removed,
       length(c.text)::bigint as n_chars,
       md5(c.text) as text_md5
from documents d left join cleaned c using (doc_id)
""",
    "op11_phrases": """
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), lists as (
  select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws from pieces
), words as (
  select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists
), spots as (
  select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3 from words
), one as (
  select lang, w1, count(*) as f from spots group by all
), two as (
  select lang, w1, w2, count(*) as f from spots where w2 is not null group by all
), three as (
  select lang, w1, w2, w3, count(*) as f from spots where w3 is not null group by all having count(*) >= 10
), sizes as (
  select lang, sum(f)::bigint as n from one group by lang
), cuts as (
  select t.lang, t.w1, t.w2, null as w3, t.f as a, 1 as k, l.f as l, r.f as r
  from two t join one l on l.lang = t.lang and l.w1 = t.w1 join one r on r.lang = t.lang and r.w1 = t.w2 where t.f >= 10
  union all
  select t.lang, t.w1, t.w2, t.w3, t.f, 1, l.f, r.f
  from three t join one l on l.lang = t.lang and l.w1 = t.w1 join two r on r.lang = t.lang and r.w1 = t.w2 and r.w2 = t.w3
  union all
  select t.lang, t.w1, t.w2, t.w3, t.f, 2, l.f, r.f
  from three t join two l on l.lang = t.lang and l.w1 = t.w1 and l.w2 = t.w2 join one r on r.lang = t.lang and r.w1 = t.w3
), scored as (
  select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts
), weakest as (
  select * from scored qualify row_number() over (partition by lang, w1, w2, w3 order by score, k) = 1
), inside as (
  select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from three union all select lang, w2, w3, f from three) group by all
), kept as (
  select c.* from weakest c left join inside x on x.lang = c.lang and x.w1 = c.w1 and x.w2 = c.w2
  where c.w3 is not null or x.f is null or 100 * x.f < 50 * c.a
), named as (
  select k.lang, concat_ws(' ', w1, w2, w3) as phrase, a, l, r, n, score from kept k join sizes s on s.lang = k.lang
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from named qualify rank <= 2000
""",
}
