import __spark_entry__ as entry
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

OPERATORS = ["op1_secrets", "op2_toxicity", "op3_licenses", "op4_shards", "op5_nearest", "op6_outliers", "op7_pieces", "op8_lines", "op9_packing", "op10_simhash"]


def test_registered():
    assert set(OPERATORS) | {"pipeline"} <= set(entry.queries())
    assert "op8_lines" in entry.oracle_sql()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "secrets", "packing"]


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "op5_nearest"])
def test_a_row_for_every_document(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = entry.queries()[name](spark, sf_dir)
    assert rows.select("doc_id").distinct().count() == docs.count()
    if name != "op9_packing":
        assert rows.count() == docs.count()


def test_op8_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(f"select doc_id, n_lines, n_removed, n_chars, text_md5 from ({entry.oracle_sql()['op8_lines']}) order by 1").fetchall()
    got = entry.queries()["op8_lines"](spark, sf_dir).select("doc_id", "n_lines", "n_removed", "n_chars", "text_md5").orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == want


def test_stages_hand_on_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("clash"))
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names, name
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("text rlike '(?i)token = .[0-9a-f]{40}'").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == before


def test_stages_on_awkward_and_empty_tables(spark, sf_dir, awkward, nothing):
    for table in (awkward, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == table.columns
        pieces = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
        assert (pieces.count() == 0) == (docs.count() == 0)


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    longest = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < longest <= 2048
