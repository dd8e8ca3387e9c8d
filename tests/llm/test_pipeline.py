import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetloom.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL
from .odd import documents, prose, texts


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "passages", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    df, r = QUERIES[name](spark, SMALL), c.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    at = [r.columns.index(x) for x in columns]
    assert sorted(tuple(row[x] for x in columns) for row in df.collect()) == sorted(tuple(row[k] for k in at) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_answer_for_every_row(spark, name):
    table = "pages" if name.startswith(("op2_", "op10_")) else "documents"
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    found = QUERIES[name](spark, SMALL).count()
    assert found >= n if name.startswith("op1_") else found == n


def test_stages_one_by_one(spark, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rejected = {r.doc_id for r in labels.where("quality = 0").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            assert len(kept & rejected) <= 0.1 * len(rejected)
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(kept & good) >= 0.98 * len(good)
        if name == "passages":
            assert out.count() == docs.count() and out.where("n_chars <> char_length(text)").count() == 0
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out


def test_stages_bear_odd_rows(spark, tmp_path):
    base = documents(spark, texts() + [(5000 + k, prose(60, k)) for k in range(30)])
    labels = spark.createDataFrame([(5000 + k, int(k % 3 > 0), 0) for k in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    base = base.withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        for k, docs in enumerate((base, base.limit(0))):
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            assert (out.count() == 0) == (k == 1)


def test_run_is_the_stages(spark):
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and whole.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
