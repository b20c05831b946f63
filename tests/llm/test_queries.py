"""The registered queries and the pipeline over the driver's smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from siftwork.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.execute(queries.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        plain = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
        assert plain(got) == plain(want)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = None
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.cut(stage(spark, docs, sf_dir), "test")
        if n < 4:
            assert after.columns == names
        if n == 0:
            assert after.count() < docs.count()
        if n == 1:
            kept = {r.doc_id for r in after.select("doc_id").collect()}
            assert len(kept) == after.count()
        if n == 2:
            assert {r.doc_id for r in after.select("doc_id").collect()} == kept
            assert after.where("length(text) <> n_chars").count() == 0
        if n == 3:
            assert {r.doc_id for r in after.select("doc_id").collect()} <= kept
        docs = after
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    mixed = after.count()
    assert mixed == corpus_pipeline.run(spark, sf_dir).count()
