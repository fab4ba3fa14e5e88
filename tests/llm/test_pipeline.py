"""The pipeline's stages on the smallest tables, and the registered SQL."""

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from quadloom.llm import queries


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "bpe"]
    seen = {r.doc_id: r.text for r in docs.collect()}
    now, ids = docs, set(seen)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        left = {r.doc_id for r in now.select("doc_id").collect()}
        assert left <= ids and (name == "pii") <= (left == ids)
        ids = left
    changed = [r for r in now.collect() if r.text != seen[r.doc_id]]
    assert changed and all(r.n_chars == len(r.text) for r in changed)
    last = corpus_pipeline.STAGES[-1][1](spark, now, data)
    assert last.count() == len(ids) and last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_toxic_documents_go(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, data).count()
    assert 0.7 * docs.count() < kept <= docs.count()


def test_topk_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = con.sql(queries.SQL["op8_topk"]).fetchall()
    got = [tuple(r) for r in queries.op8_topk(spark, data).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)
