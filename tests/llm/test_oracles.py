"""The numbered queries against their SQL, and the pipeline against its stages."""

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm.oracle import oracle_sql
from sparkloom.llm.queries import queries
from tests.compare import connect, same_rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, name):
    same_rows(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name])


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    base = queries()["op8_quality"](spark, sf_dir).where("not base_failed")
    clean = good.join(base, "doc_id", "left_semi")
    assert clean.join(kept, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.STAGES[1][1](spark, clean, sf_dir).count() == clean.count()


def test_pipeline_tokens_are_those_of_the_mix(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.select("doc_id", "n_tokens").collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)
    ids = {r["doc_id"] for r in rows}
    near = queries()["op5_near"](spark, sf_dir).where("kept").select("doc_id").collect()
    assert len(ids) <= len(near) and duckdb.__version__
