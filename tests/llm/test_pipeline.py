"""The pipeline's stages take effect, keep clean documents and hand on the columns of documents."""

import importlib

import pytest

from strandline.llm.shared import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = " ".join(f"thing{k} ering onre heas" for k in range(40))
    planted = [(10_001, clean, "en", "src0", len(clean)), (10_002, clean, "en", "src1", len(clean)), (10_003, None, "en", "src1", None), (10_004, "12 34 56", "en", "src1", 8)]
    docs = stage(docs.unionByName(spark.createDataFrame(planted, docs.schema)), "planted")
    columns, seen = docs.columns, {}
    for name, step in pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert {10_003, 10_004}.isdisjoint(ids["language_id"]) and len(ids["language_id"]) == 202
    assert len({10_001, 10_002} & ids["jaccard_join"]) == 1
    sizes = {r["doc_id"]: r["n"] for r in seen["mixing"].groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert max(sizes.values()) == 2
    assert ids["packing"] == ids["mixing"]
