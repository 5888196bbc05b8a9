"""The pipeline's stages keep the columns, take effect, and survive odd and empty input."""

import corpus_pipeline
from tests.llm.test_operators import ODD, PASSAGE, SF
from tunedata.llm.tables import saved

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def through(spark, docs, sf_dir=SF):
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), "test-stage")
        counts.append(docs.count())
    return docs, counts


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, counts = through(spark, docs)
    assert out.columns == docs.columns
    assert counts[0] * 0.98 <= counts[1] and counts[1] == counts[2] and counts[3] < counts[2] and counts[4] == counts[3]
    assert counts[5] > 0


def test_stages_on_odd_rows(spark):
    rows = [(*r[:4], None, "x") for r in ODD]
    docs = spark.createDataFrame(rows, SCHEMA)
    out, counts = through(spark, docs)
    assert out.columns == docs.columns and counts[1] == 8
    assert all(PASSAGE not in r.text for r in out.where("doc_id = 5").collect())


def test_stages_on_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert through(spark, docs)[1] == [0] * 6
