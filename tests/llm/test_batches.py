"""How many rows the pipeline's stages hand to Python at once."""

import corpus_pipeline
import pandas as pd
import pytest

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
DOCS = ["id AS doc_id", "repeat(concat('word', id % 7, ' and more words '), 4) AS text", "'en' AS lang"]


@pytest.mark.parametrize("given, most", [("10000", 1000), ("0", 1000), ("300", 300)])
def test_stages_hand_texts_to_python_in_small_batches(spark, given, most):
    before = spark.conf.get(BATCH)
    docs = spark.range(0, 2500, 1, 1).selectExpr(*DOCS)
    try:
        spark.conf.set(BATCH, given)
        corpus_pipeline.small_batches(spark)
        sizes = docs.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").toPandas()["n"]
        assert sizes.sum() == 2500 and sizes.max() == most
    finally:
        spark.conf.set(BATCH, before)


def test_a_stage_sets_it(spark):
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "10000")
        corpus_pipeline.quality_rules(spark, spark.range(0, 20, 1, 1).selectExpr(*DOCS), "")
        assert spark.conf.get(BATCH) == "1000"
    finally:
        spark.conf.set(BATCH, before)
