import pytest
from pyspark.sql import functions as F

from quire.llm import quality_rules as rules


def judged(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = rules.quality_rules(docs, labels.filter("quality = 1").select("doc_id")).filter("NOT base_failed")
    found = rows.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    return {r["quality"]: r["share"] for r in found}


@pytest.mark.parametrize("sf, most", [("sf0.001", 0.4), ("sf0.01", 0.1), ("sf0.1", 0.01)])  # of 6, 28 and 301 labelled 0
def test_labels_are_told_apart_at_any_size(spark, sf, most):
    shares = judged(spark, sf)
    assert shares[1] > 0.999 and shares[0] < most, shares
