"""Documents through the fold: once, and each by itself, wherever batches end."""

from pyspark.sql import functions as F

from quire.operators import article as assembly
from quire.plans import manuscripts

TEXT = "A Study of Things\nAbstract: we look.\n1 Methods\nSome text {0}.\n2 Results\nMore text {0}.\nReferences\n[1] Smith AB. Title {0}. Press. 2001.\n[2] Doe J. Other. Press. 2002."


def _articles(spark, folder, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return assembly.articles(manuscripts._documents_as_nodes(spark, str(folder)))


def test_the_fold_runs_once(spark, tmp_path):
    plan = _articles(spark, tmp_path, [TEXT.format(0)])._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(f"{name} ") for name in ("FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "MapInArrow", "MapInPandas")) == 1, plan


def test_documents_over_several_batches(spark, tmp_path):
    texts = [TEXT.format(i) if i % 3 else "one line" for i in range(450)]  # some without references, more than a task holds
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc_id"]: r for r in _articles(spark, tmp_path, texts).select("doc_id", "sections", "title", F.col("references.raw").alias("raw"), F.col("references.id").alias("ids")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 450
    for i in range(450):
        r = got[str(i)]
        paragraphs = [list(s["paragraphs"]) for s in r["sections"]]
        if i % 3:
            assert paragraphs == [[f"Some text {i}."], [f"More text {i}."]] and r["ids"] == ["ref1", "ref2"] and r["raw"][0] == f"Smith AB. Title {i}. Press. 2001."
        else:
            assert r["raw"] == [] and r["title"] == "one line"
