from quire.llm.secrets import labelled_samples


def test_sampled_documents_are_taken_whole(spark):
    docs = spark.createDataFrame([(1, "word " * 300 + "lastword end"), (2, "")], "doc_id long, text string")
    tokens = {r["token"] for r in labelled_samples(docs).filter("NOT secret").collect()}
    assert {"lastword", "lastword_end_8"} <= tokens
