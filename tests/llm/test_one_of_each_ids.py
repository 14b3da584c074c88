from quire.llm.jaccard_join import one_of_each


def test_texts_that_share_an_id_stay(spark):
    a, b, c = "alpha beta gamma delta epsilon", "some other words stand here", "third text of its own words"
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (5, c), (5, c), (6, c), (5, "ALPHA beta gamma delta epsilon")], "doc_id long, text string")
    assert sorted(map(tuple, one_of_each(docs).collect())) == sorted([(2, a), (5, b), (5, c)])
