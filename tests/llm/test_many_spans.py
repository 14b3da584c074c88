"""Texts with more spans than one run holds, against plain Python."""

from quire.llm._spans import RUN
from quire.llm.secrets import redacted, scan


def none_of(docs):
    return docs.selectExpr("text AS token", "true AS secret").limit(0)


def test_spans_of_several_runs(spark):
    sizes = [0, 1, RUN - 2, RUN - 1, RUN, RUN + 1, 3 * RUN + 7]
    docs = spark.createDataFrame([(n, "é password=abcdefgh1 " * n) for n in sizes], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in scan(docs, samples=none_of(docs)).collect()}
    assert spans == {n: ",".join(f"assign:{21 * i + 2}:{21 * i + 20}" for i in range(n)) for n in sizes}
    texts = {r["doc_id"]: r["text"] for r in redacted(docs, samples=none_of(docs)).collect()}
    assert texts == {n: "é [SECRET] " * n for n in sizes}
