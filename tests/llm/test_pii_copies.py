from quire.llm.pii import scan


def test_copies_do_not_hide_a_term(spark):
    texts = [f"line {i} Zebedee writes from zed@corp.example about thing{'abc'[i]} today" for i in range(3)] * 10
    texts += ["people write from home about plain matters", "home is where people write today"]
    spans = {r["doc_id"]: r["spans"].split(",") for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all("term:7:14" in spans[i] for i in range(30))
