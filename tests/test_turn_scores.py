from quire.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_turn_meets_the_next(spark):
    turns = sorted((r["conv_id"], r["turn"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    want = [a for a, b in zip(turns, turns[1:]) if a[0] == b[0]]
    got = sorted((r["conv_id"], r["turn"]) for r in catalog.queries()["turn_scores"](spark, SF).collect())
    assert got == want and max(t for _, t in want) > 1
