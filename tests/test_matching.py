from quire.functions import scores
from quire.operators import matching, ordered


def test_scores_of_the_reference(spark):
    rows = spark.createDataFrame([("1", "1", 1, "figure", "image"), ("2", "3", 1, "table", "image"), ("2", "3", 3, "table", "image"), ("", "", 5, "figure", "table"), ("2", "2", 0, "table", "image")], "n string, o string, d int, c string, k string")
    assert [r[0] for r in rows.select(scores.float_match(*(rows[x] for x in "nodck"))).collect()] == [100, 95, 80, 25, 80]
    rows = spark.createDataFrame([(True, True, True, 1), (True, False, True, 3), (False, True, True, 0), (True, False, False, None)], "s boolean, c boolean, n boolean, d int")
    assert [r[0] for r in rows.select(scores.evidence(*(rows[x] for x in "scnd"))).collect()] == [100, 70, 0, 30]


def test_objects_bind_once(spark):
    rows = spark.createDataFrame([(1, 1, 7, 90), (1, 1, 8, 70), (1, 2, 7, 95), (1, 2, 8, 60), (1, 3, None, None), (2, 1, 7, 90), (2, 1, 8, 80)], "d int, c int, o int, s int")
    got = sorted(map(tuple, ordered.bound_once(rows, "d", "c", "o", "s").collect()))
    assert got == [(1, 1, 7, 90), (1, 2, None, 60), (1, 3, None, 0), (2, 1, None, 90)]


def test_sub_figures_fall_back(spark):
    xrefs = spark.createDataFrame([(1, "fig1a"), (1, "fig2"), (1, "fig3b"), (1, "tab1a")], "d int, rid string")
    targets = spark.createDataFrame([(1, "fig1"), (1, "fig2"), (1, "tab1")], "d int, rid string")
    got = {r["rid"]: (r["target"], r["status"]) for r in matching.resolved_targets(xrefs, targets, ["d"], "rid").collect()}
    assert got == {"fig1a": ("fig1", "parent"), "fig2": ("fig2", "valid"), "fig3b": (None, "missing"), "tab1a": (None, "missing")}
