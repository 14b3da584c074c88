"""Costly rows are dealt to tasks by a table's size: one row group, or few shuffle partitions, do not make one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import citations
from quire.plans import catalog
from quire.sources.tables import table, task_count

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["citation_fields", "xref_spans", "xref_places", "best_bindings", "converted_formulas"])
def test_rows_are_dealt_by_size(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f", {task_count(table(spark, SF, 'lineitem'))}), REPARTITION_BY_NUM" in plan, plan


def test_task_count_grows_with_the_table(spark):
    rows = table(spark, SF, "lineitem")
    assert task_count(rows) == 2 * spark.sparkContext.defaultParallelism < task_count(rows, 1000)


def test_entries_with_odd_signs(spark):
    texts = ["[1] Smith AB. Ti\x01tle. Journal of X 2020;12(3):1-9.\n", "Smith AB, Jones CD, A title, Journal of Y, 12 (2019) 33-40 ", "Doe J. Other. Press 2001[m].", None]
    rows = citations.parsed_entries(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").select("source", "year", "volume", "fpage", "lpage", "publication_type", F.size("authors").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("Journal of X", "2020", "12", "1", "9", "journal", 1), ("Journal of Y", "2019", "12", "33", "40", "journal", 2), ("Press", "2001", "", "", "", "book", 1), ("", None, None, None, None, "", 0)]


def test_matches_are_those_of_each_pattern_alone(spark):
    pick = random.Random(3)
    signs = ["Fig", "figs. ", "Fİg 2", "Tableq. (1)", "Table ", "Eqs. ", "图", "公式", "式", "(1)", "（2）", "[1]", "[2-4, 7]", "1", "12", "3a", "(b)", " and ", ", ", "–", "ten", "ſix", "FFig 1", "\n", "]"]
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 12))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", citations.candidates(F.col("t")).alias("c")).collect()
    for i, found in rows:
        want = texts[i] and [(kind, m.start(), m.end(), m[0]) for kind, _, x in citations.KINDS for m in re.finditer(x, texts[i], re.I)]
        assert (found if found is None else [(x["ref_type"], x["start"], x["end"], x["text"]) for x in found]) == (want if texts[i] else found if texts[i] is None else []), texts[i]
    assert rows[-1]["c"] is None
