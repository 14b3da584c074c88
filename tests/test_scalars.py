"""Scalar functions against literal cases."""

import difflib

import pytest
from pyspark.sql import functions as F

from quire.functions import blocks, citations, names, omml
from quire.operators import comparator, views
from quire.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,kind,want", [
    ("Scheme 1: Structure of the complex", "figure", ("Scheme 1", "Structure of the complex", "normalized")), ("图 1-1 系统架构", "figure", ("图 1-1", "系统架构", "normalized")),
    ("no label here", "figure", ("", "no label here", "unchanged")), ("Table 2.", "table", ("Table 2", "", "need_review")), ("TABLE 3. Rows", "table", ("TABLE 3", "Rows", "normalized")),
])
def test_captions(spark, text, kind, want):
    assert tuple(one(spark, names.caption_split(F.lit(text), F.lit(kind)))) == want


def test_names(spark):
    assert tuple(one(spark, names.contributor(F.lit("Ivo Deblier²")))) == ("Ivo Deblier", "Ivo Deblier²", ["²"], "normalized")
    assert tuple(one(spark, names.contributor(F.lit("Researcher X2"))))[3] == "unchanged"
    assert one(spark, names.author_names(F.lit("F. Smith1*, K. Jones2 and Harendra Alwis 1,*"), ["authors"])) == ["F. Smith", "K. Jones", "Harendra Alwis"]
    assert one(spark, names.author_names(F.lit("Author information:"), ["author information"])) == [] and one(spark, names.author_names(F.lit("张三，李四"), [])) == ["张三", "李四"]
    assert tuple(one(spark, names.name_parts(F.lit("张三丰")))) == ("张", "三丰") and tuple(one(spark, names.name_parts(F.lit("Jane Smith")))) == ("", "Jane Smith")
    assert tuple(one(spark, names.affiliation_parts(F.lit("2School of X"), F.lit(9)))) == ("2", "School of X") and tuple(one(spark, names.affiliation_parts(F.lit("School of X"), F.lit(9)))) == ("9", "School of X")
    assert one(spark, names.table_row(F.lit("1 month   60 months   120 months"))) == ["1 month", "60 months", "120 months"] and one(spark, names.table_row(F.lit("10 20 <30"))) == ["10", "20", "<30"]
    assert one(spark, names.clean_abstract(F.lit("We did it. Received: May 2020"))) == "We did it." and one(spark, names.number_matches(F.lit("fig2"), F.lit("Fig. 2 x")))


def test_formula_forms(spark):
    assert tuple(one(spark, names.formula_form(F.lit("x + y x+y (1)"), F.lit("x + y"), F.lit(""))))[:3] == ("(1)", "x + y", "normalized")
    assert tuple(one(spark, names.formula_form(F.lit("x + y"), F.lit("z^2"), F.lit(""))))[2:] == ("partial", True)


@pytest.mark.parametrize("text,want", [
    ("图 1", [["fig1"]]), ("[1-3]", [["ref1", "ref2", "ref3"]]), ("Figures 1-3", [["fig1", "fig2", "fig3"]]), ("Table one", [["tab1"]]), ("Fig. 1a", [["fig1a"]]), ("Eqs. (1) and (3)", [["eq1", "eq3"]]), ("[3-1, 7]", [["ref3", "ref2", "ref1", "ref7"]]),
    ("如图1和表 1所示，公式见Eq. (1)，相关研究见[1,2]。", [["fig1"], ["tab1"], ["eq1"], ["ref1", "ref2"]]), ("[1-3-5]", [[]]), ("none", []),
])
def test_references_in_texts(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string").withColumn("c", citations.candidates("t")).select(citations.resolved(F.col("c")).alias("s"))
    assert [s["rids"] for s in rows.first()["s"]] == want


def test_targets(spark):
    rows = spark.createDataFrame([("Fig. 1a", ["fig1"]), ("[1-4]", ["ref1", "ref2", "ref3"]), ("1-1500, 7", [])], "t string, ids array<string>").withColumn("c", citations.candidates("t"))
    got = [r["s"] for r in rows.select(citations.against_targets(citations.resolved(F.col("c")), F.col("ids")).alias("s")).collect()]
    assert (got[0][0]["rids"], got[0][0]["status"], got[0][0]["normalized_from"]) == (["fig1"], "need_review", ["fig1a"]) and got[1][0]["missing_targets"] == ["ref4"]
    assert len(one(spark, citations.expanded(F.lit("1-1500, 7")))) == 1500 and one(spark, citations.expanded(F.lit("5—3，9"))) == [5, 4, 3, 9]


def test_author_years(spark):
    rows = spark.createDataFrame([("(Austen R. Anderson & Blaine J. Fowers, 2020; Wai Kai Hou, et al., 2020) and Deng et al. (2019)",)], "t string").select(citations.author_years("t").alias("a"))
    found = rows.first()["a"]
    assert [(a["author"].strip(), a["year"]) for a in found] == [("Austen R. Anderson & Blaine J. Fowers", "2020"), ("Wai Kai Hou, et al.", "2020"), ("Deng et al.", "2019")]
    assert one(spark, citations.author_keys(F.lit("Wai Kai Hou, et al."))) == ["wai", "hou"] and "fowers" not in one(spark, citations.author_keys(F.lit("Austen R. Anderson & Blaine J. Fowers")))


def test_entries(spark):
    texts = [
        "[2] Smith AB, Jones CD. Structured documents for all. Journal of XML Methods 2024;12(3):101-109. https://doi.org/10.1234/xyz.1",
        "3. Wang L, Li M. A method of work[J]. Some Journal, 2019, 5(2): 10-20.", "Smith J, Doe A, A long title, Journal of Things, 12 (2020) 100-110.", "（3）Only text here", "plain line without anything",
    ]
    rows = citations.parsed_entries(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    a, b, c, d, e = rows
    assert (a["label"], a["authors"], a["article_title"], a["source"], a["year"], a["volume"], a["issue"], a["fpage"], a["lpage"], a["doi"], a["publication_type"], a["parse_confidence"]) == ("[2]", ["Smith AB", "Jones CD"], "Structured documents for all", "Journal of XML Methods", "2024", "12", "3", "101", "109", "10.1234/xyz.1", "journal", 1.0)
    assert (b["label"], b["publication_type"], b["source"], b["year"], b["issue"]) == ("3.", "journal", "Some Journal", "2019", "2")
    assert (c["authors"], c["article_title"], c["source"], c["volume"], c["year"], c["fpage"]) == (["Smith J", "Doe A"], "A long title", "Journal of Things", "12", "2020", "100")
    assert (d["label"], d["raw"]) == ("（3）", "Only text here") and (e["label"], e["parse_confidence"]) == ("", 0.0)


def test_blocks(spark):
    assert one(spark, blocks.is_back_heading(F.lit("Funding: none"))) and not one(spark, blocks.is_back_heading(F.lit("Abbreviations: a"))) and one(spark, blocks.is_back_heading(F.lit(" Data Availability. ")))
    title = lambda t, kind="paragraph", style="": tuple(one(spark, blocks.section_title(F.lit(t), F.lit(style), F.lit(kind))))
    assert title("2.1.1 Device Evidence") == ("2.1.1", "Device Evidence", 3) and title("274 242 13844")[2] == 0 and title("2 or more procedures 1137/1835 (62.0)")[2] == 0
    assert title("Main Findings")[2] == 2 and title("一、引言") == ("一", "引言", 1) and title("（二）方法") == ("二", "方法", 2) and title("Methods", "heading")[2] == 1 and title("Methods", style="标题 3")[2] == 3
    assert one(spark, blocks.is_unlabeled_reference(F.lit("Doe J. Some work. A Journal. 2020;12(3):100-110."))) and one(spark, blocks.is_reference_continuation(F.lit("https://doi.org/10.1/x")))
    assert one(spark, blocks.is_figure_legend(F.array(F.array(F.lit("a"), F.lit("b"))))) and not one(spark, blocks.is_figure_legend(F.array(*[F.array(F.lit("a"))] * 5)))
    assert one(spark, blocks.jats_path(F.lit("table")))["tag"] == "table" and one(spark, blocks.default_confidence(F.lit("unknown")))["confidence"] == 35


def test_omml():
    ns = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    e = lambda t, n="e": f"<m:{n}>{r(t)}</m:{n}>"
    got = omml.converted(f'<m:oMath {ns}><m:f>{e("a", "num")}{e("b", "den")}</m:f><m:rad>{e("z")}</m:rad><m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr>{e("i=1", "sub")}{e("n", "sup")}{e("x")}</m:nary><m:d>{e("y")}</m:d></m:oMath>')
    assert got["latex"] == r"\frac{a}{b}\sqrt{z}\sum_{i=1}^{n}x(y)" and got["conversion_status"] == "success" and "munderover" in got["mathml"]
    rows = "".join(f"<m:mr>{e(a)}{e(b)}</m:mr>" for a, b in ("ab", "cd"))
    matrix = omml.converted(f"<m:oMath {ns}><m:m>{rows}</m:m></m:oMath>")
    assert matrix["latex"] == r"\begin{matrix}a & b \\ c & d\end{matrix}" and matrix["mathml"].count("<mml:mtd>") == 4
    cases = omml.converted(f'<m:oMath {ns}><m:d><m:dPr><m:begChr m:val="{{"/></m:dPr><m:e><m:eqArr>{e("a")}{e("b")}</m:eqArr></m:e></m:d></m:oMath>')
    assert cases["latex"] == r"\begin{cases}a \\ b\end{cases}"
    hat = omml.converted(f'<m:oMath {ns}><m:acc><m:accPr><m:chr m:val="^"/></m:accPr>{e("q")}</m:acc></m:oMath>')
    odd = omml.converted(f"<m:oMath {ns}><m:phant>{e('q')}</m:phant></m:oMath>")
    assert hat["latex"] == r"\hat{q}" and odd["conversion_status"] == "partial" and odd["unsupported_features"] == ["omml_phant"] and omml.converted("<no")["conversion_status"] == "failed"


def test_ratios(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("a", ""), ("the quick brown fox " * 20, "the quack brown fox " * 20)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(comparator.text_ratio("a", "b").alias("x")).collect()
    assert [r["x"] for r in rows] == [1.0 if not a and not b else 0.0 if not a or not b else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert one(spark, comparator.xref_key(F.struct(F.lit("fig").alias("type"), F.lit("fig001").alias("rid"), F.lit("").alias("text")))) == "fig:1"


def test_turns_by_the_sequence_matcher(spark):
    """The query that SQL cannot express, against a plain version."""
    import re

    sf = "/root/testdata/sf0.001"
    rows = {(r["conv_id"], r["turn"]): r for r in catalog.queries()["text_ratios"](spark, sf).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["text"] or ""))
    clean = lambda t: re.sub(comparator.PUNCTUATION, "", t.lower())
    for conv, said in turns.items():
        said.sort()
        for (turn, a), (_, b) in zip(said, said[1:]):
            assert rows[conv, turn]["ratio"] == pytest.approx(comparator.ratio(clean(a), clean(b)), abs=1e-8)


def test_views(spark):
    xml = '<body><sec id="s1"><fig id="fig1" x="y"/></sec></body>'
    assert one(spark, views.fragment(F.lit(xml), F.lit("fig1"), F.lit("sec"))) == '<fig id="fig1" x="y"/>' and one(spark, views.fragment(F.lit(xml), F.lit("none"), F.lit("sec"))) == '<sec id="s1">'
    rows = spark.createDataFrame([(1, "ok"), (1, "warning"), (2, "need_review")], "d int, s string").groupBy("d").agg(views.worst("s").alias("w")).collect()
    assert {r["d"]: r["w"] for r in rows} == {1: "warning", 2: "need_review"}


def test_profiles_and_known_tables(spark):
    patterns = lambda *p: F.array(*map(F.lit, p))
    kind = lambda t, k="paragraph": one(spark, blocks.profile_type(F.lit(t), F.lit(k), F.lit(""), patterns(r"^\s*Fig\.?\s*\d+"), patterns(r"^\s*Table\s*\d+")))
    assert kind("Fig. 3. A flow") == "figure_caption" and kind("Fig. 3 shows a flow") == "paragraph" and kind("Table 1: Values") == "table_caption"
    rows = F.array(F.array(*map(F.lit, ("Linear equation", "Diluent", "log D", "pH"))))
    assert one(spark, blocks.inferred_caption(F.lit(""), rows)) == blocks.KNOWN_CAPTION and one(spark, blocks.inferred_caption(F.lit("own"), rows)) == "own"


def test_articles_from_json(spark, tmp_path):
    from quire.plans import surface

    (tmp_path / "a.json").write_text('{"doc_id": "1", "title": "T", "abstract": "A", "keywords": ["k"], "sections": [{"label": "", "title": "One", "level": 1, "paragraphs": ["see Fig. 1"]}], "figures": [{"id": "", "caption": "Fig. 1. C", "paths": ["a.png"], "section_index": 0}]}')
    row = surface.regenerate(surface.read_articles(spark, f"file://{tmp_path}/a.json")).first()
    assert 'rid="fig1"' in row["jats"] and "<label>1.</label>" in row["jats"] and row["passed"] and row["validation"]["jats_schema_valid"]
