"""DOCX files built here, through blocks, articles, JATS, validation, scores and packages."""

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import article as assembly
from quire.operators import comparator, repair
from quire.plans import surface
from quire.sources import docx

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
HEAD = f'xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
OMML = "<m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath>"


def p(text="", style="", align="", bold=False, size=0, inside=""):
    pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{align}"/>' if align else "")
    rpr = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{2 * size}"/>' if size else "")
    return f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t>{text}</w:t></w:r>{inside}</w:p>"


def image(n, text=""):
    return p(text, inside=f'<w:r><a:blip r:embed="rId{n}"/></w:r>')


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 200)) + chunk(b"IEND", b"")


def word(*body, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {HEAD}><w:body>{''.join(body)}</w:body></w:document>")
        links = "".join(f'<Relationship Id="rId{n}" Target="media/image{n}.png"/>' for n in range(1, 5))
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for n in range(1, 5):
            z.writestr(f"word/media/image{n}.png", png())
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def files(spark, *contents):
    return spark.createDataFrame([(str(i), f"f{i}.docx", bytearray(c)) for i, c in enumerate(contents)], "doc_id string, name string, content binary")


CORE = [
    p("A Study of Structured Documents", align="center", bold=True, size=18), p("Jane Smith, Robert Jones"), p("1 School of Data, University of Somewhere, Town, Land"), p("Abstract: We study documents."),
    p("Keywords: structure; documents; tables"), p("1 Introduction", style="Heading1"), p("As Figure 1 and Table 1 show, and [1-2] said."), p("(1) a list item"), p("E = mc^2"), p("1.1 Background", style="Heading2"), p("More text here."),
    image(1), p("Figure 1. The flow of the study"), p("Table 1: Numbers of the study"), table(["a", "b"], ["1", "2"]), p("Note: values are counts."), p("", inside=OMML), p("References"),
    p("[1] Smith AB, Jones CD. A title of work. Journal of Examples 2024;12(3):101-109. https://doi.org/10.1234/ab.5"), p("[2] Doe J. Another work. Some Press. 2020."), p("Journal of More. 2021; 1: 1-9."),
]


def kinds(spark, *body):
    return [r["type"] for r in docx.flow_nodes(files(spark, word(*body))).orderBy("flow_index").collect()]


def test_flow_order(spark):
    got = kinds(spark, p("1 Results"), image(1), p("Figure 1. A flow"), table(["a", "b"], ["c", "d"]), p("Table 1. Values"), p("2 Discussion"), p("", inside=f"<m:oMathPara>{OMML}</m:oMathPara>"))
    assert got == ["heading", "image", "figure_caption", "table", "table_caption", "heading", "formula"]


def test_paragraph_types(spark):
    texts = ["Fig. 1 shows the flow", "Table 2 presents values", "Figure 1. Study flow", "Table 2: Values", "α-KG: α-ketoglutarate", r"\frac{a}{b} = sqrt(c)", "- item", "一、引言", "plain text"]
    assert kinds(spark, *map(p, texts)) == ["paragraph", "paragraph", "figure_caption", "table_caption", "paragraph", "formula", "list", "heading", "paragraph"]
    assert kinds(spark, p("month 60 months 120 months 180 months", bold=True), p("Why now?", bold=True), p("Closing stop.", bold=True)) == ["paragraph", "heading", "paragraph"]
    assert kinds(spark, p("sentence with ", inside=OMML), p("", inside=OMML)) == ["paragraph", "formula"]
    assert kinds(spark, image(1, "The extraction constant is defined as (2)"), image(2)) == ["formula_image", "image"]
    two = '<w:r><a:blip r:embed="rId1"/></w:r><w:r><a:blip r:embed="rId2"/></w:r>'
    assert kinds(spark, p("word " * 40, inside=two), p("short", inside=two)) == ["paragraph", "image", "image"]


def test_inspection(spark):
    bomb = word(p("x"), extra=[("word/media/zeros.bin", b"\0" * (2 << 20))])
    raw = files(spark, word(p("x")), word(p("x"), extra=[("../outside.txt", "x")]), bomb, b"MZ not a zip", b"")
    limits = docx.LIMITS | {"ratio": 5}
    got = {r["doc_id"]: r["reason"] for r in docx.inspected(docx.zip_entries(raw), limits).collect()}
    assert got == {"0": "", "1": "unsafe path", "2": "compression ratio", "3": "not a zip", "4": "not a zip"}
    named = spark.createDataFrame([("a.docx", b"x"), ("a.pdf", b"x"), ("a.doc", b"{\\rtf1"), ("a.DOC", bytes.fromhex("D0CF11E0A1B11AE1")), ("b.doc", b"MZ"), ("c.docx", b"")], "name string, content binary")
    assert [r[0] for r in named.select(docx.upload_reason(F.col("content"), F.col("name"))).collect()] == ["", "extension", "", "", "not a doc", "empty"]
    with_type = word(p("x")).replace(b"", b"")
    assert docx.media(files(spark, with_type)).count() == 4


def test_article(spark):
    (a,) = assembly.articles(docx.flow_nodes(files(spark, word(*CORE)))).collect()
    assert a["title"] == "A Study of Structured Documents" and [x["name"] for x in a["authors"]] == ["Jane Smith", "Robert Jones"]
    assert a["affiliations"] == ["1 School of Data, University of Somewhere, Town, Land"] and a["abstract"] == "We study documents." and a["keywords"] == ["structure", "documents", "tables"]
    assert [(s["label"], s["title"], s["level"]) for s in a["sections"]] == [("1", "Introduction", 1), ("1.1", "Background", 2)]
    assert a["sections"][1]["paragraphs"] == ["More text here.", "Note: values are counts."]
    assert [(f["id"], f["caption"], f["paths"]) for f in a["figures"]] == [("fig1", "Figure 1. The flow of the study", ["word/media/image1.png"])]
    (t,) = a["tables"]
    assert t["rows"] == [["a", "b"], ["1", "2"]] and t["caption"].startswith("Table 1") and t["notes"] == ["Note: values are counts."]
    assert [x["items"] for x in a["lists"]] == [["a list item"]] and [x["latex"] for x in a["formulas"]] == ["", r"\frac{a}{b}"]
    first, second = a["references"]
    assert (first["label"], first["year"], first["volume"], first["issue"], first["fpage"], first["lpage"], first["doi"], first["source"], first["publication_type"]) == ("[1]", "2024", "12", "3", "101", "109", "10.1234/ab.5", "Journal of Examples", "journal")
    assert first["authors"] == ["Smith AB", "Jones CD"] and second["raw"].endswith("Journal of More. 2021; 1: 1-9.")


def test_pictures_and_captions(spark):
    def one(*body):
        (a,) = assembly.articles(docx.flow_nodes(files(spark, word(p("T itle of it", align="center", bold=True, size=18), p("Abstract: x"), *body)))).collect()
        return a

    a = one(image(1), p("1 Body"), p("Table 1. Values"), image(2), table(["a"], ["b"]))  # front matter's is none; the picture is the table's
    assert not a["figures"] and a["tables"][0]["path"] == "word/media/image2.png" and a["tables"][0]["rows"] == [["a"], ["b"]]
    a = one(p("1 Body"), image(1), image(2), p("Figure 1. Both (A-B)"))
    assert [f["paths"] for f in a["figures"]] == [["word/media/image1.png", "word/media/image2.png"]]
    a = one(p("1 Body"), table(["red", "one"], ["blue", "two"]), p("Fig. 1: Legend above"))
    assert not a["tables"] and len(a["figures"]) == 1
    a = one(p("1 Body"), image(1), p("Figure 1. Survival"), p("Error bars: standard deviation"), p("1 month   60 months   120 months"), p("10  20  30"), p("Then prose goes on."))
    assert a["figures"][0]["caption"] == "Figure 1. Survival Error bars: standard deviation" and a["tables"][0]["rows"] == [["1 month", "60 months", "120 months"], ["10", "20", "30"]]
    a = one(p("2.1.1 Device Evidence", style="Heading3"), p("● Key Points"), p("1.1.1 Methods here"), p("Bold line of it", bold=True), p("Acknowledgements"), p("gone"), p("References"), p("1. X Y. Z. W. 2001."))
    assert [s["level"] for s in a["sections"]] == [3, 3] or [s["level"] for s in a["sections"]][:2] == [3, 4]
    assert len(a["references"]) == 1 and "gone" not in str(a["sections"])


def test_convert_and_export(spark):
    raw = files(spark, word(*CORE), b"MZ not a zip")
    done = surface.convert(raw).cache()
    rows = {r["doc_id"]: r for r in done.collect()}
    assert (rows["1"]["status"], rows["1"]["reason"]) == ("failed", "not a zip")
    r = rows["0"]
    root = ET.fromstring(r["jats"].split("?>", 1)[1].split("\n", 2)[2])
    assert r["status"] == "success" and r["passed"] and r["validation"]["jats_schema_valid"], r["validation"]
    body = root.find("body")
    assert [x.get("rid") for x in body.iter("xref")][:3] == ["fig1", "tab1", "ref1 ref2"] and [s.get("id") for s in body.iter("sec")] == ["sec1", "sec2"]
    assert body.find("sec/sec/fig/graphic") is not None and body.find(".//table-wrap/table/thead/tr/th").text == "a" and body.find(".//table-wrap-foot/fn/p").text.startswith("Note")
    assert "<![CDATA[\\frac{a}{b}]]>" in r["jats"] and root.find(".//{http://www.w3.org/1998/Math/MathML}mfrac") is not None
    assert root.find("back/ref-list/ref/element-citation/pub-id").text == "10.1234/ab.5" and root.find(".//contrib/xref").get("rid") == "aff1"
    assert r["scores" if "scores" in r else "metadata_score"] == 71 and r["grade"] in "ABCD" and r["validation"]["xref_checks"]
    (package,) = surface.export_packages(done, docx.media(raw)).collect()
    names = zipfile.ZipFile(io.BytesIO(bytes(package["package"]))).namelist()
    assert names[:3] == ["article.xml", "article.json", "validation_report.md"] and "media/image1.png" in names and names[-1] == "manifest.json"
    pairs = done.filter("status = 'success'").select("doc_id", "jats", F.lit(True).alias("schema_valid"))
    results, summary, accepted = surface.evaluate(pairs, pairs.select("doc_id", F.col("jats").alias("xml")), "doc_id")
    assert results.first()["similarity_score"] == 100 and tuple(summary.first()) == (1, 100.0, 100, 1.0) and accepted.count() == 1


def test_auto_fix(spark):
    broken = '<article><front><journal-meta><publisher/><journal-id>j</journal-id></journal-meta></front><body><fig id="fig1"><graphic href="a.png"/></fig><fig id="fig1"/><p>see <xref rid="ref1 ref2">[1,2]</xref> and <xref rid="ref3">[3]</xref> end</p></body><back><ref id="ref1"/></back></article>'
    root = repair.parsed(broken)
    fixed = repair.repaired(broken, repair.schema_errors(root))
    assert sorted(set(fixed["fixes"])) == ["DUPLICATE_ID", "GRAPHIC_XLINK_HREF", "JOURNAL_META_ORDER", "UNKNOWN_IDREF"] and fixed["remaining"] == []
    after = repair.parsed(fixed["xml"])
    assert [f.get("id") for f in after.iter("fig")] == ["fig1", "fig1-auto2"] and [x.get("rid") for x in after.iter("xref")] == ["ref1"]
    assert "".join(after.find("body/p").itertext()) == "see [1,2] and [3] end"
    untouched = repair.repaired(broken, ["issn is missing"])
    assert untouched["xml"] == broken and untouched["fixes"] == [] and repair.repaired(broken, [])["attempted"] is False
    rows = spark.createDataFrame([(broken,), ("<a",)], "x string").select(repair.checks(F.col("x")).alias("c")).collect()
    assert not rows[0]["c"]["schema_valid"] and rows[0]["c"]["well_formed"] and not rows[1]["c"]["well_formed"]


def test_comparator(spark):
    make = lambda figs, xrefs, extra="": f"<article><front><article-meta>{extra}<title-group><article-title>One title</article-title></title-group></article-meta></front><body><sec><title>1. Intro</title><p>{xrefs}</p>{figs}</sec></body></article>"
    ours = make('<fig id="fig1"><caption><p>A cap</p></caption></fig>', '<xref ref-type="fig" rid="fig1">1</xref><xref ref-type="bibr" rid="ref1 ref2">[1,2]</xref>')
    gold = make('<fig id="fig001"><caption><p>A cap</p></caption></fig>', '<xref ref-type="fig" rid="fig001">1</xref><xref ref-type="bibr" rid="ref1">1</xref><xref ref-type="bibr" rid="ref2">2</xref>', '<article-id pub-id-type="doi">10.1/x</article-id>')
    df = spark.createDataFrame([("a", ours, gold), ("b", ours, "<no"), ("c", gold, gold)], "k string, generated string, official string")
    rows = {r["k"]: r for r in comparator.compared(df).collect()}
    assert rows["a"]["metrics"]["xref_targets"] == 100 and rows["a"]["metrics"]["figure_caption"] == 100 and rows["c"]["similarity_score"] == 100 and rows["b"]["similarity_score"] == 0
    assert [d["metric"] for d in rows["a"]["differences"]] == ["doi"] and rows["a"]["differences"][0]["level"] == "info"
    assert rows["a"]["generated_counts"]["fig"] == 1


@pytest.mark.parametrize("left,right,want", [("", "", 1.0), ("a b", "", 0.0), ("The cat", "the cat", 1.0), ("été ici", "été là", 0.5)])
def test_token_score(spark, left, right, want):
    assert spark.range(1).select(comparator.token_score(F.lit(left), F.lit(right))).first()[0] == want
