"""A20, H25, J: articles as JATS Publishing 1.3 documents.

An article is a struct column; each is written by one Arrow function, a string at a time, with no tree in memory. Paragraphs
come with their cross-references resolved (Column expressions), so writing only puts tags around spans.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations, names
from ..functions._udf import arrow

# The standard's names.
DOCTYPE = '<!DOCTYPE article PUBLIC "-//NLM//DTD JATS (Z39.96) Journal Publishing DTD with MathML3 v1.3 20210610//EN" "JATS-journalpublishing1-3-mathml3.dtd">'
NAMESPACES = 'xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:mml="http://www.w3.org/1998/Math/MathML"'
MATH = "{http://www.w3.org/1998/Math/MathML}math"
FIELDS = ["article_title", "source", "year", "volume", "issue", "fpage", "lpage"]


def _tag(name: str, *inside: str, **attributes: str | None) -> str:
    head = name + "".join(f' {k.replace("__", ":").replace("_", "-")}="{escape(v)}"' for k, v in attributes.items() if v is not None)
    body = "".join(inside)
    return f"<{head}>{body}</{name}>" if body else f"<{head}/>"


def _plain(text: str | None) -> str:
    return escape(text or "", quote=False)


def mixed(piece: dict) -> str:
    """A text with its references as xref elements; one without a target stays text."""
    text, spans, out, at = piece["text"] or "", piece["spans"], [], 0
    for s in spans if spans is not None else ():
        if len(s["rids"]):
            out += [_plain(text[at : s["start"]]), _tag("xref", _plain(s["text"]), ref_type=s["ref_type"], rid=" ".join(s["rids"]))]
            at = s["end"]
    return "".join(out) + _plain(text[at:])


def _sections(article: dict) -> Iterator[tuple[int, str, list[str]]]:
    """(level, opening, paragraphs) of every section."""
    for number, s in enumerate(article["sections"], 1):
        head = (_tag("label", _plain(s["label"])) if s["label"] else "") + f"<title>{_plain(s['title'])}</title>"
        yield s["level"], f'<sec id="sec{number}" sec-type="level-{s["level"]}">{head}', [_tag("p", mixed(p)) for p in s["paragraphs"]]


def _table(rows: list[list[dict]]) -> str:
    row = lambda cells, tag: _tag("tr", *(_tag(tag, mixed(c)) for c in cells))
    head = _tag("thead", row(rows[0], "th")) if len(rows) > 1 else ""
    return _tag("table", head, _tag("tbody", *(row(r, "td") for r in rows[len(rows) > 1 :])))


def _floats(article: dict) -> Iterator[tuple[int, str]]:
    """(section or -1, element) of every float, in the order of the generator: figures, tables, lists, formulas."""
    graphic = lambda path: _tag("graphic", xlink__href=path)
    captioned = lambda x, n, word: _tag("label", _plain(x["label"] or f"{word} {n}")) + _tag("caption", _tag("p", mixed(x["caption"])))
    for n, x in enumerate(article["figures"], 1):
        yield x["section_index"], _tag("fig", captioned(x, n, "Fig."), *(graphic(p) for p in x["paths"]), id=x["id"])
    for n, x in enumerate(article["tables"], 1):
        inside = _table(x["rows"]) if len(x["rows"]) else graphic(x["path"]) if x["path"] else ""
        notes = [_tag("fn", _tag("p", mixed(t)), id=f"{x['id']}-fn{k}") for k, t in enumerate(x["notes"], 1)]
        yield x["section_index"], _tag("table-wrap", captioned(x, n, "Table"), inside, _tag("table-wrap-foot", *notes) if notes else "", id=x["id"])
    for x in article["lists"]:
        yield x["section_index"], _tag("list", *(_tag("list-item", _tag("p", mixed(i))) for i in x["items"]), id=x["id"])
    for x in article["formulas"]:
        label = _tag("label", _plain(x["label"])) if x["label"] else ""
        if x["type"] == "image_formula" and x["path"]:
            yield x["section_index"], _tag("disp-formula", label, graphic(x["path"]), id=x["id"])
            continue
        tex = (x["latex"] or x["content"] or "").replace("]]>", "]]]]><![CDATA[>")
        yield x["section_index"], _tag("disp-formula", label, _tag("alternatives", _mathml(x["mathml"]), f"<tex-math><![CDATA[{tex}]]></tex-math>"), id=x["id"])


def _mathml(text: str | None) -> str:
    """MathML as it is, if its root is a math element of that namespace and it parses; else nothing."""
    try:
        return text if text and "<!DOCTYPE" not in text.upper() and ET.fromstring(text).tag == MATH else ""
    except ET.ParseError:
        return ""


def _body(article: dict) -> str:
    """Sections as a tree by their levels; a section's floats come before its first child section."""
    sections, held = list(_sections(article)), {}
    for index, element in _floats(article):
        place = index if index is not None and 0 <= index < len(sections) else (0 if sections and not element.startswith("<disp-formula") else -1)
        held.setdefault(place, []).append(element)
    out, open_levels = [], []
    for number, (level, opening, paragraphs) in enumerate(sections):
        while open_levels and open_levels[-1] >= level:
            out.append("</sec>")
            open_levels.pop()
        out += [opening, *paragraphs, *held.get(number, [])]
        open_levels.append(level)
    return "<body>" + "".join(out) + "</sec>" * len(open_levels) + "".join(held.get(-1, [])) + "</body>"


def _name(parts: dict) -> str:
    return _tag("name", f"<surname>{_plain(parts['surname'])}</surname>", f"<given-names>{_plain(parts['given'])}</given-names>")


def _front(a: dict) -> str:
    journal = _tag(
        "journal-meta", f'<journal-id journal-id-type="publisher-id">{_plain(a["journal_id"])}</journal-id>', _tag("journal-title-group", f"<journal-title>{_plain(a['journal_title'])}</journal-title>"),
        _tag("issn", _plain(a["issn"]), pub_type="epub") if a["issn"] else "", _tag("publisher", f"<publisher-name>{_plain(a['publisher_name'])}</publisher-name>"),
    )
    affiliations = [_tag("aff", _tag("label", _plain(x["label"])), f" {_plain(x['body'])}" if x["body"] else "", id=f"aff{n}") for n, x in enumerate(a["affiliations"], 1)]
    authors = []
    for x in a["authors"]:
        orcid = _tag("contrib-id", _plain(x["orcid"]), contrib_id_type="orcid") if x["orcid"] else ""
        of = x["affiliation_ids"] if len(x["affiliation_ids"]) else [f"aff{n}" for n in range(1, len(affiliations) + 1)]  # C10
        authors.append(_tag("contrib", orcid, _name(x["name"]), *(_tag("xref", ref_type="aff", rid=r) for r in of), contrib_type="author"))
    date = "".join(_tag(p, _plain(a[f"pub_{p}"])) for p in ("day", "month", "year") if a[f"pub_{p}"])
    meta = [
        _tag("article-id", _plain(a["doi"]), pub_id_type="doi") if a["doi"] else "",
        _tag("article-categories", _tag("subj-group", _tag("subject", _plain(a["subject"])), subj_group_type="heading")) if a["subject"] else "",
        _tag("title-group", f"<article-title>{_plain(a['title'])}</article-title>"), _tag("contrib-group", *authors) if authors else "", *affiliations,
        _tag("pub-date", date, publication_format="electronic") if date else "", _tag("abstract", f"<p>{_plain(a['abstract'])}</p>"), _tag("kwd-group", *(_tag("kwd", _plain(k)) for k in a["keywords"])) if len(a["keywords"]) else "",
    ]
    return _tag("front", journal, _tag("article-meta", *meta))


def _back(a: dict) -> str:
    refs = []
    for n, x in enumerate(a["references"], 1):
        parts = [_tag("label", _plain(x["label"] or f"[{n}]"))]
        structured = x["article_title"] or x["source"] or x["year"]
        if x["raw"] or not structured:
            parts.append(_tag("mixed-citation", _plain(x["raw"])))
        if structured:
            people = _tag("person-group", *(_name(p) for p in x["authors"]), person_group_type="author") if len(x["authors"]) else ""
            fields = "".join(_tag(f.replace("_", "-"), _plain(x[f])) for f in FIELDS if x[f])
            doi = _tag("pub-id", _plain(x["doi"]), pub_id_type="doi") if x["doi"] else ""
            parts.append(_tag("element-citation", people, fields, doi, publication_type=x["publication_type"] or "journal"))
        refs.append(_tag("ref", *parts, id=x["id"]))
    return _tag("back", _tag("ref-list", "<title>References</title>", *refs) if refs else "")


def document(a: dict) -> str:
    root = f'<article {NAMESPACES} article-type="{escape(a["article_type"] or "research-article")}" dtd-version="1.3" xml:lang="{escape(a["lang"] or "zh")}">'
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", f'<?xml version="1.0" encoding="UTF-8"?>\n{DOCTYPE}\n{root}{_front(a)}{_body(a)}{_back(a)}</article>')


@arrow("string")
def _written(articles: pd.DataFrame) -> pd.Series:
    return pd.Series([document(a) for a in articles.to_dict("records")], dtype=object)


ARTICLE = """title string, abstract string, journal_id string, journal_title string, issn string, publisher_name string, article_type string, lang string, doi string, subject string,
pub_year string, pub_month string, pub_day string, keywords array<string>, affiliations array<string>, authors array<struct<name:string,orcid:string,affiliation_ids:array<string>>>,
sections array<struct<label:string,title:string,level:int,paragraphs:array<string>>>, figures array<struct<id:string,caption:string,paths:array<string>,section_index:int>>,
tables array<struct<id:string,caption:string,rows:array<array<string>>,notes:array<string>,path:string,section_index:int>>, lists array<struct<id:string,items:array<string>,section_index:int>>,
formulas array<struct<id:string,label:string,type:string,content:string,latex:string,mathml:string,path:string,section_index:int>>,
references array<struct<id:string,label:string,raw:string,authors:array<string>,article_title:string,source:string,year:string,volume:string,issue:string,fpage:string,lpage:string,doi:string,publication_type:string>>"""
PREFIXES = {"figures": "fig", "tables": "tab", "lists": "list", "formulas": "eq", "references": "ref"}


def with_ids(articles: DataFrame) -> DataFrame:
    """Objects without an id get their kind and place."""

    def numbered(field: str, prefix: str) -> Column:
        return F.transform(field, lambda x, i: x.withField("id", F.coalesce(F.nullif(x["id"], F.lit("")), F.concat(F.lit(prefix), (i + 1).cast("string")))))

    return articles.withColumns({field: numbered(field, prefix) for field, prefix in PREFIXES.items()})


def targets(article_columns: list[str] | None = None) -> Column:
    """The ids that references may point to."""
    return F.array_distinct(F.concat(*(F.transform(f, lambda x: x["id"]) for f in ("figures", "tables", "formulas", "references"))))


def to_jats(articles: DataFrame, out: str = "jats") -> DataFrame:
    """The rows with the document of each article (its columns as ARTICLE has them)."""
    rows = with_ids(articles).withColumn("_targets", targets())
    # Candidates of all texts of a row come from one call; texts meet them by place.
    texts = F.concat(
        F.flatten(F.transform("sections", lambda s: s["paragraphs"])), F.transform("figures", lambda x: names.caption_split(x["caption"], F.lit("figure"))["caption"]),
        F.transform("tables", lambda x: names.caption_split(x["caption"], F.lit("table"))["caption"]), F.flatten(F.transform("tables", lambda x: F.concat(F.flatten(x["rows"]), x["notes"]))),
        F.flatten(F.transform("lists", lambda x: x["items"])),
    )
    rows = rows.withColumn("_texts", F.array_distinct(texts)).withColumn("_found", _candidates_of("_texts"))
    found = F.transform("_found", lambda f: citations.against_targets(citations.resolved(f), F.col("_targets")))
    rows = rows.withColumn("_spans", F.map_from_arrays("_texts", found))
    piece = lambda t: F.struct(t.alias("text"), F.col("_spans")[t].alias("spans"))
    # A section's number among those of level 1: how many stand at or before it.
    level = lambda s: F.greatest(F.lit(1), F.coalesce(s["level"], F.lit(1)))
    tops = F.aggregate("sections", F.array().cast("array<int>"), lambda seen, s: _append(seen, F.when(level(s) == 1, 1).otherwise(0)))
    rows = rows.withColumn("_tops", tops)

    def section(s: Column, i: Column) -> Column:
        named = names.section_parts(s["label"], s["title"], level(s), F.get(F.col("_tops"), i))
        return F.struct(named["label"].alias("label"), named["title"].alias("title"), level(s).alias("level"), F.transform(s["paragraphs"], piece).alias("paragraphs"))

    def captioned(kind: str):
        def one(x: Column) -> Column:
            parts = names.caption_split(x["caption"], F.lit(kind))
            x = x.withField("label", parts["label"]).withField("caption", piece(parts["caption"]))
            return x.withField("rows", F.transform(x["rows"], lambda r: F.transform(r, piece))).withField("notes", F.transform(x["notes"], piece)) if kind == "table" else x

        return one

    shaped = {
        "sections": F.transform("sections", section), "figures": F.transform("figures", captioned("figure")), "tables": F.transform("tables", captioned("table")),
        "lists": F.transform("lists", lambda x: x.withField("items", F.transform(x["items"], piece))), "affiliations": F.transform("affiliations", lambda t, i: names.affiliation_parts(t, i + 1)),
        "authors": F.transform("authors", lambda x: x.withField("name", names.name_parts(x["name"])).withField("affiliation_ids", F.coalesce(x["affiliation_ids"], F.array().cast("array<string>")))),
        "references": F.transform("references", lambda x: x.withField("authors", F.transform(x["authors"], names.name_parts))),
    }
    columns = articles.sparkSession.createDataFrame([], ARTICLE).columns
    return rows.withColumn(out, _written(F.struct(*(shaped.get(c, F.col(c)).alias(c) for c in columns)))).drop("_targets", "_texts", "_found", "_spans", "_tops")


def _append(seen: Column, step: Column) -> Column:
    return F.concat(seen, F.array(F.coalesce(F.get(seen, F.size(seen) - 1), F.lit(0)) + step))


@arrow(f"array<{citations.CANDIDATES}>")
def _candidates_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: [citations.found_in(t) for t in ts], na_action=None)
