"""Checks and repairs of JATS documents, one document an Arrow call; reports are columns.

The schema check covers what the generator emits: that the document parses, ids are unique, references have targets, graphics
link by xlink, and the content of journal-meta and article-meta is in the standard's order (fixed values). Repairs never
add content.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sinks.jats import DOCTYPE
from ..functions._udf import arrow

XLINK = "http://www.w3.org/1999/xlink"
HREF = f"{{{XLINK}}}href"
# Fixed values.
JOURNAL_META = ["journal-id", "journal-title-group", "contrib-group", "aff", "aff-alternatives", "issn", "issn-l", "isbn", "publisher", "notes", "self-uri", "custom-meta-group"]
ARTICLE_META = ["article-id", "article-categories", "title-group", "contrib-group", "aff", "pub-date", "abstract", "kwd-group"]
REQUIRED = ["journal-meta", "article-meta", "title-group", "body", "back"]
KINDS = ["fig", "table", "disp-formula", "bibr"]
MOST_ROUNDS = 2
for _prefix, _uri in (("xlink", XLINK), ("mml", "http://www.w3.org/1998/Math/MathML")):
    ET.register_namespace(_prefix, _uri)


def _name(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def parsed(xml: str | None) -> ET.Element | None:
    """The root; None where the text does not parse or declares entities."""
    try:
        text = re.sub(r"<!DOCTYPE[^>\[]*>", "", xml or "")
        return None if "<!DOCTYPE" in text else ET.fromstring(text.encode())
    except (ET.ParseError, ValueError):
        return None


def _in_order(names: list[str], order: list[str]) -> bool:
    ranks = [order.index(n) if n in order else len(order) for n in names]
    return ranks == sorted(ranks)


def schema_errors(root: ET.Element) -> list[str]:
    """K3: what the subset of the standard finds."""
    out, seen = [], set()
    for node in root.iter():
        kids, name = [_name(k) for k in node], _name(node)
        if name == "graphic" and HREF not in node.attrib:
            out.append("Element graphic does not carry attribute xlink:href")
        for parent, order in (("journal-meta", JOURNAL_META), ("article-meta", ARTICLE_META)):
            if name == parent and not _in_order(kids, order):
                out.append(f"Element {parent} content does not follow the DTD")
        if (ident := node.get("id")) is not None:
            out += [f"ID {ident} already defined"] if ident in seen else []
            seen.add(ident)
    out += [f"IDREF attribute rid references an unknown ID {r!r}" for x in root.iter() if _name(x) == "xref" for r in x.get("rid", "").split() if r not in seen]
    return out


def _links(root: ET.Element) -> list[str]:
    """K9."""
    bad = [g for g in root.iter() if _name(g) == "graphic" and g.get("href") and HREF not in g.attrib]
    for g in bad:
        g.set(HREF, g.attrib.pop("href"))
    return ["GRAPHIC_XLINK_HREF"] * len(bad)


def _order(root: ET.Element) -> list[str]:
    """Journal-meta in the standard's order, unknown children last, equals as they stood."""
    found = []
    for meta in (m for m in root.iter() if _name(m) == "journal-meta"):
        if not _in_order([_name(k) for k in meta], JOURNAL_META):
            meta[:] = sorted(meta, key=lambda k: JOURNAL_META.index(_name(k)) if _name(k) in JOURNAL_META else len(JOURNAL_META))
            found.append("JOURNAL_META_ORDER")
    return found


def _ids(root: ET.Element) -> list[str]:
    """A repeated id gets the next free number."""
    taken, found = set(), []
    for node in (n for n in root.iter() if n.get("id") is not None):
        ident, number = node.get("id"), 2
        if ident in taken:
            while f"{ident}-auto{number}" in taken:
                number += 1
            node.set("id", f"{ident}-auto{number}")
            found.append("DUPLICATE_ID")
        taken.add(node.get("id"))
    return found


def _references(root: ET.Element) -> list[str]:
    """Targets that do not exist go; a reference left without one becomes its text."""
    known, found = {n.get("id") for n in root.iter()}, []
    for parent in list(root.iter()):
        rebuilt, changed = [], False
        text = parent.text or ""
        for kid in list(parent):
            rids = kid.get("rid", "").split() if _name(kid) == "xref" else []
            valid = [r for r in rids if r in known]
            if len(valid) < len(rids):
                found.append("UNKNOWN_IDREF")
            if valid or not rids:
                if len(valid) < len(rids):
                    kid.set("rid", " ".join(valid))
                rebuilt.append(kid)
                continue
            changed, words = True, "".join(kid.itertext()) + (kid.tail or "")
            if rebuilt:
                rebuilt[-1].tail = (rebuilt[-1].tail or "") + words
            else:
                text += words
        if changed:
            parent[:], parent.text = rebuilt, text
    return found


#: Which errors ask for which repair.
REPAIRS = [(r"graphic.*(?:xlink:href|attribute href)", _links), (r"journal-meta content does not follow", _order), (r"\bid .*(?:already defined|duplicate)", _ids), (r"unknown id|dtd_unknown_id", _references)]


def repaired(xml: str | None, errors: list[str] | None) -> dict:
    """Repairs that the errors ask for, twice at most; without errors the text stays as it is."""
    given, codes, rounds, text = list(errors) if errors is not None else [], [], 0, xml
    left, root = given, parsed(xml) if given else None
    while left and root is not None and rounds < MOST_ROUNDS:
        rounds += 1
        done = [code for pattern, repair in REPAIRS if re.search(pattern, "\n".join(left), re.I | re.S) for code in repair(root)]
        if not done:
            break
        codes += done
        text = f'<?xml version="1.0" encoding="UTF-8"?>\n{DOCTYPE}\n{ET.tostring(root, encoding="unicode")}'
        left = schema_errors(root)
    return {"xml": text, "attempted": bool(given), "rounds": rounds, "fixes": codes, "before": len(given), "remaining": left}


@arrow("struct<xml:string,attempted:boolean,rounds:int,fixes:array<string>,before:int,remaining:array<string>>")
def auto_fixed(xml: pd.Series, errors: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repaired(x, e) for x, e in zip(xml, errors)], columns=["xml", "attempted", "rounds", "fixes", "before", "remaining"])


def checked(xml: str | None) -> dict:
    """K3-K5: whether it parses, the subset's verdict, missing nodes, and the body's references with their targets."""
    root = parsed(xml)
    if root is None:
        return {"well_formed": False, "schema_valid": False, "schema_errors": ["XML"], "missing_nodes": [], "passed_refs": [], "missing_refs": [], "n_refs": 0}
    names, ids = {_name(n) for n in root.iter()}, {n.get("id") for n in root.iter()}
    refs = [x.get("rid", "") for b in root.iter() if _name(b) == "body" for x in b.iter() if _name(x) == "xref" and x.get("ref-type") in KINDS]
    missing = [r for rid in refs for r in rid.split() if r not in ids]
    errors = schema_errors(root)
    return {
        "well_formed": True, "schema_valid": not errors, "schema_errors": errors, "missing_nodes": [n for n in REQUIRED if n not in names],
        "passed_refs": list(dict.fromkeys(rid for rid in refs if all(r in ids for r in rid.split()))), "missing_refs": list(dict.fromkeys(missing)), "n_refs": len(refs),
    }


@arrow("struct<well_formed:boolean,schema_valid:boolean,schema_errors:array<string>,missing_nodes:array<string>,passed_refs:array<string>,missing_refs:array<string>,n_refs:int>")
def checks(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([checked(x) for x in xml], columns=["well_formed", "schema_valid", "schema_errors", "missing_nodes", "passed_refs", "missing_refs", "n_refs"])


def xref_messages(found: Column) -> tuple[Column, Column]:
    """K5: warnings and checks of the body's references, as texts that later rules read."""
    none = F.when(found["n_refs"] == 0, F.array(F.lit("未检测到正文交叉引用。"))).otherwise(F.array().cast("array<string>"))
    passed = F.transform(found["passed_refs"], lambda r: F.concat(F.lit("交叉引用检查通过："), r, F.lit("。")))
    return F.transform(found["missing_refs"], lambda r: F.concat(F.lit("交叉引用目标不存在："), r, F.lit("。"))), F.concat(none, passed)


def source_messages(spans: Column) -> tuple[Column, Column]:
    """Warnings and checks of references resolved in the source's paragraphs, each once, in order."""
    parent = lambda r: F.regexp_extract(r, r"^((?i:fig)\d+)[A-Za-z]$", 1)
    moved = F.transform(spans, lambda s: F.transform(s["normalized_from"], lambda r: F.concat(F.lit("交叉引用已归一化："), r, F.lit(" -> "), parent(r), F.lit("。"))))
    review = F.transform(spans, lambda s: F.when(F.size(s["missing_targets"]) > 0, F.array(F.concat(F.lit("交叉引用需要人工复核："), s["text"], F.lit(" 缺少目标 "), F.array_join(s["missing_targets"], " "), F.lit("。")))).otherwise(F.array().cast("array<string>")))
    missing = F.flatten(F.transform(spans, lambda s: F.transform(s["missing_targets"], lambda r: F.concat(F.lit("交叉引用目标不存在："), r, F.lit("。")))))
    return F.array_distinct(missing), F.array_distinct(F.flatten(F.zip_with(moved, review, lambda a, b: F.concat(a, b))))
