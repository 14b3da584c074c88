"""Generated against official JATS: facts of both, metrics, dimensions, differences and their report.

Facts are read by one Arrow function a document; counting, set and bag scores, weights, rounding and differences are Column
expressions. Similarities that are defined by the sequence matcher of the standard library stay there, in one Arrow
function (its own rule of popular elements decides them). Malformed XML has no facts and is not available.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._udf import arrow

# Fixed values.
KEY_TAGS = ["article-title", "abstract", "kwd", "sec", "fig", "table-wrap", "disp-formula", "ref", "xref"]
WEIGHTS = {"metadata": 20, "structure": 25, "figures_tables": 15, "formulas": 10, "references": 15, "xrefs": 10, "compliance": 5}
METRICS = {
    "metadata": ["title", "abstract", "keywords", "authors", "affiliations"], "structure": ["section_titles", "section_levels"],
    "figures_tables": ["figure_count", "figure_caption", "figure_section", "table_count", "table_caption", "table_section"],
    "formulas": ["formula_count", "formula_content", "formula_section"], "references": ["references"], "xrefs": ["xref_count", "xref_targets"], "compliance": ["xml_well_formed"],
}
PUNCTUATION = r"[\s　,.;:!?，。；：！？'\"“”‘’()（）\[\]【】]+"
SUGGESTIONS = {
    "title": "Review front-matter title detection.", "abstract": "Review abstract markers and continuation paragraphs.", "keywords": "Review keyword markers, adjacent values, and separators.",
    "authors": "Review contributor detection and name normalization.", "affiliations": "Review affiliation markers and author-affiliation grouping.",
    "section_titles": "Review heading detection, exclusions, and document order.", "section_levels": "Recover heading levels and generate nested sec elements.",
    "figure": "Review media classification, captions, and section binding.", "table": "Review table captions, extraction, and section binding.",
    "formula": "Prefer OMML evidence and reduce plain-text formula false positives.", "references": "Review reference boundaries, continuations, and structured parsing.",
    "xref": "Expand compound references and verify every rid target.", "xml_well_formed": "Repair XML syntax before structural comparison.",
}
OTHERWISE = "Review the generated JATS structure."
FACTS = """struct<available:boolean,title:string,abstract:string,keywords:array<string>,authors:array<string>,affiliations:array<string>,doi:string,journal_id:string,
section_titles:array<string>,section_levels:array<string>,figure_caption:array<string>,figure_section:array<string>,table_caption:array<string>,table_section:array<string>,
formula_content:array<string>,formula_section:array<string>,references:array<struct<label:string,text:string,title:string,doi:string,year:string>>,
xrefs:array<struct<type:string,rid:string,text:string>>,counts:map<string,int>>"""
LISTS = ["keywords", "authors", "affiliations", "section_titles", "section_levels", "figure_caption", "figure_section", "table_caption", "table_section", "formula_content", "formula_section", "references", "xrefs"]


def _name(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _kids(node: ET.Element | None, *names: str) -> list[ET.Element]:
    return [c for c in node if _name(c) in names] if node is not None else []


def _down(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in node.iter() if c is not node and _name(c) == name] if node is not None else []


def _first(found: list[ET.Element]) -> ET.Element | None:
    return found[0] if found else None


def text_of(node: ET.Element | None) -> str:
    """The trimmed text parts, a space between."""
    return re.sub(r"\s+", " ", " ".join(p.strip() for p in node.itertext() if p.strip())).strip() if node is not None else ""


def _labelled(node: ET.Element, name: str) -> str:
    return " ".join(filter(None, (text_of(_first(_kids(node, "label"))), text_of(_first(_kids(node, name))))))


def formula_text(node: ET.Element) -> str:
    """The label and the MathML, else the first other form, else the TeX."""
    forms = _first(_kids(node, "alternatives"))
    inside = list(forms) if forms is not None else []
    direct = _kids(node, "math", "tex-math")
    rank = [c for c in inside + direct if _name(c) == "math"] + [c for c in inside if _name(c) not in ("math", "tex-math")] + [c for c in inside + direct if _name(c) == "tex-math"]
    return " ".join(filter(None, (text_of(_first(_kids(node, "label"))), text_of(_first(rank)))))


def facts_of(xml: str | None) -> dict:
    """What a document says, and how often each key tag stands in it."""
    out = {"available": False, "title": "", "abstract": "", "doi": "", "journal_id": "", "counts": dict.fromkeys(KEY_TAGS, 0)} | {k: [] for k in LISTS}
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*>", "", xml or ""))
    except (ET.ParseError, ValueError):
        return out
    front, body, back = (_first(_kids(root, n)) for n in ("front", "body", "back"))
    meta, journal = _first(_kids(front, "article-meta")), _first(_kids(front, "journal-meta"))
    one = lambda nodes: text_of(_first(nodes))
    with_type = lambda nodes, key, value: [n for n in nodes if n.get(key) == value]
    section_of: dict[ET.Element, str] = {}

    def visit(node: ET.Element, level: int, heading: str) -> None:
        for c in node:
            section_of[c] = heading
            if _name(c) == "sec":
                own = _labelled(c, "title")
                if _name(node) in ("body", "sec"):
                    out["section_titles"].append(own)
                    out["section_levels"].append(str(level))
                visit(c, level + 1, own)
            else:
                visit(c, level, heading)

    if body is not None:
        visit(body, 1, "")
    authors = [c for g in _kids(meta, "contrib-group") for c in with_type(_kids(g, "contrib"), "contrib-type", "author")]
    names = [" ".join(filter(None, (one(_down(c, "given-names")), one(_down(c, "surname"))))) or one(_down(c, "collab")) for c in authors]
    out |= {
        "available": True, "title": one([t for g in _kids(meta, "title-group") for t in _kids(g, "article-title")]), "abstract": one(_kids(meta, "abstract")),
        "keywords": [t for k in _down(meta, "kwd") if (t := text_of(k))], "authors": [n for n in names if n], "affiliations": [t for a in _kids(meta, "aff") if (t := text_of(a))],
        "doi": one(with_type(_kids(meta, "article-id"), "pub-id-type", "doi")), "journal_id": one(_kids(journal, "journal-id")),
        "references": [{
            "label": one(_kids(r, "label")), "text": text_of(r), "title": one([t for e in _down(r, "element-citation") for t in _kids(e, "article-title")]),
            "doi": one(with_type(_down(r, "pub-id"), "pub-id-type", "doi")), "year": one(_down(r, "year")),
        } for group in _down(back, "ref-list") for r in _kids(group, "ref")],
        "xrefs": [{"type": x.get("ref-type", ""), "rid": rid, "text": text_of(x)} for x in _down(body, "xref") for rid in (x.get("rid", "").split() or [""])],
    }
    for kind, tag in (("figure", "fig"), ("table", "table-wrap")):
        found = _down(body, tag)
        out[f"{kind}_caption"], out[f"{kind}_section"] = [one(_kids(f, "caption")) for f in found], [section_of[f] for f in found]
    formulas = _down(body, "disp-formula")
    out["formula_content"], out["formula_section"] = [formula_text(f) for f in formulas], [section_of[f] for f in formulas]
    tags = [_name(n) for n in root.iter()]
    out["counts"] = {t: tags.count(t) for t in KEY_TAGS}
    return out


@arrow(FACTS)
def jats_facts(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts_of(x) for x in xml])


def normalized(text: Column) -> Column:
    """Lower case without spaces and punctuation."""
    return F.regexp_replace(F.lower(text), PUNCTUATION, "")


def normalized_heading(text: Column) -> Column:
    """Without bullets and numbering."""
    bare = F.regexp_replace(F.trim(text), r"^[●•\-–—]+\s*", "")
    return normalized(F.regexp_replace(bare, r"^\d+(?:\.\d+)*\.?\s*", ""))


def reference_label(label: Column) -> Column:
    """The digits of a label, else the label."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"(\d+)", 1), F.lit("")), label)


def xref_key(x: Column) -> Column:
    """The type and the number of the target or of the text, without leading zeros; else the text."""
    number = F.coalesce(F.nullif(F.regexp_extract(x["rid"], r"(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(x["text"], r"(\d+)", 1), F.lit("")))
    return F.concat(x["type"], F.lit(":"), F.coalesce(F.regexp_replace(number, r"^0+(?=\d)", ""), normalized(x["text"])))


def f1(both: Column, left: Column, right: Column) -> Column:
    """2PR / (P + R) of an overlap; both empty 1, one empty 0."""
    return F.when((left == 0) & (right == 0), 1.0).when((left == 0) | (right == 0), 0.0).otherwise(2.0 * both / (left + right))


def set_score(left: Column, right: Column) -> Column:
    """Distinct normalised values."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, normalized), lambda v: v != ""))
    return f1(F.size(F.array_intersect(clean(left), clean(right))), F.size(clean(left)), F.size(clean(right)))


def token_score(left: Column, right: Column) -> Column:
    """Distinct words of any script."""
    tokens = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)))
    return f1(F.size(F.array_intersect(tokens(left), tokens(right))), F.size(tokens(left)), F.size(tokens(right)))


def bag_score(left: Column, right: Column) -> Column:
    """A value counts as often as it stands on both sides."""
    times = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    both = F.aggregate(F.array_distinct(left), F.lit(0), lambda s, v: s + F.least(times(left, v), times(right, v)))
    return f1(both, F.size(left), F.size(right))


def count_score(left: Column, right: Column) -> Column:
    """D20."""
    return F.when((left == 0) & (right == 0), 1.0).otherwise(F.least(left, right) / F.greatest(left, right, F.lit(1)))


def ratio(a, b) -> float:
    return 1.0 if not a and not b else 0.0 if not a or not b else SequenceMatcher(None, a, b).ratio()


@arrow("double")
def text_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Of two texts."""
    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype=float)


@arrow("double")
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Of two lists, element by element."""
    return pd.Series([SequenceMatcher(None, list(a), list(b)).ratio() for a, b in zip(left, right)], dtype=float)


@arrow("double")
def heading_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Of two lists of headings: as a sequence, or place by place, whichever is more."""

    def score(a: list[str], b: list[str]) -> float:
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        placed = sum(SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)) / max(len(a), len(b))
        return max(SequenceMatcher(None, list(a), list(b)).ratio(), placed)

    return pd.Series([score(a, b) for a, b in zip(left, right)], dtype=float)


@arrow("double")
def placed_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """I-th against i-th; what one side lacks counts 0."""
    return pd.Series([sum(ratio(x, y) for x, y in zip(a, b)) / max(len(a), len(b)) if len(a) or len(b) else 1.0 for a, b in zip(left, right)], dtype=float)


@arrow("double")
def nearest_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Each of the left takes the most similar one left of the right; the first of equals; the rest counts 0."""

    def score(a: list[str], b: list[str]) -> float:
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        rest, total = list(b), 0.0
        for x in a:
            if rest:
                near = [ratio(x, y) for y in rest]
                best = max(near)
                total += best
                rest.pop(near.index(best))
        return total / max(len(a), len(b))

    return pd.Series([score(a, b) for a, b in zip(left, right)], dtype=float)


@arrow("double")
def reference_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """I-th against i-th by words, or by label, DOI, year and title, whichever is more; half of it by how many there are."""

    def words(t: str) -> set[str]:
        return set(re.findall(r"\w+", t.casefold()))

    def pair(x: dict, y: dict) -> float:
        parts = [ratio(x["label"], y["label"])] + [ratio(x[f], y[f]) for f in ("doi", "year", "title") if x[f] or y[f]]
        a, b = words(x["text"]), words(y["text"])
        by_words = 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        return max(by_words, sum(parts) / len(parts))

    def score(a, b) -> float:
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        most = max(len(a), len(b))
        return (min(len(a), len(b)) / most + sum(pair(x, y) for x, y in zip(a, b)) / most) / 2

    return pd.Series([score(a, b) for a, b in zip(left, right)], dtype=float)


def _clean(array: Column) -> Column:
    return F.transform(array, normalized)


def compared(pairs: DataFrame, generated: str = "generated", official: str = "official") -> DataFrame:
    """The pairs' rows with available, metrics, dimensions, similarity_score and differences. A pair
    with a side that does not parse is not available and scores 0."""
    rows = pairs.withColumn("g", jats_facts(generated)).withColumn("o", jats_facts(official))
    g, o = (lambda f: F.col(f"g.{f}")), (lambda f: F.col(f"o.{f}"))
    entry = lambda a: F.transform(a, lambda r: F.struct(normalized(reference_label(r["label"])).alias("label"), *(normalized(r[f]).alias(f) for f in ("doi", "year", "title")), r["text"].alias("text")))
    keys = lambda a: F.transform(a, xref_key)
    metrics = {
        "title": text_ratio(normalized(g("title")), normalized(o("title"))), "abstract": text_ratio(normalized(g("abstract")), normalized(o("abstract"))), "keywords": set_score(g("keywords"), o("keywords")),
        "section_titles": heading_ratio(F.transform(g("section_titles"), normalized_heading), F.transform(o("section_titles"), normalized_heading)),
        "section_levels": F.when((F.size(g("section_levels")) == 0) & (F.size(o("section_levels")) == 0), 1.0).otherwise(sequence_ratio(g("section_levels"), o("section_levels"))),
        "references": reference_ratio(entry(g("references")), entry(o("references"))), "xref_count": count_score(F.size(g("xrefs")), F.size(o("xrefs"))),
        "xref_targets": bag_score(keys(g("xrefs")), keys(o("xrefs"))), "xml_well_formed": g("available").cast("double"),
    }
    metrics |= {m: nearest_ratio(_clean(g(m)), _clean(o(m))) for m in ("authors", "affiliations")}
    metrics |= {f"{k}_count": count_score(F.size(g(f)), F.size(o(f))) for k, f in (("figure", "figure_caption"), ("table", "table_caption"), ("formula", "formula_content"))}
    metrics |= {m: placed_ratio(_clean(g(m)), _clean(o(m))) for m in ("figure_caption", "figure_section", "table_caption", "table_section", "formula_content", "formula_section")}
    for name, value in metrics.items():
        rows = rows.withColumn(f"m_{name}", value)
    dimensions = {d: F.bround(100 * sum((F.col(f"m_{m}") for m in ms), F.lit(0.0)) / len(ms), 0).cast("int") for d, ms in METRICS.items()}
    both = F.col("g.available") & F.col("o.available")
    rows = rows.withColumn("dimensions", F.struct(*(c.alias(d) for d, c in dimensions.items())))
    total = sum((F.col(f"dimensions.{d}") * w for d, w in WEIGHTS.items()), F.lit(0)) / sum(WEIGHTS.values())
    named = lambda m: F.struct(F.lit("warning").alias("level"), F.lit("recoverable").alias("category"), F.lit(m).alias("metric"), F.lit(suggestion(m)).alias("suggestion"))
    recoverable = [F.when(F.col(f"m_{m}") < 0.999, named(m)) for ms in METRICS.values() for m in ms]
    enriched = [F.when((g(m) == "") & (o(m) != ""), F.struct(F.lit("info").alias("level"), F.lit("publisher_enriched").alias("category"), F.lit(m).alias("metric"), F.lit("Supply this publisher-enriched value through the correction form or profile.").alias("suggestion"))) for m in ("doi", "journal_id")]
    return rows.select(
        *pairs.columns, both.alias("available"), F.struct(*(F.bround(100 * F.col(f"m_{m}"), 0).cast("int").alias(m) for ms in METRICS.values() for m in ms)).alias("metrics"), "dimensions",
        F.when(both, F.bround(total, 0).cast("int")).otherwise(0).alias("similarity_score"), F.array_compact(F.array(*recoverable, *enriched)).alias("differences"),
        F.col("g.counts").alias("generated_counts"), F.col("o.counts").alias("official_counts"),
    )


def suggestion(metric: str) -> str:
    """By the metric, else by what it is of."""
    return SUGGESTIONS.get(metric) or SUGGESTIONS.get(metric.split("_")[0], OTHERWISE)


def summary(results: DataFrame, score: str = "similarity_score", valid: str = "schema_valid") -> DataFrame:
    """One row: how many, the mean to 1 place, the least, the share that is valid to 4; zeros for none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return results.agg(
        F.count("*").alias("sample_count"), zero(F.bround(F.avg(score), 1)).alias("average_score"), zero(F.min(score)).alias("minimum_score"),
        zero(F.bround(F.avg(F.coalesce(F.col(valid), F.lit(False)).cast("int")), 4)).alias("schema_pass_rate"),
    )


def accepted(summaries: DataFrame, average: float = 94, minimum: float = 90, rate: float = 1.0) -> DataFrame:
    """The summaries that reach all three floors; none is no sample."""
    return summaries.filter((F.col("sample_count") > 0) & (F.col("average_score") >= average) & (F.col("minimum_score") >= minimum) & (F.col("schema_pass_rate") >= rate))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 90, "success").when(score >= 80, "warning").otherwise("danger")
