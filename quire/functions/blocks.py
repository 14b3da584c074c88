"""Predicates and projections of document blocks: what kind of paragraph a text is.

Patterns and word lists are fixed values: the conversion rules of the studied system name them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SECTION = r"^(?:\d+(?:\.\d+)*[\s、.]+.+|[一二三四五六七八九十]+、\s*.+|[（(][一二三四五六七八九十]+[）)]\s*.+)$"
LIST = r"^\s*(?:[（(]\d+[）)]|\d+[）)]|[-•·])\s*"
MATH = r"(?i)(=|≈|≤|≥|∑|∫|√|[αβγλμσ]|\\?frac|\\?sqrt|\blim\b|\blog\b|\bsin\b|\bcos\b)"
CAPTION = r"(?i)^\s*(图|表|fig(?:ure)?|table|scheme)\.?\s*(\d+(?:\s*[-–—]\s*\d+)*)([.:：])?(?:\s+(.*))?$"
NARRATIVE = ["shows", "show", "provides", "provide", "depicts", "depict", "presents", "present", "summarizes", "summarise", "illustrates", "illustrate", "demonstrates", "demonstrate", "compares", "compare", "reports", "report", "indicates", "indicate"]
EQUATION_NUMBER = r"\(\s*\d+\s*\)"
IMAGE_CONTEXT = r"(?i)\b(?:coefficient|constant|equilibrium|equation|expression|extraction|formula|percentage|ratio)\b"
GIVEN_BY = r"(?i)(?:calculated|defined|expressed|represented|given)\s+by\s*:?$"
TABLE_NOTE = r"(?i)^\s*(?:note|notes|abbreviations|注|说明)\s*[.:：]"
SUBHEADINGS = ["limitations", "strengths and limitations", "limitations and future directions", "future directions", "main findings", "principal findings", "key findings"]
BACK_HEADINGS = [
    "funding", "funding information", "conflict of interest", "conflicts of interest", "competing interests", "author contributions", "authors' contributions", "ethics approval", "ethical approval",
    "data availability", "data availability statement", "acknowledgments", "acknowledgements", "informed consent statement", "institutional review board statement", "abbreviations",
    "abbreviations and acronyms", "availability of data and materials", "graphical abstract",
]
EXACT_BACK_HEADINGS = ["abbreviations", "abbreviations and acronyms", "availability of data and materials"]
AFFILIATION_NOUNS = [
    "大学", "学院", "研究院", "实验室", "中心", "医院", "系", "部", "school", "university", "institute", "laboratory", "center", "department", "faculty", "hospital", "college", "academy",
    "independent researcher",
]
ABSTRACT = r"(?i)^\s*(摘要|摘\s*要|abstract)\s*[:：]?\s*"
KEYWORDS = r"(?i)^\s*(关键词|关\s*键\s*词|key\s*words?|keywords)\s*[:：]?\s*"
REFERENCES = r"(?i)^\s*(?:参考\s*文献|references?(?:\s*(?:and|&)\s*notes?)?)\s*[:：]?\s*$"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def digit_share(text: Column) -> Column:
    """Digits over the characters that are not blank."""
    return F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"\s+", "")))


def caption_parts(text: Column) -> Column:
    """kind, number, separator, body of a float caption; empty where it is none."""
    part = lambda k: F.regexp_extract(text, CAPTION, k)
    return F.struct(F.lower(part(1)).alias("kind"), part(2).alias("number"), part(3).alias("separator"), F.trim(part(4)).alias("body"))


def is_float_caption(text: Column, style: Column, kind: str) -> Column:
    """A caption of this kind ("figure" or "table"), not prose that mentions one."""
    part = caption_parts(text)
    figure = part["kind"].isin("图", "fig", "figure", "scheme")
    first = F.regexp_replace(F.lower(F.get(F.split(part["body"], r"\s+"), F.lit(0))), "[.,;:]+$", "")
    named = F.lower(style).contains("caption") | part["kind"].isin("图", "表") | (part["separator"] != "")
    prose = first.isin(NARRATIVE) | ~part["body"].rlike(r"^\p{Lu}")
    return (part["kind"] != "") & (figure if kind == "figure" else ~figure) & (named | ~prose)


def is_plain_formula(text: Column) -> Column:
    """Short text that holds mathematics, or a numbered equation."""
    numbered = _has(text, EQUATION_NUMBER + r"(?:\s|$)") & (F.length(text) <= 240)
    named = _has(text, r"(?i)\b(?:equation|coefficient|constant|formula|ratio)\b")
    shape = _has(text, r"[=≈≤≥∑∫√＋−×÷^]") | _has(text, r"(?i)\\?(?:frac|sqrt)\s*[({]") | _has(text, r"(?i)\b(?:lim|log|sin|cos)\s*[_({]")
    return (F.length(text) <= 500) & ((numbered & (_has(text, MATH) | named)) | ((F.length(text) <= 100) & _has(text, MATH) & shape))


def is_formula_image(text: Column, style: Column) -> Column:
    """The text around an image says that it shows a formula."""
    t = squeezed(text)
    return (
        _has(t, rf"^{EQUATION_NUMBER}$")
        | ((F.length(t) <= 260) & ((_has(t, EQUATION_NUMBER) & _has(t, IMAGE_CONTEXT)) | F.lower(style).contains("equation")))
        | ((F.length(t) <= 180) & _has(t, r"(?i)\b(?:percentage|coefficient|constant|equation|formula)\b") & _has(t, GIVEN_BY))
    )


def is_unnumbered_heading(text: Column, bold: Column) -> Column:
    """Bold, 1 to 12 words, at most 100 characters, few digits, no closing stop."""
    n = F.size(words(text))
    return bold & (n >= 1) & (n <= 12) & (F.length(text) <= 100) & (digit_share(text) < 0.08) & ~_has(text, r"[.;:。；：]\s*$")


def is_heading(text: Column, style: Column, bold: Column) -> Column:
    """Numbered, styled or bold."""
    return _has(text, SECTION) | F.lower(style).startswith("heading") | _has(style, "^[1-6]$") | is_unnumbered_heading(text, bold)


def is_list(text: Column, numbered: Column) -> Column:
    """A Word list, or a list sign."""
    return numbered | _has(text, LIST)


def is_title_style(style: Column) -> Column:
    s = F.lower(style)
    return s.contains("title") & ~s.contains("type") | (s == "title")


def paragraph_type(text: Column, style: Column, bold: Column, numbered: Column) -> Column:
    """The first of these that holds."""
    formula = F.lower(style).contains("equation") | style.contains("公式") | is_plain_formula(text)
    return (
        F.when(is_title_style(style), "title").when(is_float_caption(text, style, "figure"), "figure_caption").when(is_float_caption(text, style, "table"), "table_caption")
        .when(is_heading(text, style, bold), "heading").when(is_list(text, numbered), "list").when(formula, "formula").otherwise("paragraph")
    )


def is_display_math(math_paragraph: Column, other_text: Column, alignment: Column, text: Column) -> Column:
    """B2: a formula that stands alone: a math paragraph, nothing else beside it, or numbered and set apart."""
    numbered = _has(text, EQUATION_NUMBER)
    return math_paragraph | (F.trim(other_text) == "") | (numbered & (F.lower(alignment).isin("right", "center") | is_plain_formula(text)))


def block_type(n_images: Column, n_math: Column, display: Column, text: Column, style: Column, bold: Column, numbered: Column) -> Column:
    """B1: images first, then mathematics, then the text."""
    images = F.when((n_images > 1) & (F.length(F.trim(text)) > 120), "paragraph").when(is_formula_image(text, style), "formula_image").otherwise("image")
    return F.when(n_images > 0, images).when(n_math > 0, F.when(display, "formula").otherwise("paragraph")).otherwise(paragraph_type(text, style, bold, numbered))


def is_implicit_table_caption(text: Column, keywords: str) -> Column:
    """3 to 35 words, at most 300 characters, a keyword, no citation."""
    n = F.size(words(text))
    return n.between(3, 35) & (F.length(text) <= 300) & _has(text, keywords) & ~_has(text, r"\[\s*\d+")


def is_figure_legend(rows: Column) -> Column:
    """A table of at most 4 rows and 3 columns with short cells, one at least."""
    cells = F.filter(F.flatten(rows), lambda c: F.trim(c) != "")
    return (F.size(rows) <= 4) & F.forall(rows, lambda r: F.size(r) <= 3) & (F.size(cells) > 0) & F.forall(cells, lambda c: F.length(F.trim(c)) <= 80)


def is_table_note(text: Column) -> Column:
    """The text's part of the rule; that a table precedes is the caller's."""
    return (F.length(text) <= 800) & _has(text, TABLE_NOTE)


def normalized_heading(text: Column) -> Column:
    """Spaces collapsed, stops and colons stripped, lower case."""
    return F.lower(F.regexp_replace(squeezed(text), r"^[ .:]+|[ .:]+$", ""))


def section_label(text: Column) -> Column:
    """The numbering that a heading begins with."""
    return F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*|[一二三四五六七八九十]+(?=、)|[（(][一二三四五六七八九十]+[）)])", 1)


def is_back_heading(text: Column, headings: list[str] = BACK_HEADINGS, exact: list[str] = EXACT_BACK_HEADINGS) -> Column:
    """A publisher's closing heading, alone or before a colon; the exact ones only alone."""
    t = normalized_heading(text)
    prefix = F.trim(F.get(F.split(t, ":"), F.lit(0)))
    return t.isin(headings) | (t.contains(":") & prefix.isin([h for h in headings if h not in exact]))


def style_level(style: Column) -> Column:
    """1 to 6 from a style's name, else 0."""
    level = F.regexp_extract(style, r"(?i)^(?:(?:heading|标题)\s*)?([1-6])$", 1)
    return F.coalesce(F.nullif(level, F.lit("")).cast("int"), F.lit(0))


def section_title(text: Column, style: Column, kind: Column, conventional: list[str] = SUBHEADINGS) -> Column:
    """Label, title and level of a section heading; level 0 where it is none."""
    arabic, chinese, bracketed = r"^(\d{1,2}(?:\.\d+)*)(?:\.\s+|[\s、.]+)(\S.*)$", r"^([一二三四五六七八九十]+)、\s*(.+)$", r"^[（(]([一二三四五六七八九十]+)[）)]\s*(.+)$"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    short = lambda t: (F.length(t) <= 220) & (F.size(words(t)) <= 30) & _has(t, r"\p{L}")
    numbered = short(part(arabic, 2)) & (digit_share(part(arabic, 2)) < 0.15)
    from_style, whole = style_level(style), F.trim(text)

    def case(number: Column, cn: Column, br: Column, none: Column) -> Column:
        return F.when(numbered, number).when(short(part(chinese, 2)), cn).when(short(part(bracketed, 2)), br).otherwise(none)

    plain = (
        F.when(_has(text, r"^\d+(?:\.\d+)*\s+"), 0).when(normalized_heading(text).isin(conventional), F.when(from_style > 0, from_style).otherwise(2))
        .when(short(text), F.when(from_style > 0, from_style).when(kind == "heading", 1).otherwise(0)).otherwise(0)
    )
    return F.struct(
        case(part(arabic, 1), part(chinese, 1), part(bracketed, 1), F.lit("")).alias("label"),
        F.trim(case(part(arabic, 2), part(chinese, 2), part(bracketed, 2), whole)).alias("title"),
        case(F.size(F.split(part(arabic, 1), r"\.")), F.lit(1), F.lit(2), plain).cast("int").alias("level"),
    )


def is_affiliation(text: Column, style: Column, nouns: list[str] = AFFILIATION_NOUNS) -> Column:
    """An affiliation's style, one of its nouns, or numbered with two commas."""
    listed = _has(text, r"^\s*(?:\d+|[a-z])(?=[A-ZÀ-ɏ])") & (F.length(F.trim(text)) >= 20) & (F.regexp_count(text, F.lit(",")) >= 2)
    return F.lower(style).contains("affiliation") | _has(F.lower(text), "|".join(nouns)) | listed


def is_unlabeled_reference(text: Column) -> Column:
    """Begins with an author, holds a year and a volume with issue or pages."""
    return _has(text, r"^\p{Lu}[\p{L}'’-]+,?\s+(?:\p{Lu}\.?\s*){1,3}") & _has(text, r"\b(?:19|20)\d{2}\b") & _has(text, r"\d+\s*\(\s*\d+\s*\)\s*[:：]\s*\d+")


def is_reference_continuation(text: Column) -> Column:
    """A link or DOI alone, or a journal with a year."""
    return _has(text, r"(?i)^\s*(?:https?://|doi\s*:|10\.\d{4,9}/)") | (_has(text, r"(?i)^\s*(?:journal|j\.|proceedings|proc\.|annals|transactions)\b") & _has(text, r"\b(?:19|20)\d{2}\b"))


def profile_type(text: Column, kind: Column, style: Column, figures: Column, tables: Column) -> Column:
    """A block that a profile's patterns name a caption, where it looks like one of that kind."""
    captions = kind.isin("figure_caption", "table_caption")
    named = lambda patterns, of: F.exists(patterns, lambda p: F.rlike(text, F.concat(F.lit("(?i)"), p))) & (captions | is_float_caption(text, style, of))
    return F.when(named(figures, "figure"), "figure_caption").when(named(tables, "table"), "table_caption").otherwise(kind)


#: H36, fixed values: a table whose header names all of these is known.
KNOWN_HEADER = ["linear", "equation", "diluent", "logd", "ph"]
KNOWN_CAPTION = "Linear regression equations of log D versus pH in different diluents."


def inferred_caption(caption: Column, rows: Column) -> Column:
    """The caption of a table without one, if its header tells it."""
    header = F.lower(F.regexp_replace(F.array_join(F.get(rows, F.lit(0)), ""), r"\s+", ""))
    known = F.forall(F.array(*map(F.lit, KNOWN_HEADER)), lambda w: F.contains(header, w))
    return F.when((caption == "") & (F.size(rows) > 0) & known, KNOWN_CAPTION).otherwise(caption)


#: B23, fixed values: node type to JATS path and tag.
JATS_PATHS = {
    "title": ("front/article-meta/title-group", "article-title"), "author": ("front/article-meta/contrib-group", "contrib"), "affiliation": ("front/article-meta", "aff"),
    "abstract": ("front/article-meta", "abstract"), "keywords": ("front/article-meta", "kwd-group"), "heading": ("body", "sec/title"), "paragraph": ("body/sec", "p"),
    "list": ("body/sec", "list"), "figure_caption": ("body/sec/fig", "caption"), "image": ("body/sec/fig", "graphic"), "table_caption": ("body/sec/table-wrap", "caption"),
    "table": ("body/sec/table-wrap", "table"), "formula": ("body/sec", "disp-formula"), "formula_image": ("body/sec/disp-formula", "graphic"), "reference": ("back/ref-list", "ref"), "unknown": ("body/sec", "p"),
}


def jats_path(kind: Column) -> Column:
    """Path and tag of a node type."""
    path, tag = (F.create_map(*(F.lit(x) for k, v in JATS_PATHS.items() for x in (k, v[i]))) for i in (0, 1))
    known = F.when(kind.isin(list(JATS_PATHS)), kind).otherwise("unknown")
    return F.struct(path[known].alias("path"), tag[known].alias("tag"))


def default_confidence(kind: Column) -> Column:
    """Confidence in hundredths and status, where the parser gave none."""
    metadata = ["title", "author", "affiliation", "abstract", "keywords"]
    value = F.when(kind == "unknown", 35).when(kind.isin(metadata), 98).otherwise(88)
    return F.struct(value.alias("confidence"), F.when(kind == "unknown", "need_review").otherwise("ok").alias("status"))
