"""Names, affiliations, labels and titles as they go into JATS, and captions and formulas as editors see them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._udf import arrow

# Fixed values.
FIGURE_LABEL = r"(?i)^\s*((?:fig(?:ure)?\.?|scheme)\s*\d+(?:[-.]\d+)?|图\s*\d+(?:[-－.]\d+)?)\s*[:：.．-]?\s*"
TABLE_LABEL = r"(?i)^\s*(table\s*\d+(?:[-.]\d+)?|表\s*\d+(?:[-－.]\d+)?)\s*[:：.．-]?\s*"
MARKERS = "[⁰¹²³⁴⁵⁶⁷⁸⁹*†‡]+$"
DEGREES = r"(?i)\b(?:ph\.?\s?d|m\.?\s?d|m\.?\s?sc|b\.?\s?sc|mph|frcs|mba)\b\.?"
ABSTRACT_TAIL = r"(?is)(?:\s|^)\(?\s*(?:received|revised|accepted|published|copyright)\b.*$"
NO_TRIAL = r"(?i)(?:\s|^)clinical\s+trial\s+registration\s*:\s*not\s+applicable\.?\s*$"


def caption_split(text: Column, kind: Column) -> Column:
    """H1: label, caption and status of a caption: unchanged without a label, for review without a body."""
    t = F.trim(text)

    def by(pattern: str) -> Column:
        label, body = F.rtrim(F.trim(F.regexp_extract(t, pattern, 1)), F.lit(".:：．-")), F.trim(F.regexp_replace(t, pattern, ""))
        status = F.when(label == "", "unchanged").when(body == "", "need_review").otherwise("normalized")
        return F.struct(label.alias("label"), F.when(label == "", t).otherwise(body).alias("caption"), status.alias("status"))

    return F.when(kind == "figure", by(FIGURE_LABEL)).otherwise(by(TABLE_LABEL))


def contributor(name: Column) -> Column:
    """H2: a name without the markers behind it, the original, the markers, and whether it changed."""
    t = F.trim(name)
    marks = F.regexp_extract(t, f"({MARKERS})", 1)
    return F.struct(
        F.when(marks != "", F.rtrim(F.regexp_replace(t, MARKERS, ""))).otherwise(t).alias("name"), F.when(marks != "", t).otherwise("").alias("original_name"),
        F.regexp_extract_all(marks, F.lit("."), F.lit(0)).alias("markers"), F.when(marks != "", "normalized").otherwise("unchanged").alias("status"),
    )


def author_names(text: Column, labels: list[str]) -> Column:
    """H3: the names of an author line: degrees and markers go; 2 to 4 Chinese characters, or 2 to 6 words of up to 80
    characters; none where the line is one of the labels; in order, distinct."""
    plain = F.regexp_replace(F.regexp_replace(text, DEGREES, ""), r"(?i)\s+(?:and|&)\s+", ",")
    names = F.transform(F.split(plain, r"[,，;；、]+|(?<=[一-鿿])\s+(?=[一-鿿])"), lambda n: F.trim(F.regexp_replace(F.trim(n), r"^[\d*†‡⁰¹²³⁴⁵⁶⁷⁸⁹\s]+|[\d*†‡⁰¹²³⁴⁵⁶⁷⁸⁹\s.]+$", "")))
    n_words = lambda n: F.size(F.split(n, r"\s+"))
    sound = lambda n: n.rlike("^[一-鿿]{2,4}$") | (n_words(n).between(2, 6) & (F.length(n) <= 80) & n.rlike(r"^\p{Lu}") & ~n.rlike(r"[0-9@:]"))
    label = F.lower(F.regexp_replace(F.trim(text), r"[\s.:：]+$", "")).isin(labels)
    return F.when(label, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(names, sound)))


def split_values(text: Column) -> Column:
    """H4."""
    return F.filter(F.transform(F.split(text, "[；;，,、:：]+"), lambda v: F.trim(v)), lambda v: v != "")


def clean_abstract(text: Column) -> Column:
    """H5: without dates of publication at its end, and without a trial registration that does not apply."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), ABSTRACT_TAIL, ""), NO_TRIAL, ""))


def name_parts(name: Column) -> Column:
    """H6: surname and given names: the first character of a Chinese name, else all is given."""
    chinese = name.rlike("^[一-鿿]+$")
    return F.struct(F.when(chinese, F.substring(name, 1, 1)).otherwise("").alias("surname"), F.when(chinese, F.substring(name, 2, 1000)).otherwise(name).alias("given"))


def affiliation_parts(text: Column, index: Column) -> Column:
    """H7: the label before an affiliation, a number or a letter, else its place; and its body."""
    label = r"^(\d+|[a-z])(?:[\s.)、:：-]+|(?=[A-Z]))(.+)$"
    t = F.trim(text)
    return F.struct(F.when(t.rlike(label), F.regexp_extract(t, label, 1)).otherwise(index.cast("string")).alias("label"), F.when(t.rlike(label), F.trim(F.regexp_extract(t, label, 2))).otherwise(t).alias("body"))


def section_parts(label: Column, title: Column, level: Column, top: Column) -> Column:
    """A section's label and title: its own label, one before the title, or its number among level-1 sections."""
    own, t = F.trim(F.coalesce(label, F.lit(""))), F.trim(title)
    rest = F.when(F.startswith(t, own), F.trim(F.regexp_replace(F.substr(t, F.length(own) + 1), r"^[\s.)、:：-]+", ""))).otherwise(t)
    numbered = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
    return (
        F.when(own != "", F.struct(own.alias("label"), rest.alias("title"))).when(t.rlike(numbered), F.struct(F.regexp_extract(t, numbered, 1).alias("label"), F.trim(F.regexp_extract(t, numbered, 2)).alias("title")))
        .when(level == 1, F.struct(F.concat(top.cast("string"), F.lit(".")).alias("label"), t.alias("title"))).otherwise(F.struct(F.lit("").alias("label"), t.alias("title")))
    )


def caption_identity(text: Column) -> Column:
    """H9: the kind (a scheme stands apart from other floats) and number of a caption."""
    number = F.lower(F.regexp_replace(F.regexp_extract(text, r"(\d+(?:\s*[-.]\s*\d+)?[A-Za-z]?)", 1), r"\s+", ""))
    return F.when(number == "", "").otherwise(F.concat(F.when(text.rlike(r"(?i)^\s*scheme\b"), "scheme:").otherwise("float:"), number))


def object_number(ident: Column) -> Column:
    """H9: the number at an id's end."""
    return F.lower(F.regexp_extract(ident, r"(?i)(\d+(?:[-.]\d+)?[a-z]?)$", 1))


def number_matches(ident: Column, caption: Column) -> Column:
    """An id's last digits are the caption's first."""
    own = F.regexp_extract(ident, r"(\d+)$", 1)
    return (own != "") & (own == F.regexp_extract(caption, r"(\d+)", 1))


def table_row(text: Column) -> Column:
    """Cells of a row in running text: parted by two spaces, or by any where all are numbers and signs."""
    wide = F.filter(F.split(F.trim(text), r"\s{2,}"), lambda c: c != "")
    cells = F.split(F.trim(text), r"\s+")
    return F.when((F.size(wide) < 2) & F.forall(cells, lambda c: c.rlike(r"^[\d.,%()±<>=/+–-]+$")), cells).otherwise(wide)


def display_text(*choices: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices), F.lit(""))


@arrow("double")
def _likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype=float)


def formula_form(content: Column, latex: Column, label: Column) -> Column:
    """Label, content and status of a formula's text: `(n)` at either end is its label, a copy of the LaTeX at its end
    goes, and where text and LaTeX have little in common the status is partial, with a conflict."""
    t = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    number = F.coalesce(F.nullif(F.regexp_extract(t, r"(\(\s*\d+\s*\))\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^(\(\s*\d+\s*\))", 1), F.lit("")), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"\(\s*\d+\s*\)\s*$", ""), r"^\(\s*\d+\s*\)", ""))
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    tex = squeeze(F.coalesce(latex, F.lit("")))
    copy = (tex != "") & F.endswith(squeeze(bare), tex) & (F.length(squeeze(bare)) > F.length(tex))
    # The text before the copy: as many characters that are not blank as come before it.
    before = F.length(squeeze(bare)) - F.length(tex)
    kept = F.call_function("regexp_extract", bare, F.concat(F.lit(r"^((?:\s*\S){"), F.greatest(before, F.lit(0)).cast("string"), F.lit("})")), F.lit(1))
    clean = F.when(copy, F.trim(kept)).otherwise(bare)
    letters = lambda x: F.lower(F.regexp_replace(x, r"[\s\\{}$]", ""))
    conflict = (clean != "") & (tex != "") & ~copy & (_likeness(letters(clean), letters(tex)) < 0.25)
    return F.struct(
        F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(F.regexp_replace(number, r"\s", "")).alias("label"), clean.alias("content"),
        F.when(conflict, "partial").when((clean != t), "normalized").otherwise("unchanged").alias("status"), conflict.alias("conflict"),
    )
