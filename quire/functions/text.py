"""Text functions: names, previews, captions, values, numbers, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_filename(name: Column, default: str = "document.docx") -> Column:
    last = F.regexp_replace(F.element_at(F.split(name, "/"), -1), "[^A-Za-z0-9._-]", "_")
    return F.when(F.length(last) > 0, last).otherwise(F.lit(default))


def preview(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != ""))


def caption_label(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*((?:Figure|Fig\.?|Table)\s*[0-9]+)", 1)


def caption_body(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s*((?:Figure|Fig\.?|Table)\s*[0-9]+)", ""), r"^[\s.:：．-]+|\s+$", "")


def caption_number(text: Column) -> Column:
    return F.regexp_extract(text, "([0-9]+)", 1)
