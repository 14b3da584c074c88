"""Scores and statuses, in whole hundredths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the quality dimensions (fixed values).
WEIGHTS = {"metadata": 20, "structure": 15, "schema": 20, "figures_tables": 10, "formulas": 10, "references": 15, "xrefs": 10}


def evidence(same_section: Column, has_caption: Column, number_match: Column, distance: Column) -> Column:
    """30 same section, 20 caption, 35 equal number, 15 or 5 for nearness; 0 in another section."""
    near = F.when(distance <= 1, 15).when(distance <= 3, 5).otherwise(0)
    return F.when(same_section, 30 + F.when(has_caption, 20).otherwise(0) + F.when(number_match, 35).otherwise(0) + near).otherwise(0)


def evidence_status(same_section: Column, score: Column) -> Column:
    return F.when(same_section, status(score)).otherwise("error")


def formula(math_paragraph: Column, pure: Column, aligned_and_numbered: Column) -> tuple[Column, Column]:
    """60 for a math paragraph, 55 for mathematics alone, 25 set apart with a number, 100 at most; and whether it stands alone."""
    points = F.when(math_paragraph, 60).otherwise(0) + F.when(pure, 55).otherwise(0) + F.when(aligned_and_numbered, 25).otherwise(0)
    return F.least(F.lit(100), points), math_paragraph | pure | aligned_and_numbered


#: A result for review, in hundredths.
REVIEW = 60


def most_of(conversion: Column) -> Column:
    """The most confidence that a conversion leaves."""
    return F.when(conversion == "partial", 70).when(conversion == "failed", 40).otherwise(100)


def capped_status(score: Column, conversion: Column) -> Column:
    """Partial is for review, failed a warning, whatever the evidence."""
    return F.when(conversion == "partial", "need_review").when(conversion == "failed", "warning").otherwise(status(score))


def float_match(number: Column, object_number: Column, distance: Column, caption: Column, kind: Column) -> Column:
    """35 for the section, 35 equal number, 20 or 10 for nearness; 40 or 35 for a table's screenshot, else 15 for
    a compatible type, else -10."""
    near = F.when(distance <= 1, 20).when(distance <= 3, 10).otherwise(0)
    screenshot = (caption == "table") & (kind == "image") & (distance <= 3) & (number != object_number)
    compatible = ((caption == "figure") & (kind == "image")) | ((caption == "table") & (kind == "table"))
    type_ = F.when(screenshot, F.when(distance <= 1, 40).otherwise(35)).when(compatible, 15).otherwise(-10)
    return F.greatest(F.lit(0), F.least(F.lit(100), 35 + F.when((number != "") & (number == object_number), 35).otherwise(0) + near + type_))


def status(score: Column) -> Column:
    return F.when(score >= 80, "ok").when(score >= 50, "need_review").otherwise("warning")


def grade(total: Column) -> Column:
    return F.when(total >= 90, "A").when(total >= 80, "B").when(total >= 70, "C").when(total >= 60, "D").otherwise("E")


def weighted_total(dimensions: dict[str, Column], errors: Column) -> Column:
    """Weighted mean less 10 for each error, 30 at most, half-even, unclamped (grades use it so)."""
    whole = sum((dimensions[k] * w for k, w in WEIGHTS.items()), F.lit(0))
    return F.bround((whole - 100 * F.least(F.lit(30), 10 * errors)) / 100, 0).cast("long")


def f1_hundredths(both: Column, left: Column, right: Column) -> Column:
    """100 * F1 of an overlap, rounded down; both empty 100, one empty 0."""
    return F.when((left == 0) & (right == 0), 100).when((left == 0) | (right == 0), 0).otherwise(F.floor(200 * both / (left + right))).cast("long")
