"""Views of articles and blocks for editors: node types, issues at their places, rows to show, and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import blocks as rules

#: D25, fixed values, from least to most severe.
SEVERITY = ["ok", "need_review", "warning", "error"]


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status)


def worst(status: str) -> Column:
    """The most severe status of a group."""
    return F.max_by(F.col(status), severity(F.col(status)))


def node_type(kind: Column, text: Column, title: Column, authors: Column, affiliations: Column, abstract: Column, in_references: Column) -> Column:
    """What a block is in the article: its title, an author line, an affiliation, abstract, keywords or reference."""
    named = (F.size(authors) > 0) & F.forall(authors, lambda a: F.contains(text, a))
    return (
        F.when((title != "") & (text == title), "title").when(F.array_contains(authors, text) | named, "author").when(F.array_contains(affiliations, text), "affiliation")
        .when(text.rlike(rules.ABSTRACT) | ((abstract != "") & (text == abstract)), "abstract").when(text.rlike(rules.KEYWORDS), "keywords").when(in_references, "reference").otherwise(kind)
    )


def located(issues: DataFrame, nodes: DataFrame, doc: str, compat: bool = False) -> DataFrame:
    """Each issue at one block of its document: the first whose target it names, else its section's, else the one of its
    field, else the first block. A target is named as a word of its own; compat takes it anywhere in the location."""
    targets = nodes.filter(F.col("target") != "").select(F.col(doc).alias("_doc"), "target", F.col("flow_index").alias("by_target"))
    word = F.concat(F.lit(r"(?:^|[^A-Za-z0-9_-])"), F.regexp_replace("target", r"([.\-])", r"\\$1"), F.lit(r"(?:$|[^A-Za-z0-9_-])"))
    hit = F.contains("location", F.col("target")) if compat else F.rlike(F.col("location"), word)
    keyed = issues.withColumn("_issue", F.monotonically_increasing_id())
    named = keyed.join(targets, (keyed[doc] == targets["_doc"]) & hit).groupBy("_issue").agg(F.min("by_target").alias("by_target"))
    section = F.regexp_extract("location", r"sections\[(\d+)\]", 1)
    places = nodes.groupBy(doc).agg(
        F.min("flow_index").alias("first"), F.map_from_entries(F.collect_list(F.when(F.col("section_at").isNotNull(), F.struct(F.col("section_at").cast("string"), "flow_index")))).alias("by_section"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("field") != "", F.struct("field", "field_first"))))).alias("by_field"),
    )
    field = F.regexp_extract("location", r"article\.([a-z_]+)$", 1)
    rows = keyed.join(named, "_issue", "left").join(places, doc, "left")
    at = F.coalesce("by_target", F.try_element_at("by_section", section), F.try_element_at("by_field", field), "first")
    return rows.select(*issues.columns, at.alias("flow_index"))


def located_nodes(nodes: DataFrame, doc: str) -> DataFrame:
    """Blocks as located() takes them: target, section_at, field, field_first."""
    by = W.partitionBy(doc, "field")
    return nodes.withColumn("field_first", F.min("flow_index").over(by))


def object_issues(objects: DataFrame, issues: DataFrame, doc: str, ident: str) -> DataFrame:
    """C14: every issue whose location names the object."""
    return objects.join(issues.withColumnRenamed(doc, "_doc"), (F.col(doc) == F.col("_doc")) & F.contains("location", F.col(ident))).drop("_doc")


def unlocated(issues: DataFrame, objects: DataFrame, doc: str, ident: str) -> DataFrame:
    """Issues that name no object: an anti join by containment."""
    known = objects.select(F.col(doc).alias("_doc"), F.col(ident).alias("_id"))
    return issues.join(known, (F.col(doc) == F.col("_doc")) & F.contains("location", F.col("_id")), "left_anti")


def shown_rows(rows: Column, most: int = 10) -> Column:
    return F.slice(rows, 1, most)


def fragment(xml: Column, ident: Column, tag: Column) -> Column:
    """The start tag with an id, else the first with the tag's name; empty without either."""
    by_id = F.call_function("regexp_extract", xml, F.concat(F.lit(r"(<[^<>/][^<>]*\bid=[\"']"), ident, F.lit(r"[\"'][^<>]*>)")), F.lit(1))
    by_tag = F.call_function("regexp_extract", xml, F.concat(F.lit("(<"), tag, F.lit(r"(?:\s[^<>]*)?>)")), F.lit(1))
    return F.when((ident != "") & (by_id != ""), by_id).otherwise(by_tag)


def passed_checks(errors: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(10) - errors)


def corrected(articles: DataFrame, corrections: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Editors' values over the articles': a field that is null in the correction stays."""
    new = corrections.select(on, *(F.col(f).alias(f"_{f}") for f in fields))
    rows = articles.join(new, on, "left")
    return rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in articles.columns))


def batch_summary(items: DataFrame, batch: str, order: str, ok: Column) -> DataFrame:
    """Of each batch how many items, how many succeeded, whether all did, and the first that did."""
    return items.groupBy(batch).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("succeeded"), F.bool_and(ok).alias("all_succeeded"), F.min(F.when(ok, F.col(order))).alias("first_success"), (F.count("*") <= 20).alias("within_limit")
    )
