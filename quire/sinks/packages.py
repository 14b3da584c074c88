"""Packages of an article's files, their names, and reports as Markdown."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._udf import arrow


def unique_names(files: DataFrame, package: str, order: str, name: str, out: str) -> DataFrame:
    """A name that was given before gets _2, _3 before its suffix; one that is taken is passed over. A fold over each
    package's names in order."""
    item = F.struct(F.col(order).alias("at"), F.col(name).alias("name"))
    groups = files.groupBy(package).agg(F.sort_array(F.collect_list(item)).alias("names"))

    def step(seen: Column, x: Column) -> Column:
        stem, suffix = F.regexp_extract(x["name"], r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(x["name"], r"^(.*?)(\.[^.]*)?$", 2)
        tries = F.transform(F.sequence(F.lit(1), F.size(seen["used"]) + 1), lambda n: F.when(n == 1, x["name"]).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix)))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(seen["used"], t)), F.lit(0))
        return F.struct(F.concat(seen["used"], F.array(free)).alias("used"), F.concat(seen["out"], F.array(F.struct(x["at"].alias("at"), free.alias("name")))).alias("out"))

    kind = files.schema[order].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<struct<at:{kind},name:string>>").alias("out"))
    rows = groups.select(package, F.explode(F.aggregate("names", start, step, lambda s: s["out"])).alias("f"))
    return rows.select(package, F.col("f.at").alias(order), F.col("f.name").alias(out))


def allowed(files: DataFrame, media: DataFrame, on: list[str]) -> DataFrame:
    """Only files that the document's media has."""
    return files.join(media.select(*on).distinct(), on, "left_semi")


def validation_report(errors: Column, warnings: Column, schema_errors: Column, checks: Column, passed: Column) -> Column:
    """The report of a validation, `None` under an empty heading."""

    def part(title: str, lines: Column) -> Column:
        return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("None"), F.lit("\n"))

    head = F.concat(F.lit("# Validation report\n\nPassed: "), F.when(passed, "yes").otherwise("no"), F.lit("\n"))
    return F.array_join(F.array(head, part("Errors", errors), part("Warnings", warnings), part("Schema errors", schema_errors), part("Cross-references", checks)), "\n")


@arrow("binary")
def _zipped(jats: pd.Series, article: pd.Series, report: pd.Series, quality: pd.Series, media: pd.Series) -> pd.Series:
    def one(x, a, r, q, files) -> bytes:
        members = [("article.xml", x), ("article.json", a), ("validation_report.md", r), *([("quality_report.json", q)] if q else []), *((f"media/{f['name']}", f["content"]) for f in (files if files is not None else ()))]
        members.append(("manifest.json", "[" + ", ".join(f'"{n}"' for n, _ in members) + "]"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in members:
                info = zipfile.ZipInfo(name)  # no times: the same rows give the same bytes
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, content if isinstance(content, bytes) else str(content or ""))
        return out.getvalue()

    return pd.Series([one(*r) for r in zip(jats, article, report, quality, media)])


def packages(rows: DataFrame, jats: str, article: str, report: str, quality: str, media: str, out: str = "package") -> DataFrame:
    """A ZIP for each row: the document, the article as JSON, the reports, the media and a manifest."""
    return rows.withColumn(out, _zipped(F.col(jats), F.to_json(article), F.col(report), F.to_json(quality), F.col(media)))


def comparison_report(summary: dict, results: list[dict], most: int = 12) -> str:
    """The summary and a line for each sample, with its first differences; of a collected, small aggregate."""
    lines = ["# Comparison with official samples", "", *(f"- {k}: {v}" for k, v in summary.items()), "", "| sample | score | differences |", "|-|-|-|"]
    for r in results:
        named = [d["metric"] for d in r["differences"]]
        lines.append(f"| {r['sample']} | {r['similarity_score']} | {', '.join(named[:most])}{' …' if len(named) > most else ''} |")
    return "\n".join(lines) + "\n"
