"""The library's surface: convert, regenerate, export_packages, evaluate, profiles and media, over DataFrames.

Files that are refused or do not parse stay as rows with status `failed` and a reason, so that a batch loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, names
from ..operators import article as assembly
from ..operators import comparator, repair, scorer
from ..sinks import jats, packages
from ..sources import docx

#: Fields that a profile fills where the article has none (fixed value).
PROFILE_FIELDS = ["journal_title", "journal_id", "issn", "publisher_name", "article_type", "lang", "subject"]


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles of a folder of YAML files, by file name; flat `key: value` lines."""
    lines = spark.read.text(f"{folder}/*.yaml").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.yaml$", 1).alias("id"), F.regexp_extract("value", r"^([a-z_]+):", 1).alias("key"), F.regexp_extract("value", r"^[a-z_]+:\s*[\"']?(.*?)[\"']?\s*$", 1).alias("value"))
    fields = ["profile_name", *PROFILE_FIELDS]
    return lines.groupBy("id").agg(*(F.coalesce(F.max(F.when(F.col("key") == f, F.col("value"))), F.lit("")).alias(f) for f in fields)).orderBy("id")


def with_profile(articles: DataFrame, profile: DataFrame, ident: str) -> DataFrame:
    """Empty fields from the named profile; an unknown name is an error."""
    row = profile.filter(F.col("id") == ident).first()
    if row is None:
        raise ValueError(f"no profile {ident}")
    filled = {f: F.coalesce(F.nullif(F.trim(F.coalesce(F.col(f), F.lit(""))), F.lit("")), F.lit(row[f])) for f in PROFILE_FIELDS}
    return articles.withColumns(filled).withColumn("profile", F.lit(ident))


def inspected(raw: DataFrame) -> DataFrame:
    """doc_id, reason of every file (doc_id, name, content)."""
    first = raw.select(F.col("doc_id").cast("string").alias("doc_id"), docx.upload_reason(F.col("content"), F.col("name")).alias("reason"), F.lower("name").endswith(".docx").alias("zip"))
    entries = docx.inspected(docx.zip_entries(raw)).withColumnRenamed("reason", "inside")
    # Old formats need a converter that is not part of this library.
    reason = F.when(F.col("reason") != "", F.col("reason")).when(~F.col("zip"), "no converter").otherwise(F.coalesce("inside", F.lit("")))
    return first.join(entries, "doc_id", "left").select("doc_id", reason.alias("reason"))


def validated(articles: DataFrame, xml: str = "jats") -> DataFrame:
    """K1-K8: the document repaired, and validation as the quality report takes it. `passed` leaves the schema's verdict out."""
    rows = articles.withColumn("_first", repair.checks(F.col(xml)))
    rows = rows.withColumn("auto_fix", repair.auto_fixed(F.col(xml), F.when(F.col("_first.well_formed"), F.col("_first.schema_errors"))))
    rows = rows.withColumn(xml, F.col("auto_fix.xml")).withColumn("_now", repair.checks(F.col(xml)))
    paragraphs = F.flatten(F.transform("sections", lambda s: s["paragraphs"]))
    rows = rows.withColumn("_found", jats._candidates_of(paragraphs))
    spans = F.flatten(F.transform("_found", lambda f: citations.against_targets(citations.resolved(f), jats.targets())))
    warnings, checks = repair.xref_messages(F.col("_now"))
    more_warnings, more_checks = repair.source_messages(spans)
    missing = F.transform("_now.missing_nodes", lambda n: F.concat(F.lit("缺少 JATS "), n, F.lit(" 节点。")))
    errors = F.concat(scorer.required_content(), F.when(F.col("_now.well_formed"), missing).otherwise(F.array(F.lit("XML 无法解析"))))
    seen = scorer_view()
    rows = rows.withColumns(seen)
    validation = F.struct(
        F.col("_now.well_formed").alias("xml_well_formed"), F.col("_now.schema_valid").alias("jats_schema_valid"), F.col("_now.schema_errors").alias("schema_errors"), errors.alias("errors"),
        F.concat(scorer.content_warnings(), F.array_distinct(F.concat(warnings, more_warnings))).alias("warnings"), F.array_distinct(F.concat(checks, more_checks)).alias("xref_checks"),
    )
    return rows.withColumn("validation", validation).withColumn("passed", scorer.passed(F.col("validation.errors"), F.col("validation.xml_well_formed"))).drop("_first", "_now", "_found")


def scorer_view() -> dict[str, Column]:
    """The article's arrays with the fields that scoring reads (H30-H36's evidence where the parser gave none)."""
    none, empty = F.lit(None).cast("double"), F.lit("")
    return {
        "authors": F.transform("authors", lambda a: a.withField("normalization_status", F.lit("unchanged"))),
        "figures": F.transform("figures", lambda x: F.struct(x["id"].alias("id"), x["caption"].alias("caption"), F.coalesce(F.get(x["paths"], F.lit(0)), empty).alias("path"), x["paths"].alias("paths"), empty.alias("preview_path"), x["section_index"].alias("section_index"), none.alias("confidence"), F.when((x["caption"] == "") | (F.size(x["paths"]) == 0), "need_review").otherwise("ok").alias("status"))),
        "tables": F.transform("tables", lambda x: x.withField("confidence", none).withField("status", F.when(x["caption"] == "", "need_review").otherwise("ok"))),
        "formulas": F.transform("formulas", lambda x: x.withField("conversion_status", F.when(x["type"] == "image_formula", "partial").otherwise("success")).withField("unsupported_features", F.array().cast("array<string>")).withField("conflict", F.lit(False)).withField("confidence", none).withField("status", F.lit("ok"))),
        "references": F.transform("references", lambda x: x.withField("parse_confidence", F.least(F.lit(1.0), F.bround(sum(((F.size(x[f]) if f == "authors" else F.length(x[f])) > 0).cast("int") for f in citations.FIELDS) / 7, 2)))),
    }


def convert(raw: DataFrame, profile: DataFrame | None = None, profile_id: str = "default") -> DataFrame:
    """Files (doc_id, name, content) to rows: status, reason, the article's columns, jats, validation and the quality report."""
    reasons = inspected(raw)
    good = raw.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(reasons.filter("reason = ''"), "doc_id", "left_semi")
    articles = assembly.articles(docx.flow_nodes(good))
    if profile is not None:
        articles = with_profile(articles, profile, profile_id)
    done = scorer.scored(regenerate(articles))
    rows = reasons.join(done, "doc_id", "left")
    status = F.when(F.col("reason") != "", "failed").when(F.col("jats").isNull(), "failed").otherwise("success")
    return rows.withColumn("status", status).withColumn("reason", F.when((F.col("reason") == "") & F.col("jats").isNull(), "no document").otherwise(F.col("reason")))


def regenerate(articles: DataFrame) -> DataFrame:
    """Articles, corrected or not, with their document and its validation."""
    return validated(jats.to_jats(jats.with_ids(articles)))


def export_packages(converted: DataFrame, media: DataFrame) -> DataFrame:
    """doc_id, package: a ZIP for each converted row, with the media of its document."""
    files = media.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(F.element_at(F.split("media_path", "/"), -1).alias("name"), "content"))).alias("files"))
    rows = converted.filter("status = 'success'").join(files, "doc_id", "left")
    v = F.col("validation")
    report = packages.validation_report(v["errors"], v["warnings"], v["schema_errors"], v["xref_checks"], F.col("passed"))
    rows = rows.withColumn("report", report).withColumn("quality", F.struct("total_score", "grade", "summary", "issues"))
    fields = [f for f in rows.sparkSession.createDataFrame([], jats.ARTICLE).columns if f in rows.columns]
    rows = rows.withColumn("article", F.struct(*fields))
    return packages.packages(rows, "jats", "article", "report", "quality", "files").select("doc_id", "package")


def evaluate(generated: DataFrame, gold: DataFrame, on: str, average: float = 94, minimum: float = 90, rate: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, summary, the summary if all floors are reached) of samples that both sides have; generated: on,
    jats, schema_valid; gold: on, xml."""
    pairs = generated.join(gold, on).select(on, F.col("jats").alias("generated"), F.col("xml").alias("official"), "schema_valid")
    results = comparator.compared(pairs)
    found = comparator.summary(results)
    return results, found, comparator.accepted(found, average, minimum, rate)


def read_media(media: DataFrame, doc_id: str, name: str) -> DataFrame:
    """One file of one document, by a safe name with an allowed suffix."""
    safe = F.lit(name).rlike(r"^[A-Za-z0-9._-]+\.(?i:png|jpe?g|gif|bmp|tiff?|svg|emf|wmf|webp)$") & ~F.lit(name).contains("..")
    return media.filter((F.col("doc_id") == doc_id) & (F.element_at(F.split("media_path", "/"), -1) == name) & safe)


def caption_evidence(captions: DataFrame) -> DataFrame:
    """H1 with D13: captions (kind, caption) split, for a table of its own."""
    return captions.withColumn("split", names.caption_split(F.col("caption"), F.col("kind")))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles, corrected by hand or kept, from JSON lines; fields that are missing are empty."""
    rows = spark.read.schema(f"doc_id string, {jats.ARTICLE}").json(path)
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) if f.dataType.typeName() == "array" else F.coalesce(F.col(f.name), F.lit("")) for f in rows.schema if f.name != "doc_id"}
    return rows.select("doc_id", *(c.alias(n) for n, c in empty.items()))


def write_results(converted: DataFrame, path: str) -> None:
    """Every row, failed ones too, as JSON lines."""
    converted.write.mode("overwrite").json(path)


def catalog_of(samples: DataFrame, files: DataFrame) -> DataFrame:
    """The samples (filename, label, xml) whose file is there, by label."""
    return samples.join(files.select(F.col("name").alias("filename")).distinct(), "filename", "left_semi").orderBy("label")
