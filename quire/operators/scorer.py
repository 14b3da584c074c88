"""The quality report of an article: scores, issues and summaries, and the checks of its content.

Rows are articles: title, abstract, journal_title, publisher_name; keywords and affiliations (arrays of strings); authors,
sections, figures, tables, formulas and references (arrays of structs); validation (a struct). Everything is a Column
expression over one row, so no step shuffles. Issues carry a code; messages are texts of the studied system (fixed
values) where a later rule reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import grade

ARTICLE = """title string, abstract string, journal_title string, publisher_name string, keywords array<string>, affiliations array<string>,
authors array<struct<name:string,orcid:string,normalization_status:string>>, sections array<struct<title:string,paragraphs:array<string>>>,
figures array<struct<id:string,caption:string,path:string,preview_path:string,confidence:double,status:string>>,
tables array<struct<id:string,caption:string,rows:array<array<string>>,confidence:double,status:string>>,
formulas array<struct<id:string,label:string,content:string,latex:string,mathml:string,path:string,type:string,conversion_status:string,unsupported_features:array<string>,conflict:boolean,confidence:double,status:string>>,
references array<struct<id:string,parse_confidence:double>>,
validation struct<xml_well_formed:boolean,jats_schema_valid:boolean,schema_errors:array<string>,errors:array<string>,warnings:array<string>,xref_checks:array<string>>"""
ISSUES = "array<struct<level:string,module:string,location:string,message:string>>"
METADATA = ["title", "abstract", "keywords", "authors", "affiliations", "journal_title", "publisher_name"]
WEIGHTS = {"metadata_score": 20, "structure_score": 15, "jats_schema_score": 20, "figure_table_score": 10, "formula_score": 10, "reference_score": 15, "xref_score": 10}


def _n(array: Column) -> Column:
    return F.coalesce(F.size(F.when(array.isNotNull(), array)), F.lit(0))


def _count(array: Column, test) -> Column:
    return _n(F.filter(array, test))


def _times(array: Column, value: str) -> Column:
    return _count(array, lambda x: x == value)


def _filled(column: Column) -> Column:
    return F.coalesce(F.length(column) > 0, F.lit(False))


def _share(part: Column, whole: Column) -> Column:
    """100 * part / whole, half-even."""
    return F.bround(100.0 * part / whole, 0).cast("int")


def issue(level: str, module: str, location: Column | str, message: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(level).alias("level"), F.lit(module).alias("module"), as_column(location).alias("location"), as_column(message).alias("message"))


def _issues(array: Column, make) -> Column:
    return F.coalesce(F.transform(array, make), F.array().cast(ISSUES))


def _one(test: Column, value: Column) -> Column:
    return F.when(test, F.array(value)).otherwise(F.array().cast(ISSUES))


def has(field: str) -> Column:
    return _n(F.col(field)) > 0 if field in ("keywords", "authors", "affiliations") else _filled(F.col(field))


def metadata_score() -> Column:
    """D3: filled fields of seven."""
    return _share(sum((has(f).cast("int") for f in METADATA), F.lit(0)), F.lit(len(METADATA)))


def structure_score() -> Column:
    """0 without sections; an empty one counts half; 30 at least."""
    s = F.col("sections")
    empty = _count(s, lambda x: _n(x["paragraphs"]) == 0)
    return F.when(_n(s) == 0, 0).otherwise(F.greatest(F.lit(30), _share(_n(s) - empty * 0.5, F.greatest(_n(s), F.lit(1)))))


def schema_score() -> Column:
    """Malformed 0, valid 100, not checked 60, else 60 less 10 an error, 10 at least."""
    v = F.col("validation")
    return (
        F.when(~F.coalesce(v["xml_well_formed"], F.lit(False)), 0).when(v["jats_schema_valid"].isNull(), 60).when(v["jats_schema_valid"], 100)
        .otherwise(F.greatest(F.lit(10), 60 - F.least(F.lit(50), 10 * _n(v["schema_errors"]))))
    )


def figure_table_score() -> Column:
    """Captions of figures, captions and rows of tables; none is 100."""
    good = _count(F.col("figures"), lambda x: _filled(x["caption"])) + _count(F.col("tables"), lambda x: _filled(x["caption"]) & (_n(x["rows"]) > 0))
    whole = _n(F.col("figures")) + _n(F.col("tables"))
    return F.when(whole == 0, 100).otherwise(_share(good, F.greatest(whole, F.lit(1))))


def formula_content(x: Column) -> Column:
    return _filled(x["mathml"]) | _filled(x["latex"]) | _filled(x["content"]) | _filled(x["path"])


def conversion(x: Column) -> Column:
    return F.coalesce(x["conversion_status"], F.when(formula_content(x), "success").otherwise("failed"))


def formula_score() -> Column:
    """Success 1, partial 0.75, failed 0.25 where something is left; none is 100."""
    value = lambda x: F.when(conversion(x) == "success", 1.0).when(conversion(x) == "partial", 0.75).when(formula_content(x), 0.25).otherwise(0.0)
    earned = F.aggregate(F.transform("formulas", value), F.lit(0.0), lambda s, v: s + v)
    return F.when(_n(F.col("formulas")) == 0, 100).otherwise(_share(earned, F.greatest(_n(F.col("formulas")), F.lit(1))))


def reference_score() -> Column:
    """Mean confidence; none is 40."""
    total = F.aggregate("references", F.lit(0.0), lambda s, x: s + F.coalesce(x["parse_confidence"], F.lit(0.0)))
    return F.when(_n(F.col("references")) == 0, 40).otherwise(_share(total, F.greatest(_n(F.col("references")), F.lit(1))))


def _unresolved(message: Column) -> Column:
    return message.contains("引用目标") | message.contains("交叉引用")


def xref_score() -> Column:
    """25 less for each warning of a reference's target."""
    return F.greatest(F.lit(0), 100 - 25 * _count(F.col("validation.warnings"), _unresolved))


SCORES = {"metadata_score": metadata_score, "structure_score": structure_score, "jats_schema_score": schema_score, "figure_table_score": figure_table_score, "formula_score": formula_score, "reference_score": reference_score, "xref_score": xref_score}


def found_issues() -> Column:
    """The issues that the scores come with, in their order."""
    v, low = F.col("validation"), F.lit(0.5)
    index = lambda name, i: F.concat(F.lit(name + "["), i.cast("string"), F.lit("]"))
    ident = lambda x: F.coalesce(x["id"], F.lit("unknown"))
    well = F.coalesce(v["xml_well_formed"], F.lit(False))
    places = lambda array, test: F.filter(F.transform(F.coalesce(F.col(array), F.array()), lambda x, i: F.struct(i.alias("i"), test(x).alias("hit"))), lambda p: p["hit"])
    table_bad = lambda x: ~(_filled(x["caption"]) & (_n(x["rows"]) > 0))
    floats = lambda name, test, module: _issues(F.filter(name, test), lambda x: issue("warning", "figure_table", F.concat(F.lit(f"article.{name}."), ident(x)), F.concat(ident(x), F.lit(f" 缺少{module}或内容"))))

    def formula(x: Column) -> Column:
        where = F.concat(F.lit("article.formulas."), ident(x))
        unsupported = F.coalesce(F.nullif(F.array_join(F.coalesce(x["unsupported_features"], F.array()), "、"), F.lit("")), F.lit("未知结构"))
        return F.concat(
            _one(~formula_content(x), issue("warning", "formula", where, F.concat(ident(x), F.lit(" 没有可交付公式内容")))),
            _one(conversion(x) == "partial", issue("need_review", "formula", where, F.concat(ident(x), F.lit(" 为部分转换，不支持特性："), unsupported))),
            _one(~conversion(x).isin("success", "partial"), issue("warning", "formula", where, F.concat(ident(x), F.lit(" 转换失败或仅保留回退内容")))),
            _one((x["type"] == "omml") & ~_filled(x["mathml"]), issue("suggestion", "formula", F.concat(where, F.lit(".mathml")), F.concat(ident(x), F.lit(" 的 OMML 未转换为 MathML")))),
        )

    return F.concat(
        *(_one(~has(f), issue("warning", "metadata", f"article.{f}", f"{f} 为空")) for f in METADATA),
        _one(_n(F.col("sections")) == 0, issue("error", "structure", "article.sections", "未识别到章节")),
        _issues(places("sections", lambda x: _n(x["paragraphs"]) == 0), lambda p: issue("warning", "structure", index("article.sections", p["i"]), "章节没有正文段落")),
        _one(~well, issue("error", "jats_schema", "xml", "XML 无法解析")),
        _one(well & v["jats_schema_valid"].isNull(), issue("warning", "jats_schema", "schemas", "未执行正式 JATS Schema 校验")),
        F.when(well & ~F.coalesce(v["jats_schema_valid"], F.lit(True)), _issues(F.slice(v["schema_errors"], 1, 10), lambda m: issue("error", "jats_schema", "schema_errors", m))).otherwise(F.array().cast(ISSUES)),
        floats("figures", lambda x: ~_filled(x["caption"]), "图题"), floats("tables", table_bad, "表题"),
        F.flatten(F.coalesce(F.transform("formulas", formula), F.array())),
        _one(_n(F.col("references")) == 0, issue("warning", "reference", "article.references", "没有参考文献")),
        _issues(places("references", lambda x: F.coalesce(x["parse_confidence"], F.lit(0.0)) < low), lambda p: issue("suggestion", "reference", index("article.references", p["i"]), "参考文献细粒度解析置信度较低")),
        _issues(F.filter(v["warnings"], _unresolved), lambda m: issue("warning", "xref", "validation.xref_checks", m)),
    )


def validation_issues(found: Column) -> Column:
    """Errors, and warnings that are not of references, whose message no issue found before has."""
    v, known = F.col("validation"), F.transform(found, lambda i: i["message"])
    new = lambda m: ~F.array_contains(known, m)
    return F.concat(
        _issues(F.filter(v["errors"], new), lambda m: issue("error", "business_rules", "validation.errors", m)),
        _issues(F.filter(v["warnings"], lambda m: new(m) & ~m.contains("交叉引用")), lambda m: issue("warning", "business_rules", "validation.warnings", m)),
    )


def evidence_summary(*collections: str) -> Column:
    """How many of each status, an unknown one for review, and the mean confidence to 2 places,
    half-even by its decimal digits, null without any."""
    items = F.flatten(F.array(*(F.coalesce(F.transform(c, lambda x: F.struct(x["status"].alias("status"), x["confidence"].alias("confidence"))), F.array().cast("array<struct<status:string,confidence:double>>")) for c in collections)))
    status = lambda x: F.coalesce(x["status"], F.lit("ok"))
    known = F.filter(items, lambda x: x["confidence"].isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.greatest(F.size(known), F.lit(1))
    return F.struct(
        F.size(items).alias("total"), *(_times(F.transform(items, status), k).alias(k) for k in ("ok", "warning", "error")),
        _count(items, lambda x: ~status(x).isin("ok", "warning", "error")).alias("need_review"),
        F.when(F.size(known) > 0, F.bround(mean, 2)).alias("average_confidence"),
    )


def formula_summary() -> Column:
    """Counts by status, MathML, and the sorted distinct features that are not supported."""
    f, status = F.col("formulas"), lambda x: F.coalesce(x["conversion_status"], F.lit("success"))
    features = F.flatten(F.coalesce(F.transform(f, lambda x: F.coalesce(x["unsupported_features"], F.array().cast("array<string>"))), F.array().cast("array<array<string>>")))
    return F.struct(
        _n(f).alias("total"), _count(f, lambda x: _filled(x["mathml"])).alias("mathml_success"), _count(f, lambda x: status(x) == "success").alias("success"),
        _count(f, lambda x: status(x) == "partial").alias("partial"), _count(f, lambda x: ~status(x).isin("success", "partial")).alias("failed"),
        F.array_sort(F.array_distinct(features)).alias("unsupported_features"),
    )


def xref_summary() -> Column:
    """D13."""
    checks, warnings = F.col("validation.xref_checks"), F.col("validation.warnings")
    return F.struct(
        _count(checks, lambda m: m.contains("检查通过")).alias("passed"), _count(checks, lambda m: m.contains("人工复核") | F.lower(m).contains("need_review")).alias("need_review"),
        _count(warnings, lambda m: m.contains("目标不存在")).alias("missing"), _count(checks, lambda m: m.contains("已归一化")).alias("normalized"),
    )


def normalization_summary(figure_label: str, table_label: str) -> Column:
    """Normalised authors, captions with a label, labelled formulas, formulas whose forms differ."""
    return F.struct(
        _count(F.col("authors"), lambda x: x["normalization_status"] == "normalized").alias("contributors"),
        (_count(F.col("figures"), lambda x: x["caption"].rlike(figure_label)) + _count(F.col("tables"), lambda x: x["caption"].rlike(table_label))).alias("captions"),
        _count(F.col("formulas"), lambda x: _filled(x["label"])).alias("labeled_formulas"),
        _count(F.col("formulas"), lambda x: F.coalesce(x["conflict"], F.lit(False))).alias("formula_conflicts"),
    )


def scored(articles: DataFrame) -> DataFrame:
    """The report's columns beside the article's."""
    out = articles
    for name, score in SCORES.items():
        out = out.withColumn(name, score().cast("int"))
    weighted = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0)) / 100
    raw = F.bround(weighted - F.least(F.lit(30), 10 * _n(F.col("validation.errors"))), 0).cast("int")
    out = out.withColumn("raw", raw).withColumn("total_score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw")))).withColumn("grade", grade(F.col("raw"))).drop("raw")
    out = out.withColumn("_found", found_issues())
    out = out.withColumn("issues", F.concat("_found", validation_issues(F.col("_found")))).drop("_found")
    counts = F.struct(*(_times(F.transform("issues", lambda i: i["level"]), k).alias(f"{k}_count") for k in ("error", "warning", "suggestion", "need_review")))
    return (
        out.withColumn("summary", counts).withColumn("formula_summary", formula_summary()).withColumn("structure_evidence", evidence_summary("figures", "tables", "formulas"))
        .withColumn("float_evidence_summary", evidence_summary("figures", "tables")).withColumn("xref_summary", xref_summary())
    )


def required_content() -> Column:
    """K1: errors of missing content."""
    rules = [(_filled(F.trim("title")), "标题不能为空。"), (_filled(F.trim("abstract")), "摘要不能为空。"), (_n(F.col("keywords")) > 0, "关键词不能为空。"), (_n(F.col("sections")) > 0, "至少需要一个章节。")]
    return F.array_compact(F.array(*(F.when(~ok, message) for ok, message in rules)))


def content_warnings() -> Column:
    """K2: the warnings of content, rule after rule, objects in order."""
    strings = "array<string>"
    one = lambda test, message: F.when(test, F.array(F.lit(message))).otherwise(F.array().cast(strings))
    blank = lambda x: ~_filled(F.trim(x))
    each = lambda array, make: F.flatten(F.coalesce(F.transform(array, make), F.array().cast("array<array<string>>")))
    some = lambda *tests: F.array_compact(F.array(*(F.when(t, m) for t, m in tests)))
    named = lambda x, i: F.coalesce(F.nullif(x["id"], F.lit("")), (i + 1).cast("string"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def formula(x: Column, i: Column) -> Column:
        content = F.trim(F.coalesce(F.nullif(x["latex"], F.lit("")), F.nullif(x["content"], F.lit("")), F.nullif(x["path"], F.lit("")), F.lit("")))
        unsupported = F.coalesce(F.nullif(F.array_join(F.coalesce(x["unsupported_features"], F.array()), "、"), F.lit("")), F.lit("未知结构"))
        status = F.coalesce(x["conversion_status"], F.lit("success"))
        return some(
            (content == "", text("公式 ", named(x, i), " 内容为空。")), ((x["type"] == "omml") & blank(x["mathml"]), text("公式 ", named(x, i), " 的 OMML 无法转换为 MathML，已保留文本回退。")),
            (status == "partial", text("公式 ", named(x, i), " 为部分转换，不支持特性：", unsupported, "，需要人工复核。")), (status == "failed", text("公式 ", named(x, i), " 转换失败，需要人工复核。")),
        )

    return F.concat(
        one(~has("authors"), "作者为空，建议补充作者信息。"), one(~has("affiliations"), "单位为空，建议补充作者单位。"), one(_n(F.col("references")) == 0, "参考文献为空，建议补充参考文献。"),
        each("authors", lambda x: some((blank(x["orcid"]), text("作者 ", F.coalesce(x["name"], F.lit("未命名作者")), " 缺少 ORCID。")))),
        each("figures", lambda x: some((blank(x["caption"]), text("图片 ", F.coalesce(x["id"], F.lit("未命名图片")), " 缺少图题。")))),
        each("tables", lambda x, i: some((blank(x["caption"]), text("表格 ", named(x, i), " 缺少表题。")), (_n(x["rows"]) == 0, text("表格 ", named(x, i), " 没有数据行。")))),
        each("formulas", formula),
        each("sections", lambda x: some((_n(x["paragraphs"]) == 0, text("章节“", F.coalesce(x["title"], F.lit("未命名章节")), "”没有正文段落。")))),
        one(_n(F.col("keywords")) < 3, "关键词少于 3 个，建议补充关键词。"),
    )


def passed(errors: Column, well_formed: Column) -> Column:
    """K7: no errors, and XML that parses; the schema's verdict stands beside it."""
    return (_n(errors) == 0) & F.coalesce(well_formed, F.lit(False))


def presentation_warnings() -> Column:
    """Warnings of figures and tables as they are shown, and the shape of each table."""
    some = lambda *tests: F.array_compact(F.array(*(F.when(t, m) for t, m in tests)))
    figures = F.transform("figures", lambda x: F.struct(x["id"].alias("id"), some((~_filled(x["caption"]), "caption"), (~_filled(x["path"]), "file"), (_filled(x["path"]) & F.lower(x["path"]).rlike(r"\.tiff?$") & ~_filled(x["preview_path"]), "preview")).alias("missing")))
    tables = F.transform("tables", lambda x: F.struct(
        x["id"].alias("id"), some((~_filled(x["caption"]), "caption"), (_n(x["rows"]) == 0, "rows")).alias("missing"), _n(x["rows"]).alias("rows"),
        F.coalesce(F.array_max(F.transform(x["rows"], lambda r: F.size(r))), F.lit(0)).alias("columns"),
    ))
    return F.struct(figures.alias("figures"), tables.alias("tables"))
