"""Queries of the manuscript operators over text that is put together from the tables' columns.

The SQL does not repeat the Spark expressions: where a text was made of columns, it states the parts that must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blocks, citations, names, omml
from ..operators import article as assembly
from ..operators import comparator, scorer, views
from ..sinks import jats, packages
from ..sources.docx import inspected
from ..sources.tables import line_blocks, table, task_count
from . import surface
from .catalog import query


def reverse_xrefs(spans, target_types=("fig", "table")):
    """(rid, place) of the references of one paragraph: its k-th span of any kind, figures and tables kept."""
    return F.flatten(F.transform(spans, lambda s, k: F.when(s["ref_type"].isin(*target_types), F.transform(s["rids"], lambda r: F.struct(r.alias("rid"), (k + 1).alias("k")))).otherwise(F.array().cast("array<struct<rid:string,k:int>>"))))


def _parts(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _lines(spark, d, *keys):
    """Lines dealt to tasks by their number, for steps that cost much a row."""
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(task_count(rows), *keys)


def _s(column):
    return (F.col(column) if isinstance(column, str) else column).cast("string")


NAME = "upper(substring(p_name, 1, 1)) || substring(p_name, 2)"
KINDS = ["paragraph", "paragraph", "figure_caption", "table_caption", "heading", "list", "formula", "paragraph", "heading", "paragraph"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE l_partkey % 10 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(KINDS))} END) AS type, CASE l_partkey % 10 WHEN 4 THEN 1 WHEN 8 THEN 1 ELSE 0 END AS level FROM lineitem JOIN part ON l_partkey = p_partkey")
def paragraph_types(spark, d):
    """Ten kinds of text, told apart."""
    n, name = _s("l_linenumber"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100))
    texts = [
        F.concat(F.lit("Fig. "), n, F.lit(" shows "), "p_name"), F.concat(F.lit("Table "), n, F.lit(" presents "), "p_name"), F.concat(F.lit("Figure "), n, F.lit(". "), name), F.concat(F.lit("Table "), n, F.lit(": "), "p_name"),
        F.concat(n, F.lit(" "), name), F.concat(F.lit("- "), "p_name"), F.concat(F.lit("E = m + "), n), F.concat("p_name", F.lit(".")), name, F.col("p_name"),
    ]
    kind = F.col("l_partkey") % 10
    rows = _parts(spark, d).withColumn("text", F.coalesce(*(F.when(kind == i, t) for i, t in enumerate(texts)))).withColumn("bold", kind.isin(7, 8))
    rows = rows.withColumn("type", blocks.paragraph_type(F.col("text"), F.lit(""), F.col("bold"), F.lit(False)))
    level = F.when(F.col("type") == "heading", blocks.section_title(F.col("text"), F.lit(""), F.col("type"))["level"]).otherwise(0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "type", level.alias("level"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Figure ' || l_linenumber || '=fig' || l_linenumber || ';Tables 1 and ' || (2 + l_partkey % 5) || '=tab1 tab' || (2 + l_partkey % 5) || ';[' || (1 + l_suppkey % 3) || '-' || (4 + l_suppkey % 4) || ']=' || array_to_string(list_transform(range(1 + l_suppkey % 3, 5 + l_suppkey % 4), lambda x: 'ref' || x), ' ') AS spans, 3::BIGINT AS n FROM lineitem")
def xref_spans(spark, d):
    """References in a text, with all their targets."""
    a, b, c = (1 + F.col("l_suppkey") % 3), (4 + F.col("l_suppkey") % 4), 2 + F.col("l_partkey") % 5
    text = F.concat(F.lit("See Figure "), _s("l_linenumber"), F.lit("; Tables 1 and "), _s(c), F.lit(" ["), _s(a), F.lit("-"), _s(b), F.lit("]."))
    rows = _lines(spark, d, "l_orderkey", "l_linenumber").withColumn("found", citations.candidates(text)).withColumn("spans", citations.resolved(F.col("found")))
    shown = F.array_join(F.transform("spans", lambda s: F.concat(s["text"], F.lit("="), F.array_join(s["rids"], " "))), ";")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("spans"), F.size("spans").cast("long").alias("n"))


@query("WITH x AS (SELECT l_orderkey, unnest(['fig' || l_linenumber, 'tab1', 'tab' || (2 + l_partkey % 5)]) AS rid, unnest([1, 2, 2]) AS k, l_linenumber AS n FROM lineitem) SELECT l_orderkey, rid, count(*) AS n_refs, string_agg('sec' || n || '-p1-xref' || k, ',' ORDER BY n, k) AS places FROM x GROUP BY 1, 2")
def xref_places(spark, d):
    """Who refers to a figure or table, by section, paragraph and place of the reference, in order."""
    text = F.concat(F.lit("See Figure "), _s("l_linenumber"), F.lit("; Tables 1 and "), _s(2 + F.col("l_partkey") % 5), F.lit(" [1]."))
    # Dealt by the document; the places still come together by an exchange of the session's shuffle partitions.
    rows = _lines(spark, d, "l_orderkey").withColumn("found", citations.candidates(text)).withColumn("spans", citations.resolved(F.col("found")))
    each = rows.select("l_orderkey", "l_linenumber", F.explode(reverse_xrefs(F.col("spans"))).alias("x")).select("l_orderkey", "x.rid", F.struct("l_linenumber", "x.k").alias("at"))
    place = lambda a: F.concat(F.lit("sec"), a["l_linenumber"].cast("string"), F.lit("-p1-xref"), a["k"].cast("string"))
    return each.groupBy("l_orderkey", "rid").agg(F.count("*").alias("n_refs"), F.array_join(F.transform(F.sort_array(F.collect_list("at")), place), ",").alias("places"))


@query("WITH t AS (SELECT l_orderkey AS o, list('fig' || l_linenumber) AS ids FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ids, list_transform(range(1, 2 + l_partkey % 6), lambda x: 'fig' || x) AS rids FROM lineitem JOIN t ON l_orderkey = o) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter(rids, lambda x: list_contains(ids, x)), ' ') AS rids, array_to_string(list_filter(rids, lambda x: NOT list_contains(ids, x)), ' ') AS missing, CASE WHEN len(list_filter(rids, lambda x: NOT list_contains(ids, x))) = 0 THEN 'ok' ELSE 'need_review' END AS status FROM r")
def xref_targets(spark, d):
    """Ranges against a document's targets."""
    rows = table(spark, d, "lineitem")
    targets = rows.groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(F.concat(F.lit("fig"), _s("l_linenumber"))).alias("ids"))
    text = F.concat(F.lit("Figures 1-"), _s(1 + F.col("l_partkey") % 6))
    one = F.when(F.col("l_partkey") % 6 == 0, F.lit("Figure 1")).otherwise(text)
    found = rows.withColumn("spans", citations.candidates(one)).join(targets, F.col("l_orderkey") == F.col("o"))
    found = found.withColumn("s", F.get(citations.against_targets(citations.resolved(F.col("spans")), F.col("ids")), F.lit(0)))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("s.rids", " ").alias("rids"), F.array_join("s.missing_targets", " ").alias("missing"), F.col("s.status").alias("status"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '[' || l_linenumber || ']' AS label, 'Smith AB;Jones CD' AS authors, p_name AS article_title, p_brand AS source, year(l_shipdate)::VARCHAR AS year, (1 + p_partkey % 40)::VARCHAR AS volume, l_linenumber::VARCHAR AS issue, (100 + l_linenumber)::VARCHAR AS fpage, (110 + l_linenumber)::VARCHAR AS lpage, CASE WHEN l_linenumber % 3 = 0 THEN '10.1234/x' || p_partkey ELSE '' END AS doi, 'journal' AS publication_type, 1.0::DOUBLE AS parse_confidence FROM lineitem JOIN part ON l_partkey = p_partkey")
def citation_fields(spark, d):
    """The parts of a bibliography entry."""
    n = F.col("l_linenumber")
    raw = F.concat(
        F.lit("["), _s(n), F.lit("] Smith AB, Jones CD. "), "p_name", F.lit(". "), "p_brand", F.lit(" "), _s(F.year("l_shipdate")), F.lit(";"), _s(1 + F.col("p_partkey") % 40), F.lit("("), _s(n), F.lit("):"),
        _s(100 + n), F.lit("-"), _s(110 + n), F.lit("."), F.when(n % 3 == 0, F.concat(F.lit(" https://doi.org/10.1234/x"), _s("p_partkey"))).otherwise(""),
    )
    lines = _parts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "p_partkey", "p_name", "p_brand")
    lines = lines.repartition(task_count(table(spark, d, "lineitem")), "l_orderkey", "l_linenumber")
    rows = citations.parsed_entries(lines.withColumn("entry", raw), "entry")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", F.array_join("authors", ";").alias("authors"), *citations.FIELDS[1:], F.col("parse_confidence").cast("double").alias("parse_confidence"))


@query("WITH r AS (SELECT c_nationkey AS n, 1990 + (c_custkey % 9) AS y, min(c_custkey) AS ref FROM customer GROUP BY 1, 2) SELECT o_orderkey, ref FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN r ON r.n = (c_nationkey + o_orderkey % 2) % 25 AND r.y = 1990 + o_orderkey % 10")
def author_years(spark, d):
    """Author and year in a text to the first entry that has them."""
    letters = lambda n: F.concat(F.lit("Name"), F.translate(_s(n), "0123456789", "abcdefghij"))
    customers = table(spark, d, "customer")
    raw = F.concat(letters(F.col("c_nationkey")), F.lit(" A. Title. Press. "), _s(1990 + F.col("c_custkey") % 9))
    entries = customers.select("c_custkey", F.explode(citations.reference_keys(F.array().cast("array<string>"), raw)).alias("key"), F.get(citations.years(raw), F.lit(0)).alias("year"))
    first = entries.groupBy("key", "year").agg(F.min("c_custkey").alias("ref"))
    cited = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(F.lit("as said (see above; "), letters((F.col("c_nationkey") + F.col("o_orderkey") % 2) % 25), F.lit(" et al., "), _s(1990 + F.col("o_orderkey") % 10), F.lit("a)"))
    found = cited.withColumn("hits", citations.author_years(text)).withColumn("hit", F.get("hits", F.lit(0)))
    keyed = found.select("o_orderkey", F.explode(citations.author_keys(F.col("hit.author"))).alias("key"), F.col("hit.year").alias("year")).distinct()
    return keyed.join(first, ["key", "year"], "left").groupBy("o_orderkey").agg(F.min("ref").alias("ref"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'Scheme ' || l_linenumber WHEN 1 THEN 'Fig. ' || l_linenumber WHEN 2 THEN '' ELSE 'Table ' || l_linenumber END AS label, CASE l_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE p_name END AS caption, CASE l_partkey % 4 WHEN 1 THEN 'need_review' WHEN 2 THEN 'unchanged' ELSE 'normalized' END AS status, CASE l_partkey % 4 WHEN 0 THEN 'scheme:' || l_linenumber WHEN 2 THEN '' ELSE 'float:' || l_linenumber END AS identity FROM lineitem JOIN part ON l_partkey = p_partkey")
def caption_labels(spark, d):
    """H1, H9: label, body and identity of captions."""
    n, kind = _s("l_linenumber"), F.col("l_partkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("Scheme "), n, F.lit(": "), "p_name")).when(kind == 1, F.concat(F.lit("Fig. "), n, F.lit("."))).when(kind == 2, F.col("p_name")).otherwise(F.concat(F.lit("Table "), n, F.lit(" "), "p_name"))
    rows = _parts(spark, d).withColumn("text", text).withColumn("split", names.caption_split(F.col("text"), F.when(kind == 3, "table").otherwise("figure")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "split.label", "split.caption", "split.status", names.caption_identity(F.col("text")).alias("identity"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS original_name, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 0 ELSE c_custkey % 3 END::BIGINT AS n_markers, CASE WHEN c_custkey % 3 = 0 THEN 'unchanged' ELSE 'normalized' END AS status FROM (SELECT c_custkey, c_mktsegment || ' ' || c_nationkey AS c_name FROM customer)")
def contributor_names(spark, d):
    """H2."""
    name = F.concat("c_mktsegment", F.lit(" "), _s("c_nationkey"))
    marked = F.concat(name, F.substring(F.lit("²†"), F.lit(1), (F.col("c_custkey") % 3).cast("int")))
    rows = table(spark, d, "customer").select("c_custkey", names.contributor(marked).alias("x"), name.alias("plain"))
    original = F.when(F.col("x.original_name") != "", F.col("plain")).otherwise("")
    return rows.select("c_custkey", original.alias("original_name"), "x.name", F.size("x.markers").cast("long").alias("n_markers"), "x.status")


@query("SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN p_size || '.' WHEN 1 THEN p_size || '.1' ELSE CASE WHEN level = 1 THEN top || '.' ELSE '' END END AS label, p_name AS title FROM (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey)::BIGINT AS top FROM (SELECT *, 1 + p_size % 3 AS level FROM part))")
def section_labels(spark, d):
    """Labels and titles of sections."""
    level, kind = 1 + F.col("p_size") % 3, F.col("p_partkey") % 3
    top = F.sum((level == 1).cast("int")).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    own = F.when(kind == 0, F.concat(_s("p_size"), F.lit("."))).otherwise("")
    title = F.when(kind == 0, F.concat(_s("p_size"), F.lit(". "), "p_name")).when(kind == 1, F.concat(_s("p_size"), F.lit(".1 "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", names.section_parts(own, title, level, top).alias("x"))
    return rows.select("p_partkey", "p_brand", "x.label", "x.title")


@query(r"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '\frac{' || l_linenumber || '}{' || l_suppkey || '}' || CASE WHEN l_partkey % 2 = 0 THEN 'x^{' || l_linenumber || '}' ELSE '' END AS latex, CASE WHEN l_partkey % 5 = 0 THEN 'partial' ELSE 'success' END AS status FROM lineitem")
def converted_formulas(spark, d):
    """Office math to LaTeX and MathML."""
    run = lambda t: F.concat(F.lit("<m:r><m:t>"), t, F.lit("</m:t></m:r>"))
    power = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("<m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup>"), run(_s("l_linenumber")), F.lit("</m:sup></m:sSup>"))).otherwise("")
    odd = F.when(F.col("l_partkey") % 5 == 0, "<m:phant><m:e/></m:phant>").otherwise("")
    text = F.concat(F.lit('<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:f><m:num>'), run(_s("l_linenumber")), F.lit("</m:num><m:den>"), run(_s("l_suppkey")), F.lit("</m:den></m:f>"), power, odd, F.lit("</m:oMath>"))
    rows = _lines(spark, d, "l_orderkey", "l_linenumber").withColumn("x", omml.omml_to_math(text))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.latex", F.col("x.conversion_status").alias("status"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '(' || l_linenumber || ')' AS label, 'x + ' || l_suppkey AS content, CASE WHEN l_partkey % 2 = 0 THEN 'normalized' ELSE 'normalized' END AS status FROM lineitem")
def formula_labels(spark, d):
    """A formula's number, and the copy of its LaTeX, out of its text."""
    bare = F.concat(F.lit("x + "), _s("l_suppkey"))
    text = F.concat(bare, F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" x+"), _s("l_suppkey"))).otherwise(""), F.lit(" ("), _s("l_linenumber"), F.lit(")"))
    rows = table(spark, d, "lineitem").withColumn("x", names.formula_form(text, bare, F.lit("")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.label", "x.content", "x.status")


@query("SELECT p_partkey, p_brand || ', ' || p_type AS authors, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE (p_partkey % 9 + 1)::VARCHAR END AS label, p_name || ' University, Town' AS body, 'About ' || p_name AS abstract, 3::BIGINT AS n_values FROM part")
def front_matter(spark, d):
    """H4, H5, H7: affiliations, abstracts and values."""
    rows = table(spark, d, "part")
    body = F.concat("p_name", F.lit(" University, Town"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1 "), body)).otherwise(body)
    parts = names.affiliation_parts(text, F.col("p_partkey") % 9 + 1)
    abstract = names.clean_abstract(F.concat(F.lit("About "), "p_name", F.lit(" (Received: 1 May; accepted 2 June)")))
    values = names.split_values(F.concat("p_brand", F.lit("; "), "p_type", F.lit("、 "), "p_name"))
    return rows.select("p_partkey", F.concat_ws(", ", F.get(values, F.lit(0)), F.get(values, F.lit(1))).alias("authors"), parts["label"].alias("label"), parts["body"].alias("body"), abstract.alias("abstract"), F.size(values).cast("long").alias("n_values"))


def _articles(spark, d):
    """Articles made of orders: a line is a section and a reference, and a figure, table or formula by its flag."""
    c, n = F.col, F.col("l_linenumber")
    none = F.lit(None).cast("double")
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at")
    confidence = (n % 7 + 1) / F.lit(8.0)
    section = F.struct(at, F.struct(_s(n).alias("title"), F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("text"))).alias("paragraphs")).alias("x"))
    caption = F.when(n % 2 == 0, "").otherwise("Fig. 1 c")
    figure = F.when(c("l_returnflag") == "A", F.struct(at, F.struct(_s(n).alias("id"), caption.alias("caption"), F.lit("p").alias("path"), F.lit("").alias("preview_path"), confidence.alias("confidence"), F.lit("ok").alias("status")).alias("x")))
    rows_ = F.when(c("l_partkey") % 3 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("a"))))
    grid = F.when(c("l_returnflag") == "N", F.struct(at, F.struct(_s(n).alias("id"), F.lit("c").alias("caption"), rows_.alias("rows"), none.alias("confidence"), F.lit("odd").alias("status")).alias("x")))
    status = F.when(c("l_suppkey") % 3 == 0, "success").when(c("l_suppkey") % 3 == 1, "partial").otherwise("failed")
    content = F.when(c("l_partkey") % 2 == 0, "").otherwise("x")
    formula = F.when(c("l_returnflag") == "R", F.struct(at, F.struct(
        _s(n).alias("id"), F.lit("").alias("label"), content.alias("content"), F.lit("").alias("latex"), F.lit("").alias("mathml"), F.lit("").alias("path"), F.lit("plain_text").alias("type"), status.alias("conversion_status"),
        F.array(F.concat(F.lit("f"), _s(c("l_suppkey") % 2))).alias("unsupported_features"), F.lit(False).alias("conflict"), none.alias("confidence"), F.lit("warning").alias("status"),
    ).alias("x")))
    reference = F.struct(at, F.struct(_s(n).alias("id"), confidence.alias("parse_confidence")).alias("x"))
    listed = lambda column: F.transform(F.sort_array(F.collect_list(column)), lambda y: y["x"])
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(listed(section).alias("sections"), listed(figure).alias("figures"), listed(grid).alias("tables"), listed(formula).alias("formulas"), listed(reference).alias("references"))
    o = c("l_orderkey")
    strings = lambda k, t: F.array_repeat(F.lit(t), k.cast("int"))
    return rows.select(
        "l_orderkey", F.when(o % 2 == 0, "t").otherwise("").alias("title"), F.lit("a").alias("abstract"), F.lit("j").alias("journal_title"), F.when(o % 5 == 0, "").otherwise("p").alias("publisher_name"),
        strings(o % 4, "k").alias("keywords"), strings(o % 2, "u").alias("affiliations"), F.array(F.struct(F.lit("n").alias("name"), F.lit("").alias("orcid"), F.lit("normalized").alias("normalization_status"))).alias("authors"),
        "sections", "figures", "tables", "formulas", "references",
        F.struct((o % 11 != 0).alias("xml_well_formed"), F.when(o % 3 == 0, True).when(o % 3 == 1, False).alias("jats_schema_valid"), strings(o % 8, "e").alias("schema_errors"), strings(o % 3, "bad").alias("errors"), strings(o % 6, "交叉引用目标不存在").alias("warnings"), strings(o % 2, "检查通过").alias("xref_checks")).alias("validation"),
    )


@query("""WITH x AS (SELECT l_orderkey AS o, count(*) AS n, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) AS empty, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS nf, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS nt, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS nm,
sum(CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 1 OR l_returnflag = 'N' AND l_partkey % 3 <> 0 THEN 1 ELSE 0 END) AS good,
sum(CASE WHEN l_returnflag <> 'R' THEN 0 WHEN l_suppkey % 3 = 0 THEN 1.0 WHEN l_suppkey % 3 = 1 THEN 0.75 WHEN l_partkey % 2 = 1 THEN 0.25 ELSE 0 END)::DOUBLE AS earned, sum((l_linenumber % 7 + 1) / 8.0)::DOUBLE AS trust, sum(CASE WHEN l_linenumber % 7 < 3 THEN 1 ELSE 0 END) AS weak,
count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey % 2 END) AS kinds FROM lineitem GROUP BY 1),
s AS (SELECT *, round_even(100.0 * (4 + CASE WHEN o % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN o % 4 > 0 THEN 1 ELSE 0 END + CASE WHEN o % 2 > 0 THEN 1 ELSE 0 END - 1) / 7, 0)::INT AS metadata_score,
greatest(30, round_even((n - empty * 0.5) * 100.0 / n, 0))::INT AS structure_score, (CASE WHEN o % 11 = 0 THEN 0 WHEN o % 3 = 2 THEN 60 WHEN o % 3 = 0 THEN 100 ELSE greatest(10, 60 - least(50, 10 * (o % 8))) END)::INT AS jats_schema_score,
(CASE WHEN nf + nt = 0 THEN 100 ELSE round_even(100.0 * good / (nf + nt), 0) END)::INT AS figure_table_score, (CASE WHEN nm = 0 THEN 100 ELSE round_even(100.0 * earned / nm, 0) END)::INT AS formula_score, round_even(100.0 * trust / n, 0)::INT AS reference_score, greatest(0, 100 - 25 * (o % 6))::INT AS xref_score FROM x),
t AS (SELECT *, round_even((20 * metadata_score + 15 * structure_score + 20 * jats_schema_score + 10 * figure_table_score + 10 * formula_score + 15 * reference_score + 10 * xref_score) / 100.0 - least(30, 10 * (o % 3)), 0)::INT AS raw FROM s)
SELECT o AS l_orderkey, metadata_score, structure_score, jats_schema_score, figure_table_score, formula_score, reference_score, xref_score, greatest(0, least(100, raw))::INT AS total_score, CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'B' WHEN raw >= 70 THEN 'C' WHEN raw >= 60 THEN 'D' ELSE 'E' END AS grade, (nf + nt + nm)::BIGINT AS evidence_total, nt::BIGINT AS evidence_review, nm::BIGINT AS evidence_warning, kinds::BIGINT AS n_unsupported, (o % 6)::BIGINT AS missing,
((CASE WHEN o % 11 = 0 THEN 1 WHEN o % 3 = 1 THEN o % 8 ELSE 0 END) + CASE WHEN o % 3 > 0 THEN o % 3 ELSE 0 END)::BIGINT AS n_errors, weak::BIGINT AS n_suggestions,
(o % 3 = 0 AND o % 11 <> 0) AS passed FROM t""")
def quality_reports(spark, d):
    """The whole report of an article."""
    rows = scorer.scored(_articles(spark, d))
    return rows.select(
        "l_orderkey", *scorer.SCORES, "total_score", "grade", *(F.col(f"structure_evidence.{k}").cast("long").alias(f"evidence_{n}") for k, n in (("total", "total"), ("need_review", "review"), ("warning", "warning"))),
        F.size("formula_summary.unsupported_features").cast("long").alias("n_unsupported"), F.col("xref_summary.missing").cast("long").alias("missing"), F.col("summary.error_count").cast("long").alias("n_errors"),
        F.col("summary.suggestion_count").cast("long").alias("n_suggestions"), scorer.passed(F.col("validation.errors"), F.col("validation.xml_well_formed")).alias("passed"),
    )


@query("""SELECT l_orderkey, (CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_errors, (CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END + 1 + sum(CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 1 WHEN l_returnflag = 'N' AND l_partkey % 3 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_suppkey % 3 <> 0 THEN 1 ELSE 0 END ELSE 0 END)
+ sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) + CASE WHEN l_orderkey % 4 < 3 THEN 1 ELSE 0 END)::BIGINT AS n_warnings, sum(CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS bare_figures, coalesce(sum(CASE WHEN l_returnflag = 'N' AND l_partkey % 3 <> 0 THEN 1 END), 0)::BIGINT AS table_rows FROM lineitem GROUP BY l_orderkey""")
def content_checks(spark, d):
    """Errors and warnings of an article's content, and how it shows."""
    rows = _articles(spark, d).withColumn("shown", scorer.presentation_warnings())
    return rows.select(
        "l_orderkey", F.size(scorer.required_content()).cast("long").alias("n_errors"), F.size(scorer.content_warnings()).cast("long").alias("n_warnings"),
        F.size(F.filter("shown.figures", lambda x: F.array_contains(x["missing"], "caption"))).cast("long").alias("bare_figures"),
        F.aggregate("shown.tables", F.lit(0).cast("long"), lambda s, x: s + x["rows"]).alias("table_rows"),
    )


@query("""WITH e AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position, CASE l_partkey % 7 WHEN 0 THEN '../x' WHEN 1 THEN '[Content_Types].xml' WHEN 2 THEN 'word/document.xml' ELSE 'word/media/' || l_partkey END AS name, l_suppkey % 50 = 7 AS encrypted, (l_quantity * 2000000)::BIGINT AS size, CASE WHEN l_partkey % 11 = 0 THEN 10 ELSE 1000000 END AS compressed FROM lineitem),
r AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY position) AS running FROM e), f AS (SELECT *, CASE WHEN name LIKE '../%' THEN 'unsafe path' WHEN encrypted THEN 'encrypted' WHEN size > 67108864 THEN 'large entry' WHEN name LIKE '%.xml' AND size > 25165824 THEN 'large xml' WHEN running > 262144000 THEN 'large archive' WHEN size >= 1048576 AND size > 200 * compressed THEN 'compression ratio' END AS reason FROM r)
SELECT l_orderkey::VARCHAR AS doc_id, coalesce(arg_min(reason, position) FILTER (reason IS NOT NULL), CASE WHEN count(DISTINCT CASE WHEN name IN ('[Content_Types].xml', 'word/document.xml') THEN name END) < 2 THEN 'incomplete' ELSE '' END) AS reason FROM f GROUP BY l_orderkey""")
def archive_inspection(spark, d):
    """Entries of archives, and why one is refused."""
    c = F.col
    kind = c("l_partkey") % 7
    entries = table(spark, d, "lineitem").select(
        _s("l_orderkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("position"),
        F.when(kind == 0, "../x").when(kind == 1, "[Content_Types].xml").when(kind == 2, "word/document.xml").otherwise(F.concat(F.lit("word/media/"), _s("l_partkey"))).alias("name"),
        (c("l_quantity") * 2_000_000).cast("long").alias("size"), F.when(c("l_partkey") % 11 == 0, 10).otherwise(1_000_000).cast("long").alias("compressed"), (c("l_suppkey") % 50 == 7).alias("encrypted"), F.lit(True).alias("readable"),
    )
    return inspected(entries)


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'figure_caption' WHEN 2 THEN 'formula' WHEN 3 THEN 'reference' ELSE 'unknown' END AS kind, CASE user_id % 5 WHEN 0 THEN 'front/article-meta/title-group/article-title' WHEN 1 THEN 'body/sec/fig/caption' WHEN 2 THEN 'body/sec/disp-formula' WHEN 3 THEN 'back/ref-list/ref' ELSE 'body/sec/p' END AS path, (CASE user_id % 5 WHEN 0 THEN 98 WHEN 4 THEN 35 ELSE 88 END)::INT AS confidence, CASE user_id % 5 WHEN 4 THEN 'need_review' ELSE 'ok' END AS status FROM events")
def node_mapping(spark, d):
    """Where a block goes in JATS, and how sure that is."""
    kind = F.get(F.array(*map(F.lit, ("title", "figure_caption", "formula", "reference", "other"))), (F.col("user_id") % 5).cast("int"))
    known = F.when(kind == "other", "unknown").otherwise(kind)
    rows = table(spark, d, "events").select("event_id", known.alias("kind"), blocks.jats_path(kind).alias("p"), blocks.default_confidence(known).alias("c"))
    return rows.select("event_id", "kind", F.concat_ws("/", "p.path", "p.tag").alias("path"), "c.confidence", "c.status")


@query("WITH n AS (SELECT l_orderkey, l_linenumber - 1 AS flow_index, 'fig' || l_linenumber AS target FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'fig' || (1 + l_partkey % 12) AS named FROM lineitem), f AS (SELECT l_orderkey, min(flow_index) AS first FROM n GROUP BY 1) SELECT i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, coalesce(n.flow_index, f.first)::BIGINT AS flow_index FROM i LEFT JOIN n ON n.l_orderkey = i.l_orderkey AND n.target = i.named JOIN f ON f.l_orderkey = i.l_orderkey")
def located_issues(spark, d):
    """Issues at the blocks that they name, whole words only (fig1 is not fig10), else at the first block."""
    rows = table(spark, d, "lineitem")
    nodes = rows.select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("flow_index"), F.concat(F.lit("fig"), _s("l_linenumber")).alias("target"), F.lit(None).cast("int").alias("section_at"), F.lit("").alias("field")).distinct()
    issues = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("article.figures.fig"), _s(1 + F.col("l_partkey") % 12)).alias("location"))
    return views.located(issues, views.located_nodes(nodes, "l_orderkey"), "l_orderkey").drop("location")


@query("WITH i AS (SELECT user_id, event_id, 'at ' || event_type AS location FROM events), o AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0) SELECT user_id, event_id FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = i.user_id AND contains(i.location, o.event_type))")
def unlocated_issues(spark, d):
    """C14, M: issues that name no object of their document."""
    events = table(spark, d, "events")
    issues = events.select("user_id", "event_id", F.concat(F.lit("at "), "event_type").alias("location"))
    return views.unlocated(issues, events.filter("event_id % 3 = 0").select("user_id", "event_type").distinct(), "user_id", "event_type").select("user_id", "event_id")


@query("SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderkey % 4 > 0 THEN 1 ELSE 0 END)::BIGINT AS succeeded, bool_and(o_orderkey % 4 > 0) AS all_succeeded, min(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END) AS first_success, count(*) <= 20 AS within_limit, greatest(0, 10 - count(*))::BIGINT AS passed_checks FROM orders GROUP BY 1")
def batches(spark, d):
    """D30, F10, M: batches of conversions."""
    return views.batch_summary(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderkey") % 4 > 0).withColumn("passed_checks", views.passed_checks(F.col("n")))


@query("SELECT o_custkey, count(*) AS sample_count, round_even(avg(88 + o_orderkey % 13), 1)::DOUBLE AS average_score, min(88 + o_orderkey % 13)::BIGINT AS minimum_score, CASE WHEN min(88 + o_orderkey % 13) >= 90 THEN 'success' ELSE 'warning' END AS bucket FROM orders GROUP BY 1 HAVING avg(88 + o_orderkey % 13) >= 93.95 AND min(88 + o_orderkey % 13) >= 90 AND round_even(avg(88 + o_orderkey % 13), 1) >= 94")
def accepted_runs(spark, d):
    """D21, D22, M: runs that reach the floors of 94, 90 and 1.0."""
    score = 88 + F.col("o_orderkey") % 13
    runs = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("sample_count"), F.bround(F.avg(score), 1).alias("average_score"), F.min(score).alias("minimum_score"), F.lit(1.0).alias("schema_pass_rate"))
    return comparator.accepted(runs).drop("schema_pass_rate").withColumn("bucket", comparator.score_bucket(F.col("minimum_score")))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '!' END, c_mktsegment) AS c_mktsegment, c_nationkey FROM customer")
def corrections(spark, d):
    """M: editors' values over the articles'."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    edits = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("c_mktsegment"))
    return views.corrected(rows, edits, "c_custkey", ["c_mktsegment"])


@query("WITH RECURSIVE f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, CASE l_suppkey % 3 WHEN 0 THEN 'a.png' WHEN 1 THEN 'a_2.png' ELSE 'b' END AS name FROM lineitem), r AS (SELECT l_orderkey, 0::BIGINT AS place, ''::VARCHAR AS name, []::VARCHAR[] AS used FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, place, free, list_append(used, free) FROM (SELECT f.l_orderkey, f.place, r.used, list_filter(list_transform(range(1, len(r.used) + 2), lambda n: CASE WHEN n = 1 THEN f.name ELSE regexp_extract(f.name, '^([^.]*)', 1) || '_' || n || regexp_extract(f.name, '([.].*)?$', 1) END), lambda t: NOT list_contains(r.used, t))[1] AS free FROM r JOIN f ON f.l_orderkey = r.l_orderkey AND f.place = r.place + 1)) SELECT l_orderkey, place, name FROM r WHERE place > 0")
def package_names(spark, d):
    """Names in a package, none twice."""
    kind = F.col("l_suppkey") % 3
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    rows = table(spark, d, "lineitem").select("l_orderkey", place.alias("place"), F.when(kind == 0, "a.png").when(kind == 1, "a_2.png").otherwise("b").alias("name"))
    return packages.unique_names(rows, "l_orderkey", "place", "name", "name")


def _text_ratio(spark, d):
    """How like a turn is to the next one, by the sequence matcher and by words."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("next", F.lead("text").over(order)).filter("next IS NOT NULL")
    ratio = comparator.text_ratio(comparator.normalized(F.col("text")), comparator.normalized(F.col("next")))
    return rows.select("conv_id", "turn", F.round(ratio, 9).alias("ratio"), F.round(comparator.token_score(F.col("text"), F.col("next")), 9).alias("tokens"))


def _documents_as_nodes(spark, d):
    lines = line_blocks(table(spark, d, "documents"))
    bold = F.col("flow_index") % 7 == 0
    rows = lines.select(_s("doc_id").alias("doc_id"), F.col("flow_index").cast("int").alias("flow_index"), F.col("flow_index").cast("int").alias("paragraph_index"), F.lit(None).cast("int").alias("table_index"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("style"), F.lit("").alias("alignment"), bold.alias("bold"), F.lit(10.0).alias("font_size"))
    kind = blocks.paragraph_type(F.col("text"), F.col("style"), F.col("bold"), F.lit(False))
    return rows.withColumn("type", kind).withColumn("rows", F.lit(None).cast("array<array<string>>")).withColumn("media_path", F.lit("")).withColumn("math", F.struct(F.lit("").alias("mathml"), F.lit("").alias("latex")))


def _documents_as_articles(spark, d):
    """E1-E10, A20, J, K3-K8, D2: documents through assembly, generator, checks and scores."""
    done = scorer.scored(surface.regenerate(assembly.articles(_documents_as_nodes(spark, d))))
    return done.select("doc_id", F.size("sections").alias("n_sections"), F.size("keywords").alias("n_keywords"), F.length("jats").alias("length"), F.col("validation.xml_well_formed").alias("well_formed"), F.col("validation.jats_schema_valid").alias("valid"), "total_score", "grade")


#: Beyond SQL: the sequence matcher, and a fold with state; tests hold them against plain versions and literal cases.
ROWS_ONLY = {"text_ratios": _text_ratio, "documents_as_articles": _documents_as_articles}
