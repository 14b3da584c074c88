"""From the ordered blocks of documents to articles: front matter, sections, floats, formulas, references.

What a block is, and what its neighbours make of it, is Column expressions and windows by document (roles). Only the
assembly, whose state feeds back into itself (which caption waits, whether references have begun), is a fold in order,
one document at a time, over rows that already carry their roles; documents are the groups, and none is large.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import blocks as rules
from ..functions import citations, names
from ..functions._udf import send_package
from ..sinks.jats import ARTICLE

# Fixed values.
TYPE_LABELS = ["original research", "research article", "original article", "review", "review article", "case report", "short communication", "editorial", "letter", "protocol", "article"]
AUTHOR_LABELS = ["author", "authors", "author information", "author details"]
BEFORE_BODY = ["abbreviations", "abbreviations and acronyms"]
CONTINUES = (
    r"(?i)^\s*(?:(?:The\s+)?[xy]-axis\b|(?:Error\s+bars?|Bars?|Whiskers?|Dots?|Circles?|Squares?|Triangles?)\b|(?:Solid|Dashed|Dotted)\s+(?:line|curve|bar)s?\b|(?:Data|Values|Results)\s+(?:are|were|represent|show)\b"
    r"|(?:Panels?|Plots?)\s+[A-Z](?:\s*[-–]\s*[A-Z])?\b|(?:Note|Notes|Abbreviations?)\s*[:.]|(?:[A-Z][A-Za-z0-9()/ -]{1,40})\s*:\s*[a-z]|[*†‡]\s+|注[:：]|说明[:：])"
)
PANELS = r"(?i)(?:\([A-Za-z]\s*[-–]\s*[A-Za-z]\)|\bpanels?\b|\bplots?\b)"
TABLE_WORDS = r"(?i)\b(?:table|characteristics|baseline|comparison|summary|results|parameters|data|values|statistics)\b"
FOLDED = """doc_id string, title string, abstract string, keywords array<string>, authors array<string>, affiliations array<string>,
sections array<struct<label:string,title:string,level:int,paragraphs:array<string>>>, figures array<struct<id:string,caption:string,paths:array<string>,section_index:int>>,
tables array<struct<id:string,caption:string,rows:array<array<string>>,notes:array<string>,path:string,section_index:int>>, lists array<struct<id:string,items:array<string>,section_index:int>>,
formulas array<struct<id:string,label:string,type:string,content:string,latex:string,mathml:string,path:string,section_index:int>>, entries array<string>, dropped array<int>"""


def title_score(c) -> Column:
    """How much a paragraph looks like the title."""
    text, style = F.trim(c("text")), F.lower(c("style"))
    lower = F.lower(text)
    hits = sum((lower.contains(w).cast("int") for w in rules.AFFILIATION_NOUNS), F.lit(0))
    points = [
        (c("alignment") == "center", 4), (c("bold"), 3), (c("type") == "title", 5), (style.contains("title") & ~style.contains("type"), 10),
        (style.contains("articletype") | F.trim(lower, F.lit(" .:")).isin(TYPE_LABELS), -12), ((hits >= 2) | ((hits > 0) & text.rlike(r"^\s*(?:\d+|[a-z])(?:[\s.)]|(?=[A-Z]))")), -8),
        (lower.rlike("correspondence|orcid"), -10), (F.length(text).between(4, 45), 2), (F.length(text).between(46, 350), 3),
        ((c("paragraph_index") == 0) & (F.length(text) >= 20) & c("type").isin("title", "heading"), 3), (text.rlike(rules.ABSTRACT) | text.rlike(rules.KEYWORDS), -8),
    ]
    return sum((F.when(test, p).otherwise(0) for test, p in points), F.lit(0.0)) + F.least(F.coalesce(c("font_size"), F.lit(0.0)) / 4, F.lit(5.0))


def prepared(nodes: DataFrame) -> DataFrame:
    """Formula numbers after a formula's image, captions that bind to the table behind, captions without a label,
    and legends of figures that came as tables; a window of four blocks on either side."""
    c, by = F.col, W.partitionBy("doc_id").orderBy("flow_index")
    filled = (c("type") == "table") | (F.trim(F.coalesce("text", F.lit(""))) != "")
    seen = F.when(filled, F.struct("flow_index", "type", "text"))
    rows = nodes.withColumn("after", F.first(seen, ignorenulls=True).over(by.rowsBetween(1, 4))).withColumn("before", F.last(seen, ignorenulls=True).over(by.rowsBetween(-4, -1)))
    label = r"^\s*\(\s*\d+\s*\)\s*$"
    takes = (c("type") == "formula_image") & ~c("text").rlike(rules.EQUATION_NUMBER) & F.coalesce(c("after.text").rlike(label), F.lit(False))
    rows = rows.withColumn("takes", F.when(takes, c("after.flow_index"))).withColumn("taken", F.max("takes").over(by.rowsBetween(-4, -1)) == c("flow_index"))
    implicit = (c("type") == "paragraph") & (c("after.type") == "table") & rules.is_implicit_table_caption(c("text"), TABLE_WORDS)
    forward = implicit | ((c("type") == "table_caption") & (c("after.type") == "table") & F.coalesce(c("before.type") != "table", F.lit(True)))
    rows = rows.withColumn("text", F.when(takes, F.trim(F.concat_ws(" ", F.trim("text"), F.trim("after.text")))).otherwise(c("text")))
    rows = rows.withColumn("forward", F.coalesce(forward, F.lit(False))).withColumn("type", F.when(c("taken"), "formula_label").when(F.coalesce(implicit, F.lit(False)), "table_caption").otherwise(c("type")))
    # A small table whose next filled block that is no table is a figure's caption, within four, is its legend.
    ahead = F.first(F.when(filled & (c("type") != "table"), c("type")), ignorenulls=True).over(by.rowsBetween(1, 4))
    legend = (c("type") == "table") & F.coalesce(rules.is_figure_legend(c("rows")), F.lit(False)) & (ahead == "figure_caption") & F.coalesce(c("before.type") != "table_caption", F.lit(True))
    return rows.withColumn("type", F.when(F.coalesce(legend, F.lit(False)), "figure_legend").otherwise(c("type"))).drop("after", "before", "takes", "taken")


def with_front(nodes: DataFrame) -> DataFrame:
    """Role: title, author, affiliation or front of the blocks before the abstract or keywords, else null."""
    c = F.col
    prose = c("paragraph_index").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    by = W.partitionBy("doc_id")
    place = F.when(prose, F.sum(prose.cast("int")).over(by.orderBy("flow_index")))
    rows = nodes.withColumn("place", place)
    best = F.max(F.when(c("place") <= 10, F.struct(title_score(c).alias("score"), (-c("flow_index")).alias("at")))).over(by)
    rows = rows.withColumn("title_at", -best["at"])
    mark = prose & (c("flow_index") > c("title_at")) & (c("text").rlike(rules.ABSTRACT) | c("text").rlike(rules.KEYWORDS))
    rows = rows.withColumn("edge", F.coalesce(F.min(F.when(mark, c("flow_index"))).over(by), c("title_at") + 1))
    inside = prose & (c("flow_index") > c("title_at")) & (c("flow_index") < c("edge"))
    closed = F.max(F.when(inside & F.lower("text").rlike("correspond|orcid|academic editor"), 1).otherwise(0)).over(by.orderBy("flow_index"))
    affiliation = inside & (closed == 0) & rules.is_affiliation(c("text"), c("style"))
    rows = rows.withColumn("affiliation", F.coalesce(affiliation, F.lit(False))).withColumn("people", F.when(inside & ~c("affiliation"), names.author_names(c("text"), AUTHOR_LABELS)))
    first = F.min(F.when(F.size("people") > 0, c("flow_index"))).over(by)
    role = F.when(c("flow_index") == c("title_at"), "title").when(c("affiliation"), "affiliation").when(c("flow_index") == first, "author").when(c("flow_index") < c("edge"), F.when(c("type").isin("image", "table"), None).otherwise("front"))
    return rows.withColumn("role", role).drop("place", "title_at", "edge", "affiliation")


def with_roles(nodes: DataFrame) -> DataFrame:
    """What each block is to the fold: E4's marks, captions, sections, and what continues them."""
    c = F.col
    text = F.trim(F.coalesce(c("text"), F.lit("")))
    rows = with_front(prepared(nodes)).withColumn("text", text)
    rows = rows.withColumn("section", rules.section_title(c("text"), c("style"), c("type"))).withColumn("heading", rules.normalized_heading(c("text")))
    cells = names.table_row(c("text"))
    numbers = F.size(F.filter(cells, lambda x: x.rlike(r"\d")))
    row_of = (F.length("text") <= 220) & (F.size(cells) >= 3) & ((F.lower("text").contains("month") & (numbers >= 2)) | (c("text").rlike(r"^\s*[\d<>=+-]+(?:\s+|$)") & (numbers >= 3)))
    deep = (c("type") == "heading") & (F.trim("style") == "") & ~c("heading").isin(rules.SUBHEADINGS) & ~c("text").rlike(r"^\d+(?:\.\d+)*\.?\s+|^[●•]")
    marked = (
        F.when(c("role").isNotNull(), c("role")).when(c("type").isin("image", "table", "formula_image"), c("type")).when(c("type").isin("figure_legend", "formula_label"), "skip").when(c("text").rlike(rules.REFERENCES), "references")
        .otherwise("text")
    )
    return rows.select(
        "doc_id", "flow_index", "type", "style", "text", "rows", "media_path", "forward", "people", F.col("math.mathml").alias("mathml"), F.col("math.latex").alias("latex"), marked.alias("mark"), "section", "heading",
        rules.is_back_heading(c("text")).alias("back"), c("text").rlike(rules.KEYWORDS).alias("keywords"), c("text").rlike(rules.ABSTRACT).alias("abstract"), names.split_values(F.regexp_replace("text", rules.KEYWORDS, "")).alias("values"),
        F.regexp_replace("text", rules.ABSTRACT, "").alias("rest"), (c("text").rlike(CONTINUES) & (F.length("text") <= 700) & c("type").isin("paragraph", "heading")).alias("continues"), c("text").rlike(PANELS).alias("panels"),
        F.when(row_of & c("type").isin("paragraph", "heading"), cells).alias("cells"), rules.is_table_note(c("text")).alias("note"), deep.alias("deep"), (c("text").rlike(citations.LABEL)).alias("labelled"),
        rules.is_unlabeled_reference(c("text")).alias("unlabelled"), rules.is_reference_continuation(c("text")).alias("goes_on"), F.trim(F.regexp_replace("text", rules.LIST, "")).alias("item"),
    )


class Assembly:
    """E5: one document's blocks in order; each method takes a block of its kind."""

    def __init__(self) -> None:
        self.article = {"title": "", "keywords": [], "authors": [], "affiliations": [], "sections": [], "figures": [], "tables": [], "lists": [], "formulas": [], "entries": [], "dropped": []}
        self.abstract: list[str] = []
        self.phase = "front"  # then abstract, body, back or references
        self.awaits_keywords = False
        self.waiting = {"figures": [], "tables": []}  # captions without a body
        self.bare = {"figures": [], "tables": []}  # bodies without a caption
        self.target = self.risk_table = self.last_table = None

    @property
    def here(self) -> int:
        return len(self.article["sections"]) - 1

    def settle(self) -> None:
        self.target = self.risk_table = self.last_table = None

    def first_here(self, queue: list[dict]) -> dict | None:
        """The first one waiting in this section."""
        found = next((x for x in queue if x["section_index"] == self.here), None)
        if found is not None:
            queue[:] = [x for x in queue if x is not found]
        return found

    def put(self, kind: str, **fields) -> dict:
        """A new float."""
        item = {"id": "", "caption": "", "section_index": self.here} | ({"paths": []} if kind == "figures" else {"rows": [], "notes": [], "path": ""}) | fields
        self.article[kind].append(item)
        return item

    def take(self, b: dict) -> None:
        mark = b["mark"]
        if mark in ("title", "author", "affiliation"):
            field = {"title": "title", "author": "authors", "affiliation": "affiliations"}[mark]
            self.article[field] = b["text"] if mark == "title" else list(b["people"]) if mark == "author" else [*self.article[field], *([b["text"]] if b["text"] not in self.article[field] else [])]
        elif mark in ("image", "table", "formula_image"):
            self.end_abstract()
            getattr(self, f"on_{mark}")(b)
        elif mark == "references":
            self.phase, self.awaits_keywords = "references", False
            self.settle()
        elif mark == "text" and (b["text"] or b["type"] in ("formula", "list")):
            self.on_text(b)

    def end_abstract(self) -> None:
        if self.phase == "abstract":
            self.phase = "front"

    def on_image(self, b: dict) -> None:
        if self.here < 0 or self.phase == "back":
            self.article["dropped"].append(b["flow_index"])  # front matter's and publisher's pictures are no figures
            return
        waiting = self.first_here(self.waiting["figures"])
        if waiting is not None:
            waiting["paths"].append(b["media_path"])
        else:
            self.bare["figures"].append(self.put("figures", paths=[b["media_path"]], at=b["flow_index"]))

    def on_table(self, b: dict) -> None:
        rows = [list(r) for r in b["rows"]]
        self.target, self.risk_table = (None if self.target and self.target in self.article["tables"] else self.target), None
        waiting = self.first_here(self.waiting["tables"])
        if waiting is None:
            self.last_table = self.put("tables", rows=rows, at=b["flow_index"])
            self.bare["tables"].append(self.last_table)
            return
        waiting["rows"], self.last_table = rows, waiting
        between = [f for f in self.bare["figures"] if f["section_index"] == self.here and waiting["at"] < f["at"] < b["flow_index"]]
        if len(between) == 1:  # C6: the picture of this table
            waiting["path"] = between[0]["paths"][0]
            self.drop_figure(between[0])

    def drop_figure(self, figure: dict) -> None:
        for queue in (self.article["figures"], self.bare["figures"]):
            queue[:] = [f for f in queue if f is not figure]

    def on_formula_image(self, b: dict) -> None:
        self.settle()
        number = re.search(r"\(\s*\d+\s*\)", b["text"])
        self.formula(b, type="image_formula", path=b["media_path"], label=re.sub(r"\s", "", number[0]) if number else "")

    def formula(self, b: dict, **fields) -> None:
        self.article["formulas"].append({"id": "", "label": "", "type": "plain_text", "content": b["text"], "latex": "", "mathml": "", "path": "", "section_index": self.here} | fields)

    def on_text(self, b: dict) -> None:
        if self.phase == "references":
            self.reference(b)
        elif b["back"] and self.here >= 0:
            self.phase = "back"
            self.settle()
        elif self.phase == "back":
            self.article["dropped"].append(b["flow_index"])
        elif b["keywords"] or self.awaits_keywords:
            self.end_abstract()
            self.article["keywords"], self.awaits_keywords = list(b["values"]), b["keywords"] and not len(b["values"])
            self.settle()
        elif b["abstract"]:
            self.phase = "abstract"
            self.abstract += [b["rest"]] if b["rest"] else []
            self.settle()
        elif self.here < 0 and b["heading"] in BEFORE_BODY:
            self.end_abstract()
        elif b["type"] in ("figure_caption", "table_caption"):
            self.end_abstract()
            self.caption(b, "figures" if b["type"] == "figure_caption" else "tables")
        elif self.target is not None and self.target["section_index"] == self.here and b["continues"] and not b["section"]["level"]:
            self.target["caption"] = f"{self.target['caption'].rstrip()} {b['text']}"
        elif self.target is not None and self.target in self.article["figures"] and self.target["section_index"] == self.here and b["cells"] is not None:
            if self.risk_table is None:  # E18
                self.risk_table = self.put("tables", caption="Patients at risk")
            self.risk_table["rows"].append(list(b["cells"]))
        else:
            self.prose(b)

    def reference(self, b: dict) -> None:
        """In a numbered list, lines without a number go on with the entry before, or are entries of their own."""
        entries, numbered = self.article["entries"], bool(self.article["entries"]) and bool(re.match(citations.LABEL, self.article["entries"][0]))
        if numbered and not b["labelled"] and b["unlabelled"]:
            entries.append(f"[{len(entries) + 1}] {b['text']}")
        elif numbered and not b["labelled"] and b["goes_on"]:
            entries[-1] += f" {b['text']}"
        else:
            entries.append(b["text"])

    def caption(self, b: dict, kind: str) -> None:
        self.risk_table = self.last_table = None
        bare = [f for f in self.bare["figures"] if f["section_index"] == self.here] if kind == "figures" else []
        if len(bare) > 1 and b["panels"]:
            for other in bare[1:]:
                bare[0]["paths"] += other["paths"]
                self.drop_figure(other)
        found = None if b["forward"] else self.first_here(self.bare[kind])
        if found is None:
            found = self.put(kind, at=b["flow_index"])
            self.waiting[kind].append(found)
        found["caption"], self.target = b["text"], found

    def prose(self, b: dict) -> None:
        if b["note"] and self.last_table is not None and self.last_table["rows"]:
            self.last_table["notes"].append(b["text"])  # and it stays in the text
        sections, title = self.article["sections"], b["section"]
        if b["deep"] and sections and sections[-1]["level"] >= 3:
            sections[-1]["paragraphs"].append(b["text"])
        elif title["level"]:
            level = min(6, sections[-1]["level"] + 1) if sections and b["text"][:1] in "●•" else int(title["level"])
            sections.append({"label": title["label"], "title": title["title"], "level": level, "paragraphs": []})
            self.phase = "body"
        elif self.phase == "abstract":
            self.abstract.append(b["text"])
            return
        elif b["type"] == "list":
            self.article["lists"].append({"id": "", "items": [b["item"] or b["text"]], "section_index": self.here})
        elif b["type"] == "formula":
            self.formula(b, type="omml" if b["mathml"] else "plain_text", latex=b["latex"] or "", mathml=b["mathml"] or "")
        elif sections:
            sections[-1]["paragraphs"].append(b["text"])
        else:
            self.article["dropped"].append(b["flow_index"])
            return
        self.settle()

    def done(self, doc_id: str) -> dict:
        a = self.article
        for kind, prefix in (("figures", "fig"), ("tables", "tab"), ("lists", "list"), ("formulas", "eq")):
            for n, x in enumerate(a[kind], 1):
                x["id"] = f"{prefix}{n}"
                x.pop("at", None)
        return {"doc_id": doc_id, "abstract": "\n".join(self.abstract)} | a


#: Articles that a task holds at most before it hands them on.
MOST_HELD = 200


def _folder(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fold over a task's blocks, which come document by document, each in order."""

    def articles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        doc_id, one = None, None
        for batch in batches:
            fields = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                b = dict(zip(fields, values))
                if one is None or b["doc_id"] != doc_id:
                    if one is not None:
                        yield one.done(doc_id)
                    doc_id, one = b["doc_id"], Assembly()
                one.take(b)
        if one is not None:
            yield one.done(doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for article in articles_of(batches):
            held.append(article)
            if len(held) == MOST_HELD:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def folded(nodes: DataFrame) -> DataFrame:
    """An article for each document, its references as texts of entries. The windows of the roles
    leave a document's blocks in one task; sorted, they pass through it one by one."""
    send_package(nodes.sparkSession)
    blocks = with_roles(nodes).sortWithinPartitions("doc_id", "flow_index")
    return blocks.mapInArrow(_folder(to_arrow_schema(StructType.fromDDL(FOLDED))), FOLDED)


def style_labels(sections: Column) -> Column:
    """Numbering of sections by their levels: a counter for each level, those below start anew; a section's own label
    sets the counters, and levels that were left out count 1."""
    zeros = F.array_repeat(F.lit(0), 6)

    def step(seen: Column, s: Column) -> Column:
        level, own = s["level"], F.filter(F.split(F.coalesce(s["label"], F.lit("")), r"\."), lambda p: p.rlike(r"^\d{1,4}$"))
        given = F.transform(own, lambda p: p.cast("int"))
        counted = F.transform(seen["counts"], lambda n, i: F.when(i + 1 == level, n + 1).when(i + 1 < level, F.greatest(n, F.lit(1))).otherwise(0))
        counts = F.when(F.size(given) > 0, F.transform(zeros, lambda z, i: F.coalesce(F.get(given, i), z))).otherwise(counted)
        label = F.when(F.coalesce(s["label"], F.lit("")) != "", s["label"]).otherwise(F.array_join(F.slice(counts, F.lit(1), level).cast("array<string>"), "."))
        return F.struct(counts.alias("counts"), F.concat(seen["out"], F.array(label)).alias("out"))

    return F.aggregate(sections, F.struct(zeros.alias("counts"), F.array().cast("array<string>").alias("out")), step, lambda seen: seen["out"])


def articles(nodes: DataFrame) -> DataFrame:
    """Articles as the generator takes them: names normalised, abstract cleaned, references parsed, sections numbered."""
    spark, rows = nodes.sparkSession, folded(nodes)
    # The fold runs once: a row for each entry, the article on its first one, and together again.
    others = [n for n in rows.columns if n not in ("doc_id", "entries")]
    entries = rows.select("doc_id", F.struct(*others).alias("article"), F.posexplode_outer("entries").alias("place", "entry"))
    entries = entries.withColumn("article", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("article")))
    parsed = citations.parsed_entries(entries, "entry")
    reference = F.struct("place", F.concat(F.lit("ref"), (F.col("place") + 1).cast("string")).alias("id"), "label", "raw", *citations.FIELDS)
    found = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), reference)))
    rows = parsed.groupBy("doc_id").agg(F.first("article", ignorenulls=True).alias("article"), found.alias("found")).select("doc_id", "article.*", "found")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], ARTICLE).schema}
    none = F.lit("")
    columns = {
        "abstract": names.clean_abstract(F.col("abstract")),
        "authors": F.transform("authors", lambda n: F.struct(names.contributor(n)["name"].alias("name"), none.alias("orcid"), F.array().cast("array<string>").alias("affiliation_ids"))),
        "references": F.coalesce(F.transform("found", lambda r: F.struct(*(r[f].alias(f) for f in ("id", "label", "raw", *citations.FIELDS)))), F.array().cast(kinds["references"])),
    }
    # The section's label from its level where it has none of its own.
    labels = style_labels(F.col("sections"))
    rows = rows.withColumn("_labels", labels)
    columns["sections"] = F.transform("sections", lambda s, i: s.withField("label", F.get(F.col("_labels"), i)))
    return rows.select("doc_id", *(columns.get(n, F.col(n) if n in rows.columns else none).cast(t).alias(n) for n, t in kinds.items()), "dropped")
