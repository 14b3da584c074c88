"""Word files as tables: archive entries, their inspection, media, and the ordered blocks of the body.

Files come as rows (doc_id, content). Archives and XML are opened in Arrow functions, a file at a time; what is read is
plain rows, and content is dropped at once, so that no later step moves it. Deciding what a block is happens outside,
by Column expressions. Limits are the studied system's defaults (fixed values).
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import blocks as rules
from ..functions._udf import send_package
from ..functions.omml import omml_to_math

MIB = 1 << 20
LIMITS = {"upload": 50 * MIB, "entries": 5000, "entry": 64 * MIB, "xml": 24 * MIB, "total": 250 * MIB, "ratio": 200}
REQUIRED = ["[Content_Types].xml", "word/document.xml"]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
ENTRIES = "doc_id string, position int, name string, size long, compressed long, encrypted boolean, readable boolean"
FEATURES = """doc_id string, position int, paragraph_index int, table_index int, text string, other_text string, style string, alignment string, bold boolean,
font_size double, numbered boolean, images array<string>, media array<string>, n_math int, math_paragraph boolean, omml string, rows array<array<string>>"""


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _each_file(raw: DataFrame, rows, schema: str) -> DataFrame:
    """Rows of every file; rows(doc_id, content) gives tuples in the schema's order."""
    send_package(raw.sparkSession)
    arrow = _arrow(schema, raw.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in found], schema=arrow)

    return raw.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schema)


def zip_entries(raw: DataFrame) -> DataFrame:
    """A5: the entries of each file's archive, in order; one row that is not readable for a file that is none."""

    def rows(doc: str, content: bytes | None):
        try:
            for k, e in enumerate(zipfile.ZipFile(io.BytesIO(content or b"")).infolist()):
                yield doc, k, e.filename.replace("\\", "/"), e.file_size, e.compress_size, bool(e.flag_bits & 1), True
        except zipfile.BadZipFile:
            yield doc, 0, "", 0, 0, False, False

    return _each_file(raw, rows, ENTRIES)


def inspected(entries: DataFrame, limits: dict[str, int] = LIMITS, required: list[str] = REQUIRED) -> DataFrame:
    """doc_id and reason, empty for a sound file; of several reasons that of the first entry that has one,
    in the order of the checks."""
    c, last = F.col, Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    reason = (
        F.when(~c("readable"), "not a zip").when(c("name").startswith("/") | F.array_contains(F.split("name", "/"), ".."), "unsafe path").when(c("encrypted"), "encrypted")
        .when(c("size") > limits["entry"], "large entry").when(c("name").endswith(".xml") & (c("size") > limits["xml"]), "large xml").when(c("running") > limits["total"], "large archive")
        .when((c("size") >= MIB) & (c("size") > limits["ratio"] * F.greatest(F.lit(1), c("compressed"))), "compression ratio")
    )
    rows = entries.withColumn("running", F.sum("size").over(last)).withColumn("reason", reason)
    held = F.size(F.array_intersect(F.collect_set(F.when(c("name").isin(required), c("name"))), F.array(*map(F.lit, required))))
    found = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("reason", F.when(c("reason").isNotNull(), c("position"))).alias("first"), held.alias("held"))
    return found.select("doc_id", F.when(c("n") > limits["entries"], "many entries").when(c("first").isNotNull(), c("first")).when(c("held") < len(required), "incomplete").otherwise("").alias("reason"))


def upload_reason(content: Column, name: Column, limits: dict[str, int] = LIMITS) -> Column:
    """Why a file is not taken, before its archive is opened; empty where it is."""
    suffix, head = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)), F.hex(F.substring(content, 1, 8))
    legacy = (head == "D0CF11E0A1B11AE1") | head.startswith("7B5C727466")  # OLE, or {\rtf
    return (
        F.when(content.isNull() | (F.length(content) == 0), "empty").when(F.length(content) > limits["upload"], "too large").when(~suffix.isin(".doc", ".docx"), "extension")
        .when((suffix == ".doc") & ~legacy, "not a doc").otherwise("")
    )


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    """An entry's tree; a DOCTYPE is refused."""
    if name not in archive.namelist():
        return None
    data = archive.read(name)
    return None if b"<!DOCTYPE" in data[:4096].upper() else ET.fromstring(data)


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag in (W + "t", M + "t")).strip()


def _value(node: ET.Element, path: str) -> str:
    found = node.find(path)
    return found.get(W + "val", "") if found is not None else ""


def _sizes(node: ET.Element) -> float:
    values = [s.get(W + "val", "") for p in node.iter(W + "rPr") for s in p.findall(W + "sz")]
    return max((int(v) / 2 for v in values if v.isdigit()), default=0.0)


def features(raw: DataFrame) -> DataFrame:
    """What the file says of each paragraph and table of the body, in order. A file that does not open has no rows."""

    def rows(doc: str, content: bytes | None):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
            tree, links = _xml(archive, "word/document.xml"), _xml(archive, "word/_rels/document.xml.rels")
        except (zipfile.BadZipFile, ET.ParseError):
            return
        body = tree.find(W + "body") if tree is not None else None
        target = {r.get("Id", ""): posixpath.normpath(posixpath.join("word", r.get("Target", ""))) for r in (links if links is not None else ()) if r.tag == RELS + "Relationship" and r.get("TargetMode") != "External"}
        paragraphs = tables = 0
        for position, node in enumerate(n for n in (body if body is not None else ()) if n.tag in (W + "p", W + "tbl")):
            if node.tag == W + "tbl":
                cells = [[_text(c) for c in r.findall(W + "tc")] for r in node.findall(W + "tr")]
                yield doc, position, None, tables, "", "", "", "", False, 0.0, False, [], [], 0, False, None, cells
                tables += 1
                continue
            math = list(node.iter(M + "oMath"))
            inside = {id(t) for m in math for t in m.iter()}
            other = "".join(t.text or "" for t in node.iter(W + "t") if id(t) not in inside).strip()
            images = [b.get(R + "embed") for b in node.iter(A + "blip") if b.get(R + "embed")]
            yield (
                doc, position, paragraphs, None, _text(node), other, _value(node, f".//{W}pPr/{W}pStyle"), _value(node, f".//{W}pPr/{W}jc"), any(p.find(W + "b") is not None for p in node.iter(W + "rPr")),
                _sizes(node), node.find(f".//{W}pPr/{W}numPr") is not None, images, [target.get(i, "") for i in images], len(math), node.find(f".//{M}oMathPara") is not None,
                ET.tostring(math[0], encoding="unicode") if math else None, None,
            )
            paragraphs += 1

    return _each_file(raw, rows, FEATURES)


def flow_nodes(raw: DataFrame) -> DataFrame:
    """The blocks of each body in order, one for each image of a paragraph, with their types and formulas."""
    c = F.col
    display = rules.is_display_math(c("math_paragraph"), c("other_text"), c("alignment"), c("text"))
    kind = rules.block_type(F.size("images"), c("n_math"), display, c("text"), c("style"), c("bold"), c("numbered"))
    typed = features(raw).withColumn("type", F.when(c("rows").isNotNull(), "table").otherwise(kind))
    each = F.when(c("type").isin("image", "formula_image"), F.arrays_zip(c("images").alias("relationship_id"), c("media").alias("media_path"))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("relationship_id"), F.lit(None).cast("string").alias("media_path"))))
    inline = F.when((F.size("images") > 1) & (c("type") == "paragraph"), F.array_distinct("media")).otherwise(F.array().cast("array<string>"))
    nodes = typed.withColumn("inline_media_paths", inline).select("*", F.posexplode(each).alias("part", "image"))
    signals = F.struct(c("math_paragraph").alias("has_math_paragraph"), (c("other_text") == "").alias("pure_math"), F.lower("alignment").isin("right", "center").alias("aligned"), c("text").rlike(rules.EQUATION_NUMBER).alias("numbered"))
    shown = c("type") == "formula"
    return nodes.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "part")) - 1).alias("flow_index"), "paragraph_index", "table_index", "type", "text", "style", "alignment", "bold",
        "font_size", "rows", c("image.relationship_id").alias("relationship_id"), c("image.media_path").alias("media_path"), "inline_media_paths",
        F.when(shown & c("omml").isNotNull(), c("omml")).alias("omml"), F.when(shown & c("omml").isNotNull(), omml_to_math("omml")).alias("math"),
        F.when(shown, signals).alias("display_signals"), ((c("n_math") > 0) & (c("type") == "paragraph") | (F.size("inline_media_paths") > 0)).alias("contains_inline_math"),
    )


def media(raw: DataFrame) -> DataFrame:
    """doc_id, media_path, suffix and content of the media entries with a safe name."""

    def rows(doc: str, content: bytes | None):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            return
        for name in archive.namelist():
            if name.startswith("word/media/") and ".." not in name:
                yield doc, name, posixpath.splitext(name)[1].lower(), archive.read(name)

    return _each_file(raw, rows, "doc_id string, media_path string, suffix string, content binary")


def saved_images(nodes: DataFrame, files: DataFrame, prefix: str = "media") -> DataFrame:
    """Each image node with the name it is saved under, its number in the document; a missing file has none."""
    images = nodes.filter(F.col("type").isin("image", "formula_image")).select("doc_id", "flow_index", "media_path")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("flow_index")).cast("string")
    named = images.withColumn("number", number).join(files.select("doc_id", "media_path", "suffix"), ["doc_id", "media_path"], "left")
    return named.select("doc_id", "flow_index", "media_path", F.when(F.col("suffix").isNotNull(), F.concat(F.lit(f"{prefix}_"), "number", "suffix")).otherwise("").alias("name"))
