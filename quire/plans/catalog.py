"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blocks, citations, scores, text
from ..operators import matching, ordered
from ..sources.tables import line_blocks, table, task_count

FLAGSHIP = "document_profile"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS flow_index FROM documents)"
WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\r\\n]+'), lambda w: w <> ''))"


def query(sql: str):
    def put(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import manuscripts

    return _QUERIES | manuscripts.ROWS_ONLY


def oracle_sql() -> dict[str, str]:
    from . import manuscripts  # its queries register themselves

    return {name: _SQL[name] for name in _QUERIES if name not in manuscripts.ROWS_ONLY}


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_blocks, sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END)::BIGINT AS n_filled, sum({WORDS.format('text')})::BIGINT AS n_words, max(length(text))::BIGINT AS longest FROM lines GROUP BY doc_id")
def document_profile(spark, d):
    """Counts of a document's blocks and words."""
    return line_blocks(table(spark, d, "documents")).groupBy("doc_id").agg(
        F.count("*").alias("n_blocks"), F.sum(F.when(F.trim("text") != "", 1).otherwise(0)).alias("n_filled"),
        F.sum(text.word_count(F.col("text"))).alias("n_words"), F.max(F.length("text")).cast("long").alias("longest"),
    )


@query("SELECT page_id, CASE WHEN f <> '' THEN f ELSE 'document.docx' END AS name FROM (SELECT page_id, regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') AS f FROM pages)")
def safe_filename(spark, d):
    """A2."""
    return table(spark, d, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 5000 THEN 'too_large' WHEN lang NOT IN ('en', 'fr') THEN 'extension' ELSE 'accepted' END AS verdict FROM documents")
def upload_verdict(spark, d):
    """A1, A3, A4: the first reason to reject."""
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.when(n == 0, "empty").when(n > 5000, "too_large").when(~F.col("lang").isin("en", "fr"), "extension").otherwise("accepted").alias("verdict"))


@query(f"WITH {LINES} SELECT doc_id, flow_index, CASE WHEN length(text) > 120 THEN substring(text, 1, 117) || '...' ELSE text END AS preview FROM lines")
def previews(spark, d):
    """B25."""
    return line_blocks(table(spark, d, "documents")).select("doc_id", "flow_index", text.preview(F.col("text")).alias("preview"))


HEAD = f"SELECT doc_id, flow_index, flow_index % 2 = 0 AND {WORDS.format('text')} BETWEEN 1 AND 12 AND length(text) <= 100 AND (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) * 100 < 8 * greatest(1, length(regexp_replace(text, '[ \\t\\r\\n\\x0B\\f]+', '', 'g'))) AND NOT regexp_matches(text, '[.;:。；：][ \\t\\r\\n\\x0B\\f]*$') AS is_heading FROM lines"


def _headings(spark, d):
    return line_blocks(table(spark, d, "documents")).select("doc_id", "flow_index", blocks.is_unnumbered_heading(F.col("text"), F.col("flow_index") % 2 == 0).alias("is_heading"))


@query(f"WITH {LINES} {HEAD}")
def unnumbered_headings(spark, d):
    """Of blocks of which every second is bold."""
    return _headings(spark, d)


@query(f"WITH {LINES}, h AS ({HEAD}) SELECT doc_id, flow_index, max(CASE WHEN is_heading THEN flow_index END) OVER (PARTITION BY doc_id ORDER BY flow_index) AS section FROM h")
def section_of_block(spark, d):
    """The current section of each block."""
    return ordered.carried_forward(_headings(spark, d), "doc_id", "flow_index", F.when(F.col("is_heading"), F.col("flow_index")), "section").drop("is_heading")


@query(f"WITH {LINES} SELECT doc_id, flow_index, min(CASE WHEN trim(text) <> '' THEN flow_index END) OVER (PARTITION BY doc_id ORDER BY flow_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS next_filled FROM lines")
def next_filled_block(spark, d):
    """E1."""
    return ordered.nearest_within(line_blocks(table(spark, d, "documents")), "doc_id", "flow_index", F.trim("text") != "", 4, "next_filled").drop("text")


@query("SELECT p_partkey, p_brand, 1 + p_size % 4 AS level, (SELECT max(q.p_partkey) FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey < p.p_partkey AND 1 + q.p_size % 4 < 1 + p.p_size % 4) AS parent FROM part p")
def parent_sections(spark, d):
    """The nearest earlier section of a lower level."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", (1 + F.col("p_size") % 4).alias("level"))
    return ordered.parent_sections(rows, "p_brand", "p_partkey", "level", 4)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS k FROM lineitem")
def object_numbers(spark, d):
    """E11."""
    rows = table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return ordered.numbered(rows, "l_orderkey", "at", "l_returnflag", "k").select("l_orderkey", "l_linenumber", "l_returnflag", "k")


@query("SELECT event_id, event_type || '-' || (user_id % 5) || CASE WHEN n = 1 THEN '' ELSE '-auto' || (n - 1) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type || '-' || (user_id % 5) ORDER BY event_id) AS n FROM events)")
def duplicate_ids(spark, d):
    """Later rows of an id get a number."""
    rows = table(spark, d, "events").withColumn("name", F.concat("event_type", F.lit("-"), (F.col("user_id") % 5).cast("string")))
    return ordered.renamed_duplicates(rows, "user_id", "event_id", "name", "id").select("event_id", "id")


@query("SELECT o_custkey, o_orderkey, sum(o_orderkey % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS total FROM orders")
def running_totals(spark, d):
    """E14."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).alias("size"))
    return ordered.running_total(rows, "o_custkey", "o_orderkey", "size", "total").drop("size")


@query("""WITH RECURSIVE j AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents),
r AS (SELECT source, 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS kept FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT r.source, j.k, CASE WHEN r.used + j.n_chars <= 40000 THEN r.used + j.n_chars ELSE r.used END, CASE WHEN r.used + j.n_chars <= 40000 THEN j.doc_id END FROM r JOIN j ON j.source = r.source AND j.k = r.k + 1 WHERE j.k <= 30)
SELECT source, kept AS doc_id FROM r WHERE kept IS NOT NULL""")
def retention(spark, d):
    """Newest first under a byte budget."""
    return ordered.retained(table(spark, d, "documents"), "source", "doc_id", "doc_id", "n_chars", 30, 40000)


CAPTION = "CASE WHEN l_linenumber % 2 = 0 THEN 'Fig. ' ELSE 'Table ' END || l_linenumber || '. ' || p_name"


def _captions(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumn("caption", F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Fig. ").otherwise("Table "), F.col("l_linenumber").cast("string"), F.lit(". "), F.col("p_name")))


@query(rf"SELECT l_orderkey, l_linenumber, regexp_extract(c, '^\s*((?:Figure|Fig\.?|Table)\s*[0-9]+)', 1) AS label, regexp_replace(regexp_replace(c, '^\s*((?:Figure|Fig\.?|Table)\s*[0-9]+)', ''), '^[\s.:：．-]+|\s+$', '', 'g') AS body, regexp_extract(c, '([0-9]+)', 1) AS number FROM (SELECT *, {CAPTION} AS c FROM lineitem JOIN part ON l_partkey = p_partkey)")
def caption_parts(spark, d):
    """H1, H9."""
    c = F.col("caption")
    return _captions(spark, d).select("l_orderkey", "l_linenumber", text.caption_label(c).alias("label"), text.caption_body(c).alias("body"), text.caption_number(c).alias("number"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_distinct_ordered, ',') AS numbers FROM (SELECT l_orderkey, l_linenumber, list_concat(range(least(a, b), greatest(a, b) + 1), CASE WHEN c BETWEEN least(a, b) AND greatest(a, b) THEN [] ELSE [c] END) AS list_distinct_ordered FROM (SELECT l_orderkey, l_linenumber, 1 + l_suppkey % 3 AS a, 4 + l_suppkey % 4 AS b, l_linenumber::BIGINT AS c FROM lineitem))")
def expanded_citations(spark, d):
    """`a-b, c` to its numbers."""
    s = lambda x: x.cast("string")
    raw = F.concat(s(1 + F.col("l_suppkey") % 3), F.lit("-"), s(4 + F.col("l_suppkey") % 4), F.lit(", "), s(F.col("l_linenumber")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(citations.expanded(raw).cast("array<string>"), ",").alias("numbers"))


@query("SELECT l.l_orderkey, l.l_linenumber, 'fig' || (1 + l.l_partkey % 5) AS rid, CASE WHEN EXISTS (SELECT 1 FROM lineitem t WHERE t.l_orderkey = l.l_orderkey AND t.l_linenumber = 1 + l.l_partkey % 5) THEN 'valid' ELSE 'missing' END AS status FROM lineitem l")
def reference_targets(spark, d):
    """C18, G2, G5; C7 is subfigure_targets."""
    rows = table(spark, d, "lineitem")
    xrefs = rows.select("l_orderkey", "l_linenumber", F.concat(F.lit("fig"), (1 + F.col("l_partkey") % 5).cast("string")).alias("rid"))
    targets = rows.select("l_orderkey", F.concat(F.lit("fig"), F.col("l_linenumber").cast("string")).alias("rid"))
    return matching.target_status(xrefs, targets, ["l_orderkey", "rid"])


@query("SELECT l_orderkey, 'fig' || (1 + l_partkey % 5) AS rid, count(*) AS n_refs, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS referrers FROM lineitem GROUP BY 1, 2")
def referrers(spark, d):
    """D23."""
    rows = table(spark, d, "lineitem").withColumn("rid", F.concat(F.lit("fig"), (1 + F.col("l_partkey") % 5).cast("string")))
    return matching.reverse_references(rows, ["l_orderkey", "rid"], "l_linenumber")


BIND = "(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 50 + CASE WHEN l_linenumber = 1 + o_orderkey % 4 THEN 35 ELSE 0 END + CASE WHEN l_partkey % 6 <= 1 THEN 15 WHEN l_partkey % 6 <= 3 THEN 5 ELSE 0 END END)"


def _bindings(spark, d):
    # Both sides, and the windows behind, in as many tasks as the table asks for: their sorts hold a task's rows.
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey")
    n = task_count(lines)
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition(n, "l_orderkey")
    rows = lines.join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.withColumn("score", scores.evidence(F.col("l_returnflag") != "R", F.lit(True), F.col("l_linenumber") == 1 + F.col("o_orderkey") % 4, F.col("l_partkey") % 6))


@query(f"SELECT o_orderkey, score, score - coalesce(nxt, 0) AS lead, score >= 80 AND score - coalesce(nxt, 0) >= 15 AS bound FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM (SELECT o_orderkey, {BIND} AS score, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WINDOW w AS (PARTITION BY o_orderkey ORDER BY score DESC, l_linenumber)) WHERE r = 1")
def best_bindings(spark, d):
    """The best candidate with its lead; C3 is float_matches."""
    return ordered.best_with_margin(_bindings(spark, d).select("o_orderkey", "score", "l_linenumber"), ["o_orderkey"], "score", "l_linenumber").select("o_orderkey", "score", "lead", "bound")


@query("SELECT o_orderkey, l_linenumber, l_partkey, score, CASE WHEN l_returnflag = 'R' THEN 'error' WHEN score >= 80 THEN 'ok' WHEN score >= 50 THEN 'need_review' ELSE 'warning' END AS status FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 30 + CASE WHEN l_suppkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN l_linenumber = 1 + o_orderkey % 4 THEN 35 ELSE 0 END + CASE WHEN l_partkey % 6 <= 1 THEN 15 WHEN l_partkey % 6 <= 3 THEN 5 ELSE 0 END END AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def evidence_scores(spark, d):
    """H30 with its refusal of other sections, H32."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    same = F.col("l_returnflag") != "R"
    rows = rows.withColumn("score", scores.evidence(same, F.col("l_suppkey") % 2 == 0, F.col("l_linenumber") == 1 + F.col("o_orderkey") % 4, F.col("l_partkey") % 6))
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", "score", scores.evidence_status(same, F.col("score")).alias("status"))


@query("""WITH RECURSIVE x AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 AS section, 3 * l_linenumber + l_partkey % 3 AS flow, CASE WHEN l_partkey % 2 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_linenumber::VARCHAR END AS number FROM x),
o AS (SELECT l_orderkey, l_linenumber AS obj, l_linenumber % 2 AS section, 3 * l_linenumber + l_suppkey % 3 AS flow, CASE WHEN l_suppkey % 3 = 0 THEN 'table' ELSE 'image' END AS kind, (1 + (l_linenumber + 2 * (l_suppkey % 2)) % 7)::VARCHAR AS number FROM x),
p AS (SELECT c.l_orderkey, c.l_linenumber, o.obj, abs(c.flow - o.flow) AS d, c.kind AS ck, o.kind AS ok, c.number AS cn, o.number AS onum FROM c LEFT JOIN o ON c.l_orderkey = o.l_orderkey AND c.section = o.section),
s AS (SELECT l_orderkey, l_linenumber, obj, greatest(0, least(100, 35 + CASE WHEN cn <> '' AND cn = onum THEN 35 ELSE 0 END + CASE WHEN d <= 1 THEN 20 WHEN d <= 3 THEN 10 ELSE 0 END + CASE WHEN ck = 'table' AND ok = 'image' AND d <= 3 AND cn <> onum THEN CASE WHEN d <= 1 THEN 40 ELSE 35 END WHEN (ck = 'figure' AND ok = 'image') OR (ck = 'table' AND ok = 'table') THEN 15 ELSE -10 END))::BIGINT AS score FROM p),
g AS (SELECT l_orderkey, l_linenumber, list({'score': score, 'obj': obj::BIGINT} ORDER BY score DESC, obj) AS found FROM s GROUP BY l_orderkey, l_linenumber),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM g),
r AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS l_linenumber, NULL::BIGINT AS object, 0::BIGINT AS score FROM a UNION ALL
SELECT l_orderkey, k, CASE WHEN ok THEN list_append(used, f[1].obj) ELSE used END, l_linenumber, CASE WHEN ok THEN f[1].obj END, coalesce(f[1].score, 0) FROM (SELECT *, coalesce(f[1].score, 0) >= 80 AND f[1].score - coalesce(f[2].score, 0) >= 15 AS ok FROM (SELECT a.l_orderkey, a.k, r.used, a.l_linenumber::BIGINT AS l_linenumber, list_filter(a.found, lambda x: NOT list_contains(r.used, x.obj)) AS f FROM r JOIN a ON a.l_orderkey = r.l_orderkey AND a.k = r.k + 1)))
SELECT l_orderkey, l_linenumber, object, score FROM r WHERE k > 0""")
def float_matches(spark, d):
    """Captions in order, candidates of their section, each object once."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))  # line numbers repeat
    rows, line = table(spark, d, "lineitem").withColumn("l_linenumber", place.cast("long")), F.col("l_linenumber")
    captions = rows.select(
        "l_orderkey", "l_linenumber", (line % 2).alias("section"), (3 * line + F.col("l_partkey") % 3).alias("flow"),
        F.when(F.col("l_partkey") % 2 == 0, "table").otherwise("figure").alias("caption"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise(line.cast("string")).alias("number"),
    )
    objects = rows.select(
        "l_orderkey", line.alias("target"), (line % 2).alias("section"), (3 * line + F.col("l_suppkey") % 3).alias("object_flow"),
        F.when(F.col("l_suppkey") % 3 == 0, "table").otherwise("image").alias("kind"), (1 + (line + 2 * (F.col("l_suppkey") % 2)) % 7).cast("string").alias("object_number"),
    )
    score = scores.float_match(F.col("number"), F.col("object_number"), F.abs(F.col("flow") - F.col("object_flow")), F.col("caption"), F.col("kind"))
    pairs = captions.join(objects, ["l_orderkey", "section"], "left").withColumn("score", score)
    return ordered.bound_once(pairs, "l_orderkey", "l_linenumber", "target", "score")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, 'fig' || (1 + l_partkey % 5) || CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE '' END AS rid FROM lineitem), t AS (SELECT DISTINCT l_orderkey, 'fig' || l_linenumber || CASE WHEN l_suppkey % 3 = 0 THEN 'a' ELSE '' END AS rid FROM lineitem), y AS (SELECT x.*, NULLIF(regexp_extract(x.rid, '^([Ff][Ii][Gg][0-9]+)[A-Za-z]$', 1), '') AS parent FROM x) SELECT y.l_orderkey, y.l_linenumber, y.rid, coalesce(t.rid, u.rid) AS target, CASE WHEN t.rid IS NOT NULL THEN 'valid' WHEN u.rid IS NOT NULL THEN 'parent' ELSE 'missing' END AS status FROM y LEFT JOIN t ON y.l_orderkey = t.l_orderkey AND y.rid = t.rid LEFT JOIN t u ON y.l_orderkey = u.l_orderkey AND y.parent = u.rid")
def subfigure_targets(spark, d):
    """Targets, with a sub-figure's figure where it has none of its own."""
    rows = table(spark, d, "lineitem")
    name = lambda n, sub: F.concat(F.lit("fig"), n.cast("string"), F.when(sub, "a").otherwise(""))
    xrefs = rows.select("l_orderkey", "l_linenumber", name(1 + F.col("l_partkey") % 5, F.col("l_suppkey") % 2 == 0).alias("rid"))
    targets = rows.select("l_orderkey", name(F.col("l_linenumber"), F.col("l_suppkey") % 3 == 0).alias("rid"))
    return matching.resolved_targets(xrefs, targets, ["l_orderkey"], "rid")


@query("WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS ta, coalesce(text, '') AS text FROM conversations), p AS (SELECT conv_id, turn, ta, lead(ta) OVER (PARTITION BY conv_id ORDER BY turn, text) AS tb FROM t), s AS (SELECT *, list_distinct(ta) AS sa, list_distinct(tb) AS sb FROM p WHERE tb IS NOT NULL) SELECT conv_id, turn, (CASE WHEN len(sa) = 0 AND len(sb) = 0 THEN 100 WHEN len(sa) = 0 OR len(sb) = 0 THEN 0 ELSE 200 * len(list_intersect(sa, sb)) // (len(sa) + len(sb)) END)::BIGINT AS set_score, (CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 100 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 ELSE 200 * list_sum(list_transform(sa, lambda t: least(len(list_filter(ta, lambda u: u = t)), len(list_filter(tb, lambda u: u = t))))) // (len(ta) + len(tb)) END)::BIGINT AS bag_score, (CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 100 ELSE 100 * least(len(ta), len(tb)) // greatest(len(ta), len(tb)) END)::BIGINT AS count_score FROM s")
def turn_scores(spark, d):
    """D17, D18, D19, D20, G3, G4 over whole conversations: every turn against the next one."""
    text_ = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text_.alias("text"), F.filter(F.split(F.lower(text_), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = rows.select(F.struct("conv_id", "turn", F.row_number().over(order).alias("place")).alias("key"), "tokens", F.lead("tokens").over(order).alias("next")).filter("next IS NOT NULL")
    return matching.token_overlap(rows, rows.select("key", F.col("next").alias("tokens")), "key", "tokens").select("key.conv_id", "key.turn", "set_score", "bag_score", "count_score")


DIMS = {k: f"(({p} * o_orderkey) % 101)" for k, p in zip(scores.WEIGHTS, (7, 11, 13, 17, 19, 23, 29))}
TOTAL = f"round_even(({' + '.join(f'{v} * {scores.WEIGHTS[k]}' for k, v in DIMS.items())} - 100 * least(30, 10 * (o_orderkey % 5))) / 100.0, 0)::BIGINT"


def _totals(spark, d):
    dims = {k: (F.col("o_orderkey") * p) % 101 for k, p in zip(scores.WEIGHTS, (7, 11, 13, 17, 19, 23, 29))}
    return table(spark, d, "orders").withColumn("raw", scores.weighted_total(dims, F.col("o_orderkey") % 5))


@query(f"SELECT o_orderkey, greatest(0, least(100, raw)) AS total, CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'B' WHEN raw >= 70 THEN 'C' WHEN raw >= 60 THEN 'D' ELSE 'E' END AS grade FROM (SELECT o_orderkey, {TOTAL} AS raw FROM orders)")
def quality_totals(spark, d):
    """D2, D14, H44."""
    return _totals(spark, d).select("o_orderkey", F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw"))).cast("long").alias("total"), scores.grade(F.col("raw")).alias("grade"))


@query(f"SELECT o_orderpriority, count(*) AS n, sum(raw)::BIGINT AS total, min(raw) AS lowest, (10000 * sum(CASE WHEN raw >= 40 THEN 1 ELSE 0 END) // count(*))::BIGINT AS passed FROM (SELECT o_orderpriority, {TOTAL} AS raw FROM orders) GROUP BY 1 HAVING min(raw) >= -20")
def run_summary(spark, d):
    """Mean parts, minimum and pass rate of a run, with a floor; the acceptance floors are accepted_runs."""
    rows = _totals(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("raw").alias("total"), F.min("raw").alias("lowest"), F.floor(10000 * F.sum(F.when(F.col("raw") >= 40, 1).otherwise(0)) / F.count("*")).alias("passed"))
    return rows.filter("lowest >= -20")


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS views, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)::INTEGER AS worst, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def issue_levels(spark, d):
    """Counts by level, the worst, and sorted distinct kinds."""
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum(F.when(kind == "click", 1).otherwise(0)).alias("clicks"), F.sum(F.when(kind == "view", 1).otherwise(0)).alias("views"),
        F.max(F.when(kind == "purchase", 3).when(kind == "click", 2).otherwise(1)).alias("worst"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"),
    )


@query("SELECT c_custkey, coalesce(NULLIF(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), n_name) AS journal, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, r_name) AS publisher FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def profile_defaults(spark, d):
    """Empty fields are filled from a small profile table."""
    profiles = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(profiles, F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return rows.select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), "n_name").alias("journal"), F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("r_name")).alias("publisher"))


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ />]'))::BIGINT AS n_{t}" for t in ("article", "nav", "li", "ul", "a", "p", "h1", "footer", "script")) + " FROM pages")
def tag_counts(spark, d):
    """How often nine tags open."""
    return table(spark, d, "pages").select("page_id", *(F.regexp_count("html", F.lit(f"<{t}[ />]")).cast("long").alias(f"n_{t}") for t in ("article", "nav", "li", "ul", "a", "p", "h1", "footer", "script")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(100, CASE WHEN l_partkey % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 55 ELSE 0 END + CASE WHEN l_suppkey % 4 = 0 THEN 25 ELSE 0 END)::INT AS score, l_partkey % 2 = 0 OR l_partkey % 3 = 0 OR l_suppkey % 4 = 0 AS is_display, (CASE l_linenumber % 3 WHEN 0 THEN 100 WHEN 1 THEN 70 ELSE 40 END)::INT AS most, CASE WHEN l_linenumber % 3 = 1 THEN 'need_review' WHEN l_linenumber % 3 = 2 THEN 'warning' WHEN least(100, CASE WHEN l_partkey % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 55 ELSE 0 END + CASE WHEN l_suppkey % 4 = 0 THEN 25 ELSE 0 END) >= 80 THEN 'ok' WHEN least(100, CASE WHEN l_partkey % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 55 ELSE 0 END + CASE WHEN l_suppkey % 4 = 0 THEN 25 ELSE 0 END) >= 50 THEN 'need_review' ELSE 'warning' END AS status FROM lineitem")
def formula_evidence(spark, d):
    """How sure a formula is, with the caps of its conversion."""
    c = F.col
    score, display = scores.formula(c("l_partkey") % 2 == 0, c("l_partkey") % 3 == 0, c("l_suppkey") % 4 == 0)
    conversion = F.when(c("l_linenumber") % 3 == 0, "success").when(c("l_linenumber") % 3 == 1, "partial").otherwise("failed")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"), display.alias("is_display"), scores.most_of(conversion).alias("most"), conversion.alias("conversion"))
    return rows.withColumn("status", scores.capped_status(c("score"), c("conversion"))).drop("conversion")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def fresh_jobs(spark, d):
    """Jobs that have not expired, two days before the newest."""
    events = table(spark, d, "events")
    return ordered.unexpired(events, "ts", events.agg(F.max("ts")).first()[0], 2 * 86400).select("event_id", "user_id")
