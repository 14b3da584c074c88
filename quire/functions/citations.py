"""Cross-references and citations: spans in texts, their targets, and the parts of a bibliography entry.

Patterns, number words and type letters are fixed values of the studied system. Places of matches are beyond the
built-in functions, so one Arrow function finds candidates; all that follows (numbers, overlaps, targets) is Column
expressions. Numbers that do not parse give no target, and ranges of any length are listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._udf import arrow

# Fixed values.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
SEVERAL = r"\d+(?:\s*[-–—]\s*\d+|(?:\s*(?:,|and|&)\s*\d+)+)"
BRACKETED = r"\(\s*\d+\s*\)"
#: (type, prefix of the targets, pattern; group 1 holds the numbers, group 2 a sub-figure's letter).
KINDS = [
    ("fig", "fig", r"Fig(?:ure)?\.?\s*(\d+)\s*(\(\s*[a-z]\s*\)|[a-z])"),
    ("table", "tab", rf"Table\s+({'|'.join(NUMBER_WORDS)})\b"),
    ("fig", "fig", rf"(?:Figs?|Figures?)\.?\s+({SEVERAL})"),
    ("table", "tab", rf"Tables?\s+({SEVERAL})"),
    ("disp-formula", "eq", rf"Eqs?\.?\s+({BRACKETED}(?:\s*[-–—]\s*{BRACKETED}|(?:\s*(?:,|and|&)\s*{BRACKETED})+))"),
    ("fig", "fig", r"(?:图\s*|Fig(?:ure)?\.?\s*)(\d+)"),
    ("table", "tab", r"(?:表\s*|Table\s+)(\d+)"),
    ("disp-formula", "eq", r"(?:(?:式|公式)\s*[（(]\s*|Eq\.?\s*\(\s*)(\d+)\s*[）)]"),
    ("bibr", "ref", r"\[\s*(\d+(?:\s*[-–—,，]\s*\d+)*)\s*\]"),
]
LETTER = "A-Za-zÀ-ɏ"
AUTHOR_IN_BRACKETS = r"(?<=[(;])\s*(([^();]{1,140}?)\s*,\s*((?:19|20)\d{2})[a-z]?)"
AUTHOR_IN_TEXT = rf"(([A-ZÀ-ɏ][\w'’.-]*(?:\s+[A-ZÀ-ɏ][\w'’.-]*)?(?:\s+et\s+al\.)?)\s*\(\s*((?:19|20)\d{{2}})[a-z]?(?:\s*[-–—]\s*(?:19|20)\d{{2}})?\s*\))"
CANDIDATES = "array<struct<start:int,end:int,text:string,ref_type:string,prefix:string,numbers:string,letter:string>>"
AUTHORS = "array<struct<start:int,end:int,text:string,author:string,year:string>>"


#: Where a kind's pattern can begin, by its first letters in either case (those that the engine takes for an i too).
_BEGINS = re.compile(r"[FfTtEe图表式公\[](?:(?<=[Ff])(?=[Ii\u0130\u0131][Gg])|(?<=[Tt])(?=[Aa][Bb][Ll][Ee])|(?<=[Ee])(?=[Qq])|(?<=公)(?=式)|(?<=[图表式\[]))")
_PATTERNS = [(t, p, re.compile(x, re.I)) for t, p, x in KINDS]
#: The patterns that begin with a letter, by their place among the kinds.
_BY_FIRST = {c: [(k, _PATTERNS[k][2].match) for k in ks] for cs, ks in (("Ff", (0, 2, 5)), ("Tt", (1, 3, 6)), ("Ee", (4, 7)), ("图", (5,)), ("表", (6,)), ("式公", (7,)), ("[", (8,))) for c in cs}
_LETTER_SIGNS = re.compile(r"[\s()]")


def _matches(text: str) -> list[tuple]:
    """(kind, start, end, text, numbers, letter) of all matches of all kinds, kind by kind, each in order. The text is
    walked once; a kind goes on where its last match ended."""
    out, ends = [], {}
    for begin in _BEGINS.finditer(text):
        at = begin.start()
        for k, match in _BY_FIRST[text[at]]:
            if at >= ends.get(k, 0) and (m := match(text, at)):
                ends[k] = m.end()
                numbers, letter = (m[1], _LETTER_SIGNS.sub("", m[2]).lower()) if k == 0 else (m[1], "")
                if numbers.lower() in NUMBER_WORDS:
                    numbers = str(NUMBER_WORDS.index(numbers.lower()) + 1)
                out.append((k, at, m.end(), m[0], numbers, letter))
    out.sort()
    return out


def found_in(text: str | None) -> list[dict]:
    """All matches of all kinds in a text, with their places."""
    return [{"start": start, "end": end, "text": shown, "ref_type": KINDS[k][0], "prefix": KINDS[k][1], "numbers": numbers, "letter": letter} for k, start, end, shown, numbers, letter in _matches(text or "")]


def _as_candidates(texts: Iterable[str | None]) -> pa.Array:
    """The matches of each text, null for null, written column by column."""
    offsets, missing, flat = [0], [], []
    for text in texts:
        missing.append(text is None)
        if text:
            flat += _matches(text)
        offsets.append(len(flat))
    kinds, starts, ends, shown, numbers, letters = zip(*flat) if flat else ((),) * 6
    columns = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *(pa.array(c, pa.string()) for c in (shown, [KINDS[k][0] for k in kinds], [KINDS[k][1] for k in kinds], numbers, letters))]
    spans = pa.StructArray.from_arrays(columns, ["start", "end", "text", "ref_type", "prefix", "numbers", "letter"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans, mask=pa.array(missing, pa.bool_()))


@arrow(CANDIDATES, arrays=True)
def candidates(texts: pa.Array) -> pa.Array:
    """All matches of all kinds, with their places."""
    return _as_candidates(texts.to_pylist())


@arrow(AUTHORS)
def author_years(texts: pd.Series) -> pd.Series:
    """Author and year in brackets, or an author with the year behind in brackets."""
    patterns = [re.compile(AUTHOR_IN_BRACKETS), re.compile(AUTHOR_IN_TEXT)]
    return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "text": m[1], "author": m[2], "year": m[3]} for p in patterns for m in p.finditer(t or "")], na_action=None)


def expanded(numbers: Column) -> Column:
    """The numbers of `1-3, 5 and 7`, either direction, in order, distinct; a part that is no number or range gives none."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(numbers, "[()]", ""), r"(?i)\s*(?:\band\b|&)\s*", ","), "[–—]", "-")
    # Split compiles a pattern of several signs for each text; one sign it does not.
    parts = F.filter(F.transform(F.split(F.translate(plain, "，、", ",,"), ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d{1,18}(?:\s*-\s*\d{1,18})?$"))
    ranges = F.transform(parts, lambda p: F.sequence(F.regexp_extract(p, r"^(\d+)", 1).cast("long"), F.regexp_extract(p, r"(\d+)$", 1).cast("long")))
    return F.when(numbers.rlike(r"\A[0-9]{1,18}\z"), F.array(numbers.cast("long"))).otherwise(F.array_distinct(F.flatten(ranges)))


def apart(spans: Column, kind: str) -> Column:
    """Of spans by start, the longer first, those that begin where the last one taken ended or later."""
    order = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("short"), i.alias("at"), s.alias("span")))

    def step(seen: Column, s: Column) -> Column:
        free = s["start"] >= seen["end"]
        return F.struct(F.when(free, s["span"]["end"]).otherwise(seen["end"]).alias("end"), F.when(free, F.concat(seen["out"], F.array(s["span"]))).otherwise(seen["out"]).alias("out"))

    return F.aggregate(F.sort_array(order), F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("out")), step, lambda seen: seen["out"])


def resolved(found: Column) -> Column:
    """Start, end, text, ref_type and rids of the candidates that do not overlap."""
    return F.transform(apart(found, CANDIDATES), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), c["ref_type"].alias("ref_type"),
        F.transform(expanded(c["numbers"]), lambda n: F.concat(c["prefix"], n.cast("string"), c["letter"])).alias("rids"),
    ))


def against_targets(spans: Column, targets: Column) -> Column:
    """Rids that exist, or whose figure does (fig1 for fig1a); status, missing targets and those that were normalised."""
    parent = lambda r: F.regexp_extract(r, r"^((?i:fig)\d+)[A-Za-z]$", 1)
    known = lambda r: F.array_contains(targets, r)
    up = lambda r: ~known(r) & known(parent(r))

    def one(s: Column) -> Column:
        valid = F.array_distinct(F.transform(F.filter(s["rids"], lambda r: known(r) | known(parent(r))), lambda r: F.when(known(r), r).otherwise(parent(r))))
        missing, moved = F.filter(s["rids"], lambda r: ~known(r) & ~known(parent(r))), F.filter(s["rids"], up)
        status = F.when((F.size(missing) == 0) & (F.size(moved) == 0), "ok").otherwise("need_review")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["ref_type"].alias("ref_type"), valid.alias("rids"), status.alias("status"), missing.alias("missing_targets"), moved.alias("normalized_from"))

    return F.transform(spans, one)


def author_keys(author: Column) -> Column:
    """First and last word of the first author, lower case, without `et al.`."""
    first = F.get(F.split(F.regexp_replace(author, r"(?i)\bet\s+al\.?", ""), r"(?i)\s+(?:and|&)\s+|,", 2), F.lit(0))
    names = F.regexp_extract_all(first, F.lit(rf"[{LETTER}][{LETTER}'’-]*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.array(F.get(names, F.lit(0)), F.get(names, F.size(names) - 1)), lambda n: n.isNotNull()), lambda n: F.lower(n)))


def reference_keys(authors: Column, raw: Column) -> Column:
    """An entry's author keys: of its authors, of its first words, and the surname behind or before initials."""
    head = F.get(F.split(raw, r"\(", 2), F.lit(0))
    surname = F.lower(F.regexp_extract(head, rf"^\s*(?:(?:[A-Z]\.?\s*){{1,3}})?([A-ZÀ-ɏ][{LETTER}'’-]*)", 1))
    behind = F.lower(F.regexp_extract(head, rf"^\s*[A-ZÀ-ɏ][{LETTER}'’-]*\s+(?:[A-Z]\.\s*){{1,3}}([A-ZÀ-ɏ][{LETTER}'’-]*)", 1))
    first = F.get(F.split(raw, r"(?i)\s+(?:and|&)\s+|[,;]", 2), F.lit(0))
    every = F.concat(F.flatten(F.transform(authors, author_keys)), author_keys(first), F.array(surname, behind))
    return F.array_distinct(F.filter(every, lambda k: k != ""))


def years(text: Column) -> Column:
    """H40."""
    return F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))


# Parts of a bibliography entry; fixed patterns.
LABEL = r"^\s*(\[\s*\d+\s*\]|［\s*\d+\s*］|\(\s*\d+\s*\)|（\s*\d+\s*）|\d+\s*[.)．、])\s*(.*)$"
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b"
PAGES = r"(\d+)\s*[-–—]\s*(\d+)"
VOLUME = r"(\d+)\s*\(\s*([^)]+)\s*\)"
TYPE = r"(?i)\[([JMCDBR])\]"
TYPES = {"J": "journal", "M": "book", "C": "conference", "D": "thesis", "B": "book", "R": "report"}
JOURNAL_TAIL = r"^(.+?)\s*[,;]?\s*((?:19|20)\d{2})(?:\s*[,;]\s*(\d+))?(?:\s*\(\s*([^)]+)\s*\))?(?:\s*[:：]\s*(\d+)\s*[-–—]\s*(\d+))?\.?\s*$"
COMMA_TAIL = r"^(.+?),\s*([^,]+?),\s*(\d+)\s*\(\s*((?:19|20)\d{2})\s*\)\s*(\d+)\s*[-–—]\s*(\d+)\.?\s*$"
FIELDS = ["authors", "article_title", "source", "year", "volume", "issue", "fpage", "lpage", "doi", "publication_type"]


#: Parts the groups of a match; texts that hold it are matched group by group.
BETWEEN = "\x01"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that begins with ^, by one match: an array whose k-th item is the k-th group, or an array
    of less than two items without a match. What stands before or behind the match is in the items around them."""
    shown = F.regexp_replace(text, pattern, "".join(f"{BETWEEN}${k}" for k in range(1, n + 1)) + BETWEEN)
    each = F.array(F.lit(""), *(F.regexp_extract(text, pattern, k) for k in range(1, n + 1)))
    return F.when(F.contains(text, F.lit(BETWEEN)), F.when(text.rlike(pattern), each).otherwise(F.array(text))).otherwise(F.split(shown, BETWEEN, -1))


def _split(text: Column, pattern: str) -> Column:
    """Split, which compiles its pattern for each text unless it is one character."""
    return F.when(F.contains(text, F.lit(BETWEEN)), F.split(text, pattern)).otherwise(F.split(F.regexp_replace(text, pattern, BETWEEN), BETWEEN))


def _if_holds(text: Column, word: str, then: Column, otherwise: Column) -> Column:
    """A step that only changes texts which hold a word, in either case; others skip its pattern."""
    return F.when(F.contains(F.lower(text), F.lit(word)), then).otherwise(otherwise)


def _stripped(text: Column, chars: str = " ,;。") -> Column:
    return F.trim(text, F.lit(chars))


def entry_fields(text: Column) -> list[tuple[str, Column]]:
    """Columns to add one after the other to rows with a bibliography entry's text; the last is parse_confidence.

    Identifiers come first: DOI, year, first range as pages, volume with issue, type letter. Then the parts: an entry
    whose tail is `source, volume (year) first-last`, else parts between full stops: authors, title, and a journal's
    tail, whose parts take the identifiers' place.
    """
    c = F.col
    get = lambda name, pattern, k: F.regexp_extract(c(name), pattern, k)
    group = lambda name, k: F.coalesce(F.get(c(name), F.lit(k)), F.lit(""))
    hit = lambda name: F.size(name) > 1
    segments = F.when(hit("_comma_tail"), F.filter(F.transform(F.split(group("_comma_tail", 1), ","), lambda p: F.trim(p)), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    author = lambda p: p.rlike(r"(?i)^et\s+al\.?$") | ((F.size(F.split(F.trim(p), r"\s+")) <= 6) & p.rlike(r"(?:^|\s)[A-Z]{1,4}\.?$"))
    lead = F.aggregate(c("_segments"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, p: F.struct(F.when(s["open"] & author(p), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["open"] & author(p)).alias("open")), lambda s: s["n"])
    comma = (F.size("_segments") > c("_lead")) & (group("_comma_tail", 2) != "")
    tail_hit = (c("_tail") != "") & hit("_journal_tail")
    loose = F.when((c("_tail") != "") & ~c("_tail").rlike(r"^(?:19|20)\d{2}\b"), _stripped(F.get(F.split(c("_tail"), r"[,，]\s*(?:19|20)\d{2}", 2), F.lit(0)), " ,;。.")).otherwise("")

    def part(comma_group: int | None, tail_group: int, other: Column) -> Column:
        own = F.nullif(group("_journal_tail", tail_group), F.lit(""))
        out = F.when(tail_hit & ~c("_comma"), F.coalesce(F.trim(own), other)).otherwise(other)
        return F.when(c("_comma"), group("_comma_tail", comma_group)).otherwise(out) if comma_group else out

    letter = F.upper(_if_holds(c("raw"), "[", get("raw", TYPE, 1), F.lit("")))
    kind = F.coalesce(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p))[F.nullif(letter, F.lit(""))], F.lit(""))
    filled = lambda n: (F.size(n) if n == "authors" else F.length(n)) > 0
    typeless = _if_holds(c("raw"), "[", F.regexp_replace(c("raw"), TYPE, ""), c("raw"))
    without = _if_holds(c("raw"), "doi", F.regexp_replace(F.regexp_replace(typeless, r"(?i)\bdoi\s*:\s*(?:https?://(?:dx\.)?doi\.org/)?\S+", ""), r"(?i)https?://(?:dx\.)?doi\.org/\S+", ""), typeless)
    parts = F.filter(F.transform(_split(c("_clean"), r"\.\s+"), lambda p: _stripped(p)), lambda p: p != "")
    some = F.size("_parts") >= 2
    names = F.filter(F.transform(_split(F.get("_parts", F.lit(0)), r"(?i)[;,，；]|(?:\s+and\s+)"), lambda p: F.trim(p)), lambda p: p != "")
    none = F.array().cast("array<string>")
    return [
        ("_label", F.regexp_extract(text, LABEL, 1)), ("label", F.trim("_label")),
        ("raw", F.trim(F.when(c("_label") != "", F.regexp_extract(text, LABEL, 2)).otherwise(text))),
        ("_clean", F.trim(without)), ("_comma_tail", _groups(c("_clean"), COMMA_TAIL, 6)), ("_segments", segments), ("_lead", lead), ("_comma", comma), ("_parts", parts),
        ("_tail", F.when(F.size("_parts") >= 3, _stripped(F.array_join(F.slice("_parts", F.lit(3), F.size("_parts")), " "), " ,;。.")).otherwise("")),
        ("_journal_tail", _groups(c("_tail"), JOURNAL_TAIL, 6)),
        ("authors", F.when(c("_comma"), F.slice("_segments", F.lit(1), c("_lead"))).when(some & ~c("_comma"), names).otherwise(none)),
        ("article_title", F.when(c("_comma"), _stripped(F.array_join(F.slice("_segments", c("_lead") + 1, F.size("_segments")), ", "), " ,;.")).when(some, _stripped(F.get("_parts", F.lit(1)))).otherwise("")),
        ("source", F.when(c("_comma"), _stripped(group("_comma_tail", 2), " ,;.")).when(tail_hit, _stripped(group("_journal_tail", 1), " ,;.")).otherwise(loose)),
        ("year", part(4, 2, get("raw", r"\b((?:19|20)\d{2})\b", 1))), ("volume", part(3, 3, get("raw", VOLUME, 1))), ("issue", part(None, 4, get("raw", VOLUME, 2))),
        ("fpage", part(5, 5, get("raw", PAGES, 1))), ("lpage", part(6, 6, get("raw", PAGES, 2))),
        ("doi", _if_holds(c("raw"), "10.", F.rtrim(get("raw", DOI, 1), F.lit(".")), F.when(c("raw").isNotNull(), ""))),
        ("publication_type", F.when(kind != "", kind).when(c("_comma") | (c("source") != ""), "journal").otherwise("")),
        ("parse_confidence", F.least(F.lit(1.0), F.bround(sum((filled(n).cast("int") for n in FIELDS), F.lit(0)) / 7, 2))),
    ]


def parsed_entries(rows, text: str):
    """The rows with label, raw, the fields and parse_confidence of the entries in a column."""
    for name, column in entry_fields(F.col(text)):
        rows = rows.withColumn(name, column)
    return rows.drop("_label", "_clean", "_comma_tail", "_segments", "_lead", "_comma", "_parts", "_tail", "_journal_tail")
