"""Personal data: fixed patterns, and terms that disclose protected values by co-occurrence.

Values that the patterns find are protected entities. The corpus tells how strongly a term t reveals an entity c, all
counts over distinct texts, copies once: n(c, t) texts where t stands near c, n(t) texts with t, n(c) texts with c. The
information of c is IC(c) = -log2(n(c) / N); what t tells of it is PMI(c; t) = log2(N n(c, t) / (n(c) n(t))). A term
seen near c in MIN_TEXTS texts or more discloses c where it leaves LEFT_BITS of c's information at most:
IC(c) - PMI(c; t) <= LEFT_BITS. It is then a span in every document that holds it.

Sanitising puts the kind of a protected value in its place. A disclosing term is generalised to "a term near such a
kind" where that broader term, which all disclosing terms of the kind share, leaves more than LEFT_BITS of each of the
kind's entities; else, and where it discloses entities of several kinds, it is removed. Only DataFrame functions run.

Defined cases: a null text is an empty one, without spans; texts of any length are scanned whole, in time in proportion
to it; repeated rows repeat, and copies of a text neither reveal nor hide anything; a null doc_id is scanned like any
other; an empty table gives an empty result; further columns, whatever their names, are not read and kept by
sanitised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import packed, sound, written
from ._spans import apart, count_of, matches, no_spans, ordered, replaced, written_out

BASE_KINDS = ["email", "ip", "card", "phone"]
TERM = len(BASE_KINDS) + 1
#: A term's number is TERM - 1 + its kind, or REMOVED.
REMOVED = 2 * TERM - 1
KINDS = [*BASE_KINDS, *["term"] * TERM]
MARKS = [*(f"[{k.upper()}]" for k in BASE_KINDS), *(f"[TERM NEAR {k.upper()}]" for k in BASE_KINDS), "[REMOVED]"]
#: A match that begins inside a run would have begun at the run's start, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WINDOW_CHARS = 60
MIN_TERM = 4
WORD = rf"\p{{L}}{{{MIN_TERM},}}"
MIN_TEXTS = 3
LEFT_BITS = 1.0
#: Texts with copies, and disclosing terms, are sent to all tasks up to this many (some 100 MB each); beyond, they are
#: joined by shuffle.
MOST_SENT = 1_000_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip(match: Column) -> Column:
    def small(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(number) <= 3, F.concat(F.lit("0"), F.substring(number, 1, 3)).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(match, r"\."), small)


def _card(match: Column) -> Column:
    digits = F.reverse(_digits(match))

    def add(total: Column, i: Column) -> Column:
        x = F.call_function("substring", digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0
    return F.when(F.length(digits).between(14, 19), luhn).otherwise(False)


def base_spans(text: Column) -> tuple[Column, ...]:
    return (
        matches(text, EMAIL, 1, lambda m: F.lit(True), text.contains("@")),
        matches(text, IP, 2, _ip),
        matches(text, CARD, 3, _card, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
        matches(text, PHONE, 4, lambda m: F.length(_digits(m)).between(10, 15), text.contains("+")),
    )


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _near(text: Column, s: Column) -> Column:
    """The words around a span: WINDOW_CHARS on each side, less a word that a side's outer edge touches."""
    low = F.greatest(s["start"] - WINDOW_CHARS, F.lit(0))
    left = F.call_function("substring", text, low + 1, s["start"] - low)
    right = F.call_function("substring", text, s["end"] + 1, F.lit(WINDOW_CHARS))
    left = F.when(low > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) == WINDOW_CHARS, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    return F.concat(left, F.lit("\n"), right)


def disclosing(based: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(term, number) of the terms that disclose, and (hash, term) of the texts that hold one; of rows with text, hash
    and base. None where no term might."""
    text = F.col("text")
    window = lambda s: F.struct(
        s["kind"].alias("kind"), F.call_function("substring", text, s["start"] + 1, s["end"] - s["start"]).alias("value"), _near(text, s).alias("near")
    )
    seen = based.filter(F.size("base") > 0).select("hash", F.explode(F.transform("base", window)).alias("w"))
    # One row for each text, entity and window, however often the text is repeated.
    windows = written(seen.select("hash", F.col("w.kind").alias("kind"), F.xxhash64("w.kind", "w.value").alias("entity"), F.col("w.near").alias("near")).distinct(), "windows")
    holders = windows.select("entity", "hash").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= MIN_TEXTS)
    near = windows.join(holders, "entity").select("entity", "kind", "n_entity", "hash", F.explode(_terms(F.col("near"))).alias("term")).distinct()
    pairs = written(near.groupBy("entity", "kind", "n_entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= MIN_TEXTS), "pairs")
    if not pairs.head(1):
        return None
    # Every term of every text is counted, in each task first; a text with copies counts as its share of them.
    hashes = written(based.groupBy("hash").agg(F.count("*").alias("copies")), "hashes")
    texts, copied = hashes.count(), hashes.filter("copies > 1")
    copied = F.broadcast(copied) if copied.count() <= MOST_SENT else copied
    weighed = based.select("hash", "text").join(copied, "hash", "left").select(F.explode(_terms(text)).alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    spread = weighed.groupBy("term").agg(F.round(F.sum("weight")).alias("n_term"))
    told = pairs.join(spread, "term").withColumn("ic", -F.log2(F.col("n_entity") / F.lit(float(texts))))
    told = told.withColumn("pmi", F.log2(F.col("n_both") * F.lit(float(texts)) / (F.col("n_entity") * F.col("n_term"))))
    found = written(told.filter(F.round(F.col("ic") - F.col("pmi"), 9) <= LEFT_BITS).select("term", "kind", "entity"), "disclosing")
    # The texts that hold a disclosing term, each once; only these rows are shuffled.
    terms = found.select("term").distinct()
    few = F.broadcast(terms) if terms.count() <= MOST_SENT else terms
    holds = written(based.select("hash", F.explode(_terms(text)).alias("term")).join(few, "term", "left_semi").distinct(), "holds")
    # Is a kind's class of terms still vague? Texts with any of them, against those of them that hold the entity.
    own = found.groupBy("term").agg(F.min("kind").alias("kind"), F.max("kind").alias("last")).withColumn("several", F.col("kind") != F.col("last")).drop("last")
    class_texts = holds.join(own.filter("NOT several"), "term").select("kind", "hash").distinct()
    wide = class_texts.groupBy("kind").agg(F.count("*").alias("n_class"))
    of_class = found.select("kind", "entity").distinct().join(windows.select("entity", "hash").distinct(), "entity").join(class_texts, ["kind", "hash"])
    most = of_class.groupBy("kind", "entity").agg(F.count("*").alias("n")).groupBy("kind").agg(F.max("n").alias("n"))
    vague = wide.join(most, "kind").select("kind", (F.log2(F.col("n_class") / F.col("n")) > LEFT_BITS).alias("vague"))
    number = F.when(F.col("vague") & ~F.col("several"), F.col("kind") + TERM - 1).otherwise(REMOVED).cast("int")
    return written(own.join(vague, "kind", "left").select("term", number.alias("number")), "terms"), holds


def found(docs: DataFrame, carried: Column) -> DataFrame:
    """carried, text (null as empty), base and spans of every row."""
    rows = docs.select(carried.alias("carried"), F.coalesce(sound("text"), F.lit("")).alias("text"))
    based = rows.withColumn("base", ordered(*base_spans(F.col("text")))).withColumn("hash", F.xxhash64("text"))
    told = disclosing(based)
    if told is None or not told[0].head(1):
        return based.withColumn("spans", F.col("base")).drop("hash")
    terms, holds = told
    # Which texts hold disclosing terms: a map for each, by hash of the text, so that texts are not sorted or sent.
    held = written(holds.join(terms, "term").groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "number"))).alias("held")), "held")
    rows = based.join(held, "hash", "left")
    number = lambda m: F.try_element_at(F.col("held"), F.lower(m))
    more = matches(F.col("text"), WORD, number, lambda m: number(m).isNotNull(), F.col("held").isNotNull())
    rows = rows.withColumn("more", F.coalesce(more, no_spans()))
    return rows.withColumn("spans", ordered("base", apart(F.col("more"), F.col("base")))).drop("more", "held", "hash")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    rows = found(docs, F.col("doc_id").cast("long"))
    return rows.select(
        F.col("carried").alias("doc_id"), *(count_of(F.col("base"), k + 1).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(written_out(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans"), KINDS).alias("spans"),
    )


def sanitised(docs: DataFrame, marks: list[str] = MARKS) -> DataFrame:
    """The input's columns, each run of spans in the text as one mark: its kind, its term's kind, or that it is removed."""
    rows = found(docs, packed(docs)).withColumn("new", replaced(F.col("text"), F.col("spans"), marks))
    kept = {c: F.col(f"carried.`{c}`") for c in docs.columns}
    kept["text"] = F.when(F.size("spans") > 0, F.col("new")).otherwise(kept["text"])
    return rows.select(*(c.alias(n) for n, c in kept.items()))
