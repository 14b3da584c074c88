"""Secret scans: fixed patterns, and strings that look random to character Markov models.

Two first-order models over characters are trained from labelled samples: random strings (digests written
in hexadecimal, base64 and letters with digits) and ordinary identifiers (words of a bounded sample of the
documents, alone and joined as programs join them, and fixed ones made of VERBS, NOUNS and numbers). A token of
MIN_TOKEN or more characters with a digit is a secret where the mean log-likelihood ratio of its transitions exceeds
THRESHOLD. The model depends on the documents and on nothing else of the session. Only DataFrame functions run.

Defined cases: a null text is an empty one, without spans; texts are scanned whole, in time in proportion to their
length; repeated rows repeat; an empty table gives an empty result; further columns, whatever their names, are not read
by the scan and are kept by redaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, packed, sound, text_of
from ._spans import apart, count_of, matches, ordered, replaced, written_out

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
#: Mean log-likelihood ratio, natural, for each transition.
THRESHOLD = 0.0
#: Documents from which ordinary words are learnt (those of the lowest id hashes), and random strings made.
SAMPLE_DOCS = 500
RANDOM_STRINGS = 2000
#: Characters that the models tell apart; any other is one class, 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
MARK = "[SECRET]"
#: Parts of fixed identifiers.
VERBS = ["get", "set", "read", "write", "load", "save", "open", "close", "parse", "format", "create", "delete", "update", "find", "sort", "merge", "split", "count", "check", "build"]
NOUNS = ["user", "name", "file", "path", "value", "index", "table", "column", "record", "message", "request", "response", "session", "config", "buffer", "stream", "window", "thread", "version", "timestamp"]


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """token, secret: random strings and ordinary identifiers."""
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    random = spark.range(RANDOM_STRINGS).select(
        F.explode(F.array(
            F.lower(F.hex(digest)),
            F.base64(digest),
            F.translate(F.base64(digest), "+/=", ""),
            F.upper(F.translate(F.base64(digest), "+/=", "")),
        )).alias("token"),
        F.lit(True).alias("secret"),
    )
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    words = F.filter(F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)), lambda w: w.rlike("^[A-Za-z]{2,24}$"))
    sampled = docs.join(F.broadcast(ids.filter("doc_id IS NOT NULL")), "doc_id", "left_semi").select(words.alias("words"))
    # Neighbours by zipping: a lambda that reads an outer array could have it computed anew for each element.
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat(a, F.lit("_"), b, F.lit("_"), F.length(a).cast("string")))
    plain = sampled.select(F.explode(F.concat("words", F.filter(pairs, lambda t: t.isNotNull()))).alias("token"), F.lit(False).alias("secret"))
    # Identifiers that do not depend on the documents, so that models hold for any table.
    parts = lambda words: F.explode(F.array(*map(F.lit, words)))
    made = spark.range(1).select(parts(VERBS).alias("verb")).select("verb", parts(NOUNS).alias("noun")).select("verb", "noun", parts(["", "2", "10", "v3"]).alias("number"))
    snake = F.concat_ws("_", "verb", "noun", F.nullif("number", F.lit("")))
    camel = F.concat("verb", F.initcap("noun"), "number")
    fixed = made.select(F.explode(F.array(snake, F.upper(snake), camel, F.concat(F.initcap("verb"), F.initcap("noun"), "number"))).alias("token"), F.lit(False).alias("secret"))
    return random.unionByName(plain).unionByName(fixed)


def _class(char: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), char)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, random over ordinary, with add-one smoothing; row by first class."""
    steps = samples.filter(F.length("token") > 1).select(
        "secret",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.length("token") - 1),
            lambda i: _class(F.call_function("substring", F.col("token"), i, F.lit(1))) * CLASSES + _class(F.call_function("substring", F.col("token"), i + 1, F.lit(1))),
        )).alias("step"),
    )
    counts = {(r["secret"], r["step"]): r["n"] for r in steps.groupBy("secret", "step").agg(F.count("*").alias("n")).collect()}  # at most 2 * CLASSES ** 2 rows
    from math import log

    out = []
    for a in range(CLASSES):
        whole = {s: sum(counts.get((s, a * CLASSES + b), 0) for b in range(CLASSES)) + CLASSES for s in (True, False)}
        for b in range(CLASSES):
            one = {s: (counts.get((s, a * CLASSES + b), 0) + 1) / whole[s] for s in (True, False)}
            out.append(log(one[True] / one[False]))
    return out


def randomness(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to a constant

    def at(i: Column) -> Column:
        return _class(F.call_function("substring", token, i, F.lit(1)))

    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda s, i: s + F.get(table, at(i) * CLASSES + at(i + 1)))
    return total / (F.length(token) - 1)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    every = lambda m: F.lit(True)
    return matches(text, ASSIGN, 1, long_value), matches(text, ACCESS, 2, every, text.contains("AKIA")), matches(text, HEX, 3, every)


def found(docs: DataFrame, carried: Column, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """carried, text (null as empty), base and spans of every row."""
    model = train(samples if samples is not None else labelled_samples(docs))
    rows = docs.select(carried.alias("carried"), F.coalesce(sound("text"), F.lit("")).alias("text"))
    based = rows.withColumn("base", ordered(*base_spans(F.col("text"))))
    more = matches(F.col("text"), TOKEN, 4, lambda m: randomness(m, model) > threshold)
    return based.withColumn("more", more).withColumn("spans", ordered("base", apart(F.col("more"), F.col("base")))).drop("more")


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows = found(docs, F.col("doc_id").cast("long"), **options)
    return rows.select(
        F.col("carried").alias("doc_id"), *(count_of(F.col("base"), k + 1).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(written_out(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans"), KINDS).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = MARK, **options) -> DataFrame:
    """The input's columns, each run of secrets in the text as one mark; documents without one stay as they are."""
    rows = found(docs, packed(docs), **options).withColumn("new", replaced(F.col("text"), F.col("spans"), [mark] * len(KINDS)))
    hit = F.size("spans") > 0
    kept = {c: F.col(f"carried.`{c}`") for c in docs.columns}
    kept["text"] = F.when(hit, F.col("new")).otherwise(kept["text"])
    if "n_chars" in kept:
        kept["n_chars"] = F.when(hit, F.length("new")).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(c.alias(n) for n, c in kept.items()))
