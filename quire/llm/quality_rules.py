"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio with a threshold taken from the trusted texts.

Words and pairs of neighbouring words are hashed into buckets of their own; two multinomials over the buckets, one of
the trusted target texts and one of the whole corpus, give each n-gram log(p_target / p_corpus). Both are smoothed by
PSEUDO occurrences a bucket at the corpus's rate, so an n-gram says as much as its counts do, at any size of the
tables. A text is scored without itself: one occurrence of each of its n-grams is taken from the corpus's counts, and
from the trusted ones too where the text is trusted. Its score is the mean over its n-grams.

The threshold lies SPREADS standard deviations (MIN_SPREAD at least) below the mean score of the trusted texts that
pass the base rules; a text is kept where the base rules pass and its score reaches it. The rule holds no number that
depends on the tables' size. Ratios are whole multiples of 1 / SCALE, so sums do not depend on the order of rows. Only
DataFrame functions run; texts are cut and hashed once to count and once to score, inside the row: no n-gram is
shuffled but as a count of its bucket. The ratios are two rows, for other texts and for trusted ones, each an array of
`buckets` whole numbers a kind of n-gram, MOST_BUCKETS at most, whatever the corpus's size; they are sent to all tasks.

Defined cases: a null text has no words, fails the base rules and has score 0; texts of any length are read whole;
repeated rows are separate documents and are counted as often; trusted ids that are null or match no document count
nothing, and with no trusted text at all every score is 0, so only the base rules decide; an empty table gives an
empty result; further columns, whatever their names, are not read by the rules and are kept by kept_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, packed, text_of, written

#: Buckets of the words, and again of the pairs.
BUCKETS = 1 << 16
MOST_BUCKETS = 1 << 20
PSEUDO = 3.0
SPREADS = 4.0
MIN_SPREAD = 0.03
SCALE = 2048
MIN_WORDS = 20
MAX_REPEAT_SHARE = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\x0b\x0c\r"
#: Trusted ids are sent to all tasks up to this many (some 60 MB); beyond, they are joined by shuffle.
MOST_SENT_IDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _neighbour(array: Column, by: int) -> Column:
    return F.slice(array, 1 + by, F.greatest(F.size(array) - by, F.lit(0)))


def _joined(hashes: str, by: int) -> Column:
    """Hashes of runs of 2 * by words from those of runs of `by`."""
    h = F.col(hashes)
    both = F.zip_with(h, _neighbour(h, by), lambda a, b: F.xxhash64(a, b))
    return F.slice(both, 1, F.greatest(F.size(h) - by, F.lit(0)))


def hashed(rows: DataFrame) -> DataFrame:
    """Adds words, and the hashes h1 and h2 of words and pairs; of rows with text."""
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("h2", _joined("h1", 1))


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: how many words lie in windows that come twice or more in their text.

    Window hashes grow by doubling: 2, 4, 8 words. Where two are alike they are sorted with their places; equal
    neighbours are repeats; their places, in order, cover up to WINDOW words each. Arrays meet by zipping, never
    inside a lambda.
    """
    h, s = F.col("h8"), F.col("sorted")
    rows = rows.withColumn("h4", _joined("h2", 2)).withColumn("h8", _joined("h4", 4))
    paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), paired).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    nobody = F.array(F.lit(None).cast("struct<h:long,i:int>"))
    sides = F.arrays_zip(F.concat(nobody, s).alias("a"), s.alias("b"), _neighbour(s, 1).alias("c"))
    again = F.filter(sides, lambda z: z["b"].isNotNull() & (z["b"]["h"].eqNullSafe(z["a"]["h"]) | z["b"]["h"].eqNullSafe(z["c"]["h"])))
    places = F.sort_array(F.transform(again, lambda z: z["b"]["i"]))

    def cover(seen: Column, at: Column) -> Column:
        return F.struct((at + WINDOW).alias("end"), (seen["n"] + WINDOW - F.greatest(seen["end"] - at, F.lit(0))).alias("n"))

    covered = F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda seen: seen["n"])
    return rows.withColumn("n_repeat_words", F.when(F.size(s) > 0, covered).otherwise(F.lit(0)).cast("long")).drop("h4", "h8", "sorted")


def base_rules(rows: DataFrame) -> DataFrame:
    """Adds the base columns to hashed rows."""
    t = F.col("text")
    rows = rows.withColumn("lines", F.filter(F.split(t, "\n", -1), lambda x: F.ltrim(x, F.lit(BLANKS)) != ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    rows = rows.withColumn("n_symbols", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    rows = repeated_words(rows)
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words")))


def buckets_of(buckets: int) -> Column:
    """The buckets of hashed rows' words, then of their pairs."""
    return F.concat(F.transform("h1", lambda h: F.pmod(h, F.lit(buckets))), F.transform("h2", lambda h: F.pmod(h, F.lit(buckets)) + buckets))


def with_trusted(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """Adds trusted, whether the row's doc_id is among the first column's ids."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("known", F.lit(True))
    if ids.count() <= MOST_SENT_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("known", F.lit(False))).drop("known")


def ratios(rows: DataFrame, buckets: int, pseudo: float = PSEUDO) -> DataFrame | None:
    """Written: trusted, ratios: two rows, for other texts and for trusted ones, a number for each bucket; None where no
    text is trusted. rows: text, trusted."""
    # One key for bucket and side, so that a count is all that a task keeps of it.
    grams = hashed(rows.select("text", "trusted")).select(F.explode(buckets_of(buckets)).alias("bucket"), "trusted")
    keyed = grams.select((F.col("bucket") * 2 + F.col("trusted").cast("long")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    sides = keyed.groupBy((F.col("key") / 2).cast("long").alias("bucket")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("key") % 2 == 1, F.col("n")).otherwise(0)).alias("own"))
    counts = written(sides, "ngram-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.sum("own").alias("own")).first()
    if not whole["own"]:
        return None
    share = whole["own"] / whole["n"]
    others = F.greatest(F.col("n") - 1, F.lit(0))

    def ratio(own: Column) -> Column:
        return F.round(SCALE * F.log((own + pseudo * share) / (share * (others + pseudo)))).cast("int")

    found = counts.select("bucket", ratio(F.least(F.col("own"), others)).alias("other"), ratio(F.greatest(F.col("own") - 1, F.lit(0))).alias("own"))
    tables = {False: [0] * (2 * buckets), True: [0] * (2 * buckets)}
    for r in found.toLocalIterator():  # 2 * buckets rows at most
        tables[False][r["bucket"]], tables[True][r["bucket"]] = r["other"], r["own"]
    return written(rows.sparkSession.createDataFrame(list(tables.items()), "trusted boolean, ratios array<int>").coalesce(1), "ratios")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judged(docs: DataFrame, trusted: DataFrame, carried: Column, buckets: int = BUCKETS, pseudo: float = PSEUDO, spreads: float = SPREADS, min_spread: float = MIN_SPREAD) -> DataFrame:
    """carried, the base columns, score and kept of every row."""
    if buckets > MOST_BUCKETS:
        raise ValueError(f"at most {MOST_BUCKETS} buckets: their ratios are sent to all tasks")
    rows = with_trusted(docs.select(carried.alias("carried"), F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text")), trusted)
    table = ratios(rows, buckets, pseudo)
    based = base_rules(hashed(rows))
    if table is None:
        scored = based.withColumn("score", F.lit(0.0))
    else:
        # Two rows are sent; the join comes last, so that no further step carries a row's ratios.
        placed = based.select("carried", *BASE, "trusted", buckets_of(buckets).alias("places")).join(F.broadcast(table), "trusted")
        total = F.aggregate("places", F.lit(0).cast("long"), lambda s, b: s + F.get(F.col("ratios"), b.cast("int")))
        scored = placed.withColumn("score", F.when(F.size("places") > 0, total / (SCALE * F.size("places"))).otherwise(F.lit(0.0)))
    scored = written(scored.select("carried", *BASE, "trusted", "score"), "scores")
    known = scored.filter("trusted AND NOT base_failed").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")).first()
    threshold = None if known["mean"] is None or table is None else round(known["mean"] - spreads * max(known["spread"], min_spread), 4)
    fit = F.lit(True) if threshold is None else F.col("score") >= threshold
    return scored.drop("trusted").withColumn("kept", ~F.col("base_failed") & fit)


def quality_rules(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """doc_id, the base columns, score and kept of every row. trusted: ids of the target texts, in the first column."""
    return judged(docs, trusted, F.col("doc_id").cast("long"), **options).withColumnRenamed("carried", "doc_id")


def kept_documents(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The input's rows that are kept."""
    return judged(docs, trusted, packed(docs), **options).filter("kept").select("carried.*")
