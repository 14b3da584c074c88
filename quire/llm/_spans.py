"""Spans of patterns in texts, by DataFrame functions only.

A span is (start, kind, end): code points, end exclusive, kind as a number from 1 in the order of the list
of kinds. Between a pattern's matches lie the pieces that split() gives, so lengths of pieces and matches
add up to the places. Spans are gathered in short runs, each in a fold of its own, so no step copies the whole list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Spans, or parts of a text, that are gathered in one fold.
RUN = 256


def no_spans() -> Column:
    return F.array().cast(SPANS)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gathered(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]], use: Callable[[Column, Column], Column]) -> Column:
    """use(at, out) of a fold of items from place 0; step gives the new place, whether to add an element, and the element.

    A fold copies its state at each item, so none may carry the whole list: a first one finds the place before each run
    of items, then every run is folded by itself from there.
    """
    none = F.array().cast(kind)

    def before(seen: Column, run: Column) -> Column:
        at = F.aggregate(run, seen["at"], lambda at, item: step(at, item)[0])
        return F.struct(at.alias("at"), F.concat(seen["before"], F.array(seen["at"])).alias("before"))

    def gather(run: Column, at: Column) -> Column:
        def add(seen: Column, item: Column) -> Column:
            place, more, element = step(seen["at"], item)
            return F.struct(place.alias("at"), F.when(more, F.concat(seen["out"], F.array(element))).otherwise(seen["out"]).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), add, lambda seen: seen["out"])

    def cut(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(RUN)), lambda i: F.slice(every, i, F.lit(RUN)))

    def fold(runs: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        return _bound(F.aggregate(runs, begin, before), lambda seen: use(seen["at"], F.flatten(F.zip_with(runs, seen["before"], gather))))

    return _bound(_bound(items, cut), fold)


def matches(text: Column, pattern: str, kind: int | Callable[[Column], Column], keep: Callable[[Column], Column], hint: Column | None = None) -> Column:
    """Spans of the leftmost, non-overlapping matches that `keep` holds for; kind: a number, or one by the match.
    hint: false where there is none."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(at: Column, pair: Column) -> tuple[Column, Column, Column]:
        piece, match = pair["piece"], pair["match"]
        start = at + F.length(piece)
        end = start + F.coalesce(F.length(match), F.lit(0))
        number = kind(match) if callable(kind) else F.lit(kind)
        span = F.struct(start.alias("start"), number.alias("kind"), end.alias("end"))
        return end, match.isNotNull() & keep(match), span

    found = _gathered(pairs, SPANS, step, lambda at, out: out)
    return F.when(text.rlike(pattern) if hint is None else hint, found).otherwise(no_spans())


def ordered(*spans: Column) -> Column:
    return F.sort_array(F.concat(*spans))


def written_out(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"] - 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def replaced(text: Column, spans: Column, marks: list[str]) -> Column:
    """The text with each run of overlapping spans (ordered by start) as one mark, that of the run's first span's kind."""
    names = F.array(*map(F.lit, marks))

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        part = F.concat(F.call_function("substring", text, at + 1, s["start"] - at), F.get(names, s["kind"] - 1))
        return F.greatest(at, s["end"]), s["start"] >= at, part

    whole = _gathered(spans, "array<string>", step, lambda at, out: F.concat(F.array_join(out, ""), F.call_function("substring", text, at + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
