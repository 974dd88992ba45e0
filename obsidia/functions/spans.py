"""Spans struct<start, end, code>: matches with offsets, and splicing, as expressions.

All are linear in a text and its spans, or nearly so: an array that grows by
one in a fold is copied each time, so folds run over short stretches, whose ends
are folded again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .arrays import let
from .patterns import TRAILING, Detector, java
from .validators import CHECKS

SPAN = "struct<start:int,end:int,code:string>"
NO_SPANS = f"array<{SPAN}>"
#: Values that one fold gathers.
STRETCH = 128
#: Spans from which a text is cut in Python, as Spark finds a code point only from the start of a text.
MANY = 64


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results, from 0 on, of a function over an array of ints that has some; a variable of let(), as it is read by place.

    A fold over stretches, each folded from where the last one ended.
    """
    none = F.array().cast("array<int>")

    def stretch(last: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(combine(acc["last"], x).alias("last"), F.array_append(acc["out"], combine(acc["last"], x)).alias("out"))
        # by place: slice() copies the whole array first
        own = F.transform(F.sequence(start, F.least(start + STRETCH - 1, F.size(values) - 1)), lambda i: values[i])
        return F.aggregate(own, F.struct(last.alias("last"), none.alias("out")), step)

    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(STRETCH))
    whole = F.struct(F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(starts, whole, lambda acc, s: let(stretch(acc["last"], s), lambda r: F.struct(r["last"].alias("last"), F.array_append(acc["out"], r["out"]).alias("out"))), lambda acc: acc["out"]))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, offsets in code points.

    What stands between matches and the matches themselves, in turn, make up the
    text, so running sums of their lengths give the offsets. Group 1 must end
    its match.
    """

    def placed(whole: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        lengths = F.zip_with(whole, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), lambda w, gap: F.length(w) + F.length(gap))
        ends = let(lengths, lambda x: scan(x, lambda a, b: a + b))
        return F.zip_with(values, ends, lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) == 0, none).otherwise(placed(whole)))


def detector_spans(text: Column, detector: Detector) -> Column:
    """Checked and trimmed spans of one detector; its guard saves the pattern where nothing can match."""
    found = matches(text, java(detector), detector.group)
    if detector.check:
        found = F.filter(found, lambda m: CHECKS[detector.check](m["value"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(F.rtrim(m["value"], F.lit(TRAILING)))).alias("end"), F.lit(detector.code).alias("code")))
    if detector.guard:
        spans = F.when(text.rlike(f"(?U){detector.guard}"), spans).otherwise(F.array().cast(NO_SPANS))
    return spans


@F.pandas_udf(ArrayType(StringType()))
def _cut(texts: pd.Series, bounds: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [t[a:b] for a, b in zip(x[:-1], x[1:], strict=True)] for t, x in zip(texts, bounds, strict=True)])


def pieces(text: Column, spans: Column) -> Column:
    """What lies before, in and after disjoint, ordered spans, in turn: 2n + 1 strings."""
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(F.length(text)))
    few = let(bounds, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: F.substring(text, b[i] + 1, b[i + 1] - b[i])))
    many = F.size(spans) > MANY
    return F.when(many, _cut(F.when(many, text), F.when(many, bounds))).otherwise(few)


def values_of(text: Column, spans: Column) -> Column:
    """The text of each span, in order."""
    return let(pieces(text, spans), lambda p: F.transform(spans, lambda s, i: p[2 * i + 1]))


def splice(text: Column, spans: Column, replacement: Callable[[Column, Column], Column]) -> Column:
    """Text with each of the disjoint, ordered spans replaced by replacement(value, span)."""
    new = F.transform(pieces(text, spans), lambda p, i: F.when(i % 2 == 0, p).otherwise(replacement(p, spans[F.floor(i / 2).cast("int")])))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(new, ""))
