"""Detection in plain text: all categories, overlaps resolved."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_SCORE, ENTITIES, SCORES
from ..functions.names import FIRST_NAMES, SURNAMES, NameFinder
from ..functions.plain import detect_spans
from ..functions.spans import NO_SPANS, values_of
from .groups import TAKEN

TEXT_CODES = tuple(c for c in ENTITIES if c != "FIRMA")


def detect(df: DataFrame, codes: Iterable[str] = TEXT_CODES, text: str = "text", spans: str = "spans", first_names: frozenset[str] = FIRST_NAMES, surnames: frozenset[str] = SURNAMES) -> DataFrame:
    """Add the disjoint spans of personal data in a text, in order; offsets are code points.

    An Arrow function reads each text once: as expressions, the patterns of all
    categories took seconds to plan and compiled anew in each row. Null text: no
    spans. Nothing is shuffled.
    """
    wanted, names = frozenset(codes), NameFinder(first_names, surnames)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("code", pa.string())])

    @F.arrow_udf(NO_SPANS)
    def find(texts: pa.Array) -> pa.Array:
        ends, found = [0], []
        for at in range(0, len(texts), TAKEN):
            for t in texts.slice(at, TAKEN).to_pylist():
                found += detect_spans(t, wanted, names) if t else ()
                ends.append(len(found))
        starts, stops, codes = zip(*found, strict=True) if found else ((), (), ())
        values = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(codes, pa.string())], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return df.withColumn(spans, find(F.coalesce(F.col(text), F.lit(""))))


def findings(df: DataFrame, keys: list[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """One row a span: keys, start, end, entity_code, text, score, source, status, finding_id.

    The id is a digest of keys, code and offsets, so a rerun gives the same.
    """
    score = F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair])
    whole = df.withColumn("_values", values_of(F.coalesce(F.col(text), F.lit("")), F.col(spans)))
    # the text stays behind: a row of the result holds its value alone
    rows = whole.select(*keys, F.explode(F.zip_with(spans, "_values", lambda s, v: F.struct(s.alias("span"), v.alias("value")))).alias("_s"))
    out = rows.select(
        *keys,
        F.col("_s.span.start").alias("start"),
        F.col("_s.span.end").alias("end"),
        F.col("_s.span.code").alias("entity_code"),
        F.col("_s.value").alias("text"),
        F.coalesce(score[F.col("_s.span.code")], F.lit(DEFAULT_SCORE)).alias("score"),
        F.lit("auto").alias("source"),
        F.lit("accepted").alias("status"),
    )
    return out.withColumn("finding_id", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], "entity_code", F.col("start").cast("string")), 256))
