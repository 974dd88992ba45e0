"""The whole way of a text document: detect, repeat, treat, verify; and SQL functions."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plain import detect_spans
from ..operators.cells import with_columns_rule
from ..operators.detect import TEXT_CODES, detect, findings
from ..operators.propagate import propagate
from ..operators.pseudonyms import batch_aliases
from ..operators.treat import apply_findings, stats
from ..operators.verify import verification
from .tables import stored

_FOUND = ["doc_id", "location", "start", "end", "entity_code", "text", "score"]


class Protected(NamedTuple):
    blocks: DataFrame
    findings: DataFrame
    stats: DataFrame
    verification: DataFrame


def find_in_blocks(blocks: DataFrame, codes: Iterable[str] = TEXT_CODES, sheets: bool = True) -> DataFrame:
    """Findings of blocks (doc_id, ord, location, text): patterns, then columns of sheets, then other places.

    The order matters: a ruled cell loses its earlier findings, and values are
    sought elsewhere after that. Each step is written once, as the next ones
    read it more than once.
    """
    codes = list(codes)
    found = stored(findings(detect(blocks, codes), ["doc_id", "location"]).select(*_FOUND))
    if sheets:
        found = stored(with_columns_rule(found, blocks, codes))
    return stored(found.unionByName(propagate(blocks, found).select(*_FOUND)).withColumn("status", F.lit("accepted")))


def protect(blocks: DataFrame, treatment: str = "redact", codes: Iterable[str] = TEXT_CODES, scope: list[str] | None = None) -> Protected:
    """Treated blocks, with what was found, counts by category, and the verification of each document.

    scope: columns within which an alias stands for one value; the document by default.
    """
    found = find_in_blocks(blocks, codes)
    aliases = None
    if treatment == "pseudonymize":
        keys = scope or ["doc_id"]
        own = found if not scope else found.join(blocks.select("doc_id", *[k for k in keys if k != "doc_id"]).distinct(), "doc_id")
        made = batch_aliases(own, keys)
        aliases = made if keys == ["doc_id"] else own.select("doc_id", *[k for k in keys if k != "doc_id"]).distinct().join(made, [k for k in keys if k != "doc_id"]).select("doc_id", "entity_code", "value", "alias")
    done = stored(apply_findings(blocks, found, treatment, aliases))
    sought = found.select("doc_id", F.col("text").alias("value"))
    return Protected(done, found, stats(found, ["doc_id"]), verification(blocks.select("doc_id").distinct(), sought, done, ["doc_id"]))


def register(spark: SparkSession) -> None:
    """SQL functions: detect_spans(text, codes) gives an array, pii_spans(text, codes) rows (lateral join)."""

    @F.pandas_udf("array<struct<start:int,end:int,code:string>>")
    def spans(texts: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "code": k} for s, e, k in detect_spans(t or "", c if c is not None else TEXT_CODES)] for t, c in zip(texts, codes, strict=True)])

    class Spans:
        def eval(self, text: str, codes: list[str]):
            for s, e, k in detect_spans(text or "", codes or TEXT_CODES):
                yield s, e, k, text[s:e]

    spark.udf.register("detect_spans", spans)
    spark.udtf.register("pii_spans", F.udtf(Spans, returnType="start int, end int, code string, value string"))
