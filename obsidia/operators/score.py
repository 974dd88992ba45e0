"""Recall against known values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import norm
from .groups import map_groups


def recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, entity_code, hits, missed, extra: expected values matched one to one with found ones.

    Both: doc_id, ord, entity_code, text. A pair matches if either normal form
    holds the other; signatures match any. Expected values choose in order, the
    first free match. A document's values of a category are the unit; values of
    one ord are in order of their normal form.
    """
    rows = lambda df, kind: df.select("doc_id", "entity_code", "ord", norm(F.col("text")).alias("value"), F.lit(kind).alias("kind"))

    def run(rows: list[dict]) -> list[tuple]:
        code, hits, missed = rows[0]["entity_code"], 0, 0
        free = [r["value"] for r in rows if r["kind"] == "found"]
        for want in (r["value"] for r in rows if r["kind"] == "expected"):
            at = next((i for i, v in enumerate(free) if code == "FIRMA" or (want and v and (want in v or v in want))), None)
            if at is None:
                missed += 1
            else:
                hits += 1
                free.pop(at)
        return [(rows[0]["doc_id"], code, hits, missed, len(free))]

    both = rows(expected, "expected").unionByName(rows(found, "found"))
    return map_groups(both, ["doc_id", "entity_code"], ["ord", "value"], run, f"doc_id {dict(both.dtypes)['doc_id']}, entity_code string, hits long, missed long, extra long")
