"""Each found value at all of its other places in the document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest value that is sought elsewhere, and the confidence of what is found.
SHORTEST = 6
SCORE = 0.9
_JOINERS = "@._+-"


def _bounded(text: str, start: int, end: int) -> bool:
    """Does a name stand alone here, also not as a part of an address?"""
    return not any(c.isalnum() or c in _JOINERS for c in (text[start - 1 : start] + text[end : end + 1]))


def occurrences(text: str, values: list[tuple[str, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, code) of the values (lower case, code) in a text, off what is taken, in order of value."""
    low, out = text.lower(), []
    for value, code in values:
        at = low.find(value)
        while at >= 0:
            end = at + len(value)
            clear = not any(s < end and at < e for s, e in taken)
            if clear and (code != "NOMBRE" or _bounded(text, at, end)):
                taken.append((at, end))
                out.append((at, end, code))
            at = low.find(value, at + 1)
    return out


def propagate(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, location, start, end, entity_code, text, score of further places of found values.

    blocks: doc_id, ord, location, text. found: doc_id, location, start, end,
    entity_code, text. A value has 6 characters or more and doesn't begin with a
    bracket; case makes no difference; of values that differ in case alone the
    first one's category counts. Names stand alone, others may stand inside
    words; no value is sought across two blocks; what overlaps a finding is none.

    A document's values meet its blocks as one list, so a block stays one row;
    there the list is cut to what the block holds. Only blocks that hold some,
    each with its own values and findings, go to Python for offsets.
    """
    first = found.join(blocks.select("doc_id", "location", F.col("ord").alias("_ord")), ["doc_id", "location"])
    value = F.btrim("text", F.lit(" \t\n\r\x0b\f"))
    kept = first.withColumn("_value", F.lower(value)).filter((F.length(value) >= SHORTEST) & (F.col("entity_code") != "FIRMA") & ~value.startswith("("))
    order = F.struct("_ord", "start", F.col("entity_code").alias("code"))
    values = kept.groupBy("doc_id", "_value").agg(F.min(order).alias("_first"))
    lists = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_first", "_value"))).alias("_all"))
    low = blocks.select("doc_id", "location", "text").join(lists, "doc_id").withColumn("_low", F.lower("text"))
    sought = low.withColumn("_values", F.filter("_all", lambda v: F.contains(F.col("_low"), v["_value"]))).filter(F.size("_values") > 0).drop("_all", "_low")
    taken = found.groupBy("doc_id", "location").agg(F.collect_list(F.struct("start", "end")).alias("_taken"))
    work = sought.join(taken, ["doc_id", "location"], "left").select(
        "doc_id", "location", "text",
        F.transform("_values", lambda v: v["_value"]).alias("keys"), F.transform("_values", lambda v: v["_first"]["code"]).alias("codes"),
        F.coalesce(F.transform("_taken", lambda t: t["start"]), F.array().cast("array<int>")).alias("starts"),
        F.coalesce(F.transform("_taken", lambda t: t["end"]), F.array().cast("array<int>")).alias("ends"),
    )

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                for s, e, c in occurrences(r.text, list(zip(r.keys, r.codes, strict=True)), list(zip(r.starts, r.ends, strict=True))):
                    out.append((r.doc_id, r.location, s, e, c, r.text[s:e], SCORE))
            yield pd.DataFrame(out, columns=["doc_id", "location", "start", "end", "entity_code", "text", "score"])

    return work.mapInPandas(run, f"doc_id {dict(blocks.dtypes)['doc_id']}, location string, start int, end int, entity_code string, text string, score double")
