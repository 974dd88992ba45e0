"""Operator 5: contiguous shards of equal bytes from global prefix sums. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, running_totals


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one for its end; a null text has only the end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


#: Rows of a group stay in one shard if they are no larger than this share of a shard's target.
WHOLE_GROUP = 0.05


def contiguous_shards(df: DataFrame, order: list[str], size: str, shards: int, group: str | None = None) -> DataFrame:
    """Add shard and slot: rows in order, cut where prefix sums pass equal targets.

    df: narrow rows (order columns, a positive long size, whatever else is to be
    kept). The prefix sums of running_totals() are global, so every row's shard
    follows from the row's own middle byte: floor(middle * shards / total). A
    shard differs from the target by less than one row at each end. slot is the
    row's place within the shard, without gaps.

    group: the first of the order columns; rows that share its value and are, in
    all, at most WHOLE_GROUP of a target go by the middle byte of the group, so
    cuts move to its edges. Rows of larger groups, shards / WHOLE_GROUP groups
    at most, are cut like single rows and stay out of the join by group, so it
    has no hot key. Rows with a null group are no group.

    Null order keys sort first; equal rows are told apart by their place in the
    input; an empty table gives an empty table; fewer rows than shards leave
    shards empty. Column names of df are free except shard, slot, before_* and
    those that begin with an underscore.
    """
    # what is wide stays behind: the narrow table is read for its total, its ranges and its rows
    rows = materialise(df)
    total = max(1, rows.agg(F.sum(size)).first()[0] or 0)
    sums = running_totals(rows.withColumn("one", F.lit(1).cast("long")), order, [size, "one"])
    middle = F.col(f"before_{size}") * 2 + F.col(size)
    if group is not None:
        sums = materialise(sums)
        groups = sums.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"), F.min(f"before_{size}").alias("_first"), F.sum(size).alias("_size"))
        groups = materialise(groups.filter("_rows > 1 AND _group IS NOT NULL"))
        fits = F.col("_size") * shards <= WHOLE_GROUP * total
        same = F.col(group) == F.col("_group")
        # shards / WHOLE_GROUP groups at most are larger, so these may be broadcast
        large = F.broadcast(groups.filter(~fits).select("_group"))
        whole = groups.filter(fits).select("_group", (F.col("_first") * 2 + F.col("_size")).alias("_middle"))
        rest = sums.join(large, same, "left_anti").join(whole, same, "left").drop("_group")
        sums = rest.unionByName(sums.join(large, same, "left_semi").withColumn("_middle", F.lit(None).cast("long")))
        middle = F.coalesce("_middle", middle)
    cut = sums.withColumn("shard", F.least(F.floor(middle * shards / (2 * total)), F.lit(shards - 1)).cast("int"))
    starts = cut.groupBy("shard").agg(F.min("before_one").alias("first"))
    # a row for each shard
    out = cut.join(F.broadcast(starts), "shard").withColumn("slot", F.col("before_one") - F.col("first"))
    return out.select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of whole documents in the order of their texts' MD5, then ids: equal bytes, contiguous.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard
    (null: contiguous cuts move when a shard is added). Texts never leave the
    scan; some 40 bytes a document are shuffled. Equal texts are neighbours and
    stay in one shard unless their copies take more than WHOLE_GROUP of a
    shard's target. Null text: size 1, the checksum of no bytes (0), a neighbour
    of empty texts. Null doc_id: sorts first among equal texts.
    """
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(
        F.unhex(F.md5(whole)).alias("digest"),
        F.col(doc_id).alias("doc_id"),
        byte_size(F.col(text)).alias("size"),
        F.crc32(whole).alias("text_crc32"),
    )
    out = contiguous_shards(keyed, ["digest", "doc_id"], "size", shards, group="digest")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
