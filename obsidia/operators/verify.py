"""Does any treated value remain?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import norm, norm_of_soft, norm_soft

#: Shortest normal values that are sought with and without their separators.
SOFT, HARD = 4, 9


def leaks(suppressed: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value of each suppressed value that a piece of its document still holds.

    suppressed: keys, value; pieces: keys, text. A piece is a line, paragraph or
    cell, and no value is sought across two. A value of 4 or more normal
    characters is sought with its separators as one space; of 9 or more, without.
    Joined by document, so work is values times pieces of each document; a value
    that several pieces hold counts once.
    """
    values = suppressed.select(*keys, "value", norm_soft(F.col("value")).alias("_soft")).distinct()
    sought = values.withColumn("_hard", norm_of_soft(F.col("_soft"))).filter(F.length("_hard") >= SOFT)
    held = pieces.select(*[F.col(k).alias(f"_p_{k}") for k in keys], norm_soft(F.col("text")).alias("_piece_soft"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_p_{k}")
    hard = norm_of_soft(F.col("_piece_soft"))
    found = F.col("_piece_soft").contains(F.col("_soft")) | ((F.length("_hard") >= HARD) & hard.contains(F.col("_hard")))
    return sought.join(held, same & found, "left_semi").select(*keys, "value")


def verification(documents: DataFrame, suppressed: DataFrame, pieces: DataFrame, keys: list[str], metadata: DataFrame | None = None) -> DataFrame:
    """keys, ok, n_sought, leaked (the first five), metadata_ok of every document.

    metadata: keys, name, value of the properties that must be empty.
    """
    counts = suppressed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sought"))
    left = leaks(suppressed, pieces, keys).groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set("value")), 1, 5).alias("leaked"))
    out = documents.select(*keys).join(counts, keys, "left").join(left, keys, "left")
    if metadata is not None:
        bad = metadata.filter(F.coalesce(F.col("value"), F.lit("")) != "").select(*keys).distinct().withColumn("_bad", F.lit(True))
        out = out.join(bad, keys, "left")
    else:
        out = out.withColumn("_bad", F.lit(None).cast("boolean"))
    clean = F.col("_bad").isNull()
    return out.select(*keys, (F.col("leaked").isNull() & clean).alias("ok"), F.coalesce("n_sought", F.lit(0)).alias("n_sought"), F.coalesce("leaked", F.array().cast("array<string>")).alias("leaked"), clean.alias("metadata_ok"))


def scan_leaks(text, sought: list[str]):
    """Which of a few given values a text column still holds, as an expression (array of values)."""
    rows = [(norm_soft(F.lit(v)), norm(F.lit(v)), v) for v in sought]
    soft, hard = norm_soft(text), norm(text)
    hits = [F.when(((F.length(h) >= SOFT) & (s != "") & soft.contains(s)) | ((F.length(h) >= HARD) & hard.contains(h)), F.lit(v)) for s, h, v in rows]
    return F.array_compact(F.array(*hits))
