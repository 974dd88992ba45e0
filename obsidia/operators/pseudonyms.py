"""Stable aliases for values, by scope and category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import norm
from ..plans.tables import numbered
from .treat import alias_prefix


def _alias(code: str, number: str):
    return F.format_string("%s-%02d", alias_prefix(F.col(code)), F.col(number))


def batch_aliases(found: DataFrame, scope: list[str]) -> DataFrame:
    """scope, entity_code, value, alias: distinct normal values of accepted findings, numbered in order.

    Numbers are dealt by range, so a scope that is the whole corpus isn't one task.
    """
    kept = found.filter(F.col("status").isin("accepted", "edited") & (F.coalesce(F.col("text"), F.lit("")) != ""))
    values = kept.select(*scope, "entity_code", norm(F.col("text")).alias("value")).distinct()
    return numbered(values, [*scope, "entity_code"], [F.col("value")]).select(*scope, "entity_code", "value", _alias("entity_code", "number").alias("alias"))


def persistent_aliases(found: DataFrame, known: DataFrame, scope: str = "scope_id") -> DataFrame:
    """The table of aliases after new values joined it: scope, entity_code, value_hash, alias.

    known: the same columns. A known value keeps its alias. New ones, in order
    of value, take the smallest numbers that are free in their scope and
    category: the free numbers are those up to the count of all values that no
    alias has, so value k of the new takes free number k.
    """
    kept = found.filter(F.col("status").isin("accepted", "edited") & (F.coalesce(F.col("text"), F.lit("")) != ""))
    values = kept.select(scope, "entity_code", norm(F.col("text")).alias("value")).distinct()
    hashed = values.withColumn("value_hash", F.sha2(F.concat_ws(":", "entity_code", "value").cast("binary"), 256))
    keys = [scope, "entity_code"]
    new = numbered(hashed.join(known, [*keys, "value_hash"], "left_anti"), keys, [F.col("value")], "nth")
    used = known.select(*keys, F.regexp_extract("alias", r"-(\d+)$", 1).try_cast("int").alias("number")).filter("number is not null").distinct()
    # numbers that are used, in order: k used ones below number u leave u - 1 - k free ones below it
    counts = new.groupBy(*keys).agg(F.max("nth").alias("wanted"))
    held = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used"))
    span = counts.join(held, keys, "left").withColumn("top", F.col("wanted") + F.coalesce("n_used", F.lit(0)))
    free = span.select(*keys, F.explode(F.sequence(F.lit(1), F.col("top").cast("int"))).alias("number")).join(used, [*keys, "number"], "left_anti")
    ranked = numbered(free, keys, [F.col("number")], "nth")
    fresh = new.join(ranked, [*keys, "nth"]).select(*keys, "value_hash", _alias("entity_code", "number").alias("alias"))
    return known.select(*keys, "value_hash", "alias").unionByName(fresh)
