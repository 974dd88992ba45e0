"""Helpers for expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def lookup(column: Column, table: dict[str, str], default: Column) -> Column:
    """The value of a small fixed table at a column, else default."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[column], default) if pairs else default
