"""Tables of a SQLite file, for a one-time import."""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.workflow import audit_breaks

#: Rows that a task hands on at once.
_STEP = 10_000


def table_names(spark: SparkSession, path: str) -> set[str]:
    """Names of a file's tables, read in the task that reads the file."""

    def run(batches):
        for rows in batches:
            for content in rows["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(content)
                    f.flush()
                    with sqlite3.connect(f"file:{f.name}?mode=ro", uri=True) as db:
                        yield pd.DataFrame(db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'").fetchall(), columns=["name"])

    return {r.name for r in spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string").collect()}


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table's rows. The file comes by Spark's reader and is opened from a scratch copy in the task that reads it."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    listed = ", ".join(f'"{n}"' for n in names)

    def run(batches):
        for rows in batches:
            for content in rows["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(content)
                    f.flush()
                    with sqlite3.connect(f"file:{f.name}?mode=ro", uri=True) as db:
                        found = db.execute(f'SELECT {listed} FROM "{table}"')
                        while part := found.fetchmany(_STEP):
                            yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def check_tables(spark: SparkSession, path: str, wanted: Iterable[str]) -> tuple[set[str], set[str]]:
    """Tables that are missing from the file, and that nobody expects."""
    have = table_names(spark, path)
    return set(wanted) - have, have - set(wanted)


def import_problems(spark: SparkSession, path: str, wanted: Iterable[str], audit: str, audit_schema: str) -> list[str]:
    """Why a file can't be imported: tables that are missing or unexpected, or an audit table whose chain is broken; [] if it can."""
    missing, more = check_tables(spark, path, wanted)
    out = [f"missing {t}" for t in sorted(missing)] + [f"unexpected {t}" for t in sorted(more)]
    if audit not in missing:
        broken = audit_breaks(read_sqlite(spark, path, audit, audit_schema)).first()
        out += [] if broken.ok else [f"{audit} broken at {broken.broken_at}"]
    return out
