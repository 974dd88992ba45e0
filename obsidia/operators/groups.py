"""Rows by group in Python, many groups a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at once beside the group, and rows of a result's batch.
TAKEN, GIVEN = 256, 4096


def tasks(df: DataFrame) -> int:
    """Tasks for rows that are narrow and dear: as many as shuffles have, and a few a core at least."""
    spark = df.sparkSession
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(own, 3 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file over all tasks, before something dear is made of them."""
    return df.repartition(tasks(df))


def map_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows (tuples in order of schema) that run makes of each group's rows (dicts in the given order).

    Groups are dealt by key and sorted, so they follow each other in a task, and
    a call of a worker carries many: applyInPandas takes milliseconds a group. A
    group is whole in its worker; of the others only a few rows are. The number of tasks is
    given, as small rows would be put together into few by their bytes.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(made)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, columns), made, strict=True)], schema=made)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        last, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, TAKEN):
                for row in batch.slice(at, TAKEN).to_pylist():
                    key = [row[k] for k in keys]
                    if group and key != last:
                        out.extend(run(group))
                        group = []
                        if len(out) >= GIVEN:
                            yield table(out)
                            out = []
                    last = key
                    group.append(row)
        if group:
            out.extend(run(group))
        yield table(out)

    by: list[str | Column] = [*keys, *order]
    return df.repartition(tasks(df), *keys).sortWithinPartitions(*by).mapInArrow(mapped, schema)
