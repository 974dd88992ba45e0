"""Storage and ordering helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import shared_dir

#: Rows of a few longs that are broadcast at most, 100 MB or less; beyond that Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of whole texts or sets in a batch that goes to a Python worker, which may hold several such batches and what it makes of them.
BATCH_BYTES = 4 << 20
#: Characters that separate words in every contract of this subpackage.
BLANKS = " \t\n\x0b\f\r"
#: The same as the inside of a Java character class.
BLANK_CLASS = r"\x20\x09-\x0D"


#: Paths of the tables that this process has written and not removed yet.
_written: list[str] = []


def few_files(spark: SparkSession) -> int:
    """Files for a table of narrow rows: one for each core, which then writes once."""
    return spark.sparkContext.defaultParallelism


def materialise(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and return a reader of it.

    Cuts the lineage: lost executors repeat one task of a later stage and never
    what came before the table. The table stays until discard() or sweep().
    files: deal the rows evenly to so many files at most, for narrow rows; else
    each task writes its own. A file costs an executor more than a few rows do:
    on local disks Hadoop starts a process for each permission that it sets.
    """
    spark = df.sparkSession
    if files is not None:
        df = df.repartition(files)
    path = f"{shared_dir(spark)}/obsidia-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._obsidia_path = path
    return out


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Remove the tables written after the first `since`, but for keep: nothing else of a finished stage is read again."""
    for path in _written[since:]:
        if path != getattr(keep, "_obsidia_path", None):
            _remove(spark, path)


def written() -> int:
    """How many tables stand; see sweep()."""
    return len(_written)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def discard(df: DataFrame | None) -> None:
    """Remove a table of materialise() that nothing will read again."""
    path = getattr(df, "_obsidia_path", None)
    if path in _written:
        _remove(df.sparkSession, path)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Tables written inside send Python workers batches of `most` bytes or a row more, however long texts are.

    Spark's own limits are 10,000 rows and 64 MB, and a worker keeps the memory
    of its largest batch for as long as it lives.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def broadcast_if_small(rows: DataFrame, most: int = BROADCAST_ROWS, files: int | None = None) -> DataFrame | None:
    """rows as a table, to be broadcast if they are counted to be `most` or fewer; None if there are none."""
    rows = materialise(rows, files)
    n = rows.count()
    if not n:
        discard(rows)
        return None
    return F.broadcast(rows) if n <= most else rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK_CLASS}]+"))


def count_words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has, without building them.

    A word starts at each character that is none of the blanks and follows one;
    so squeezing every run of blanks to one leaves a blank less than words.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    squeezed = F.regexp_replace(trimmed, f"[{BLANK_CLASS}]+", " ")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def running_totals(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Add before_<value> for each value: its exact total over all earlier rows.

    The total order is `order`, then the place of the row in the input. Rows are
    dealt by range (a key that many rows share is split by place), each
    partition's total is taken, the few totals are summed up in order, and every
    partition adds its offset to a sum of its own. No task sees more than its
    range; what is broadcast has one row for each partition.
    """
    spark = df.sparkSession
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(partitions(spark), *order, "_place").withColumn("_part", F.spark_partition_id())
    stored = materialise(dealt)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{v}").over(upto), F.lit(0)).alias(f"_base_{v}") for v in values])
    own = Window.partitionBy("_part").orderBy(*order, "_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = stored.join(F.broadcast(offsets), "_part")
    return summed.select(
        *df.columns,
        *[(F.col(f"_base_{v}") + F.coalesce(F.sum(v).over(own), F.lit(0))).alias(f"before_{v}") for v in values],
    )
