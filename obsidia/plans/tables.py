"""Tables in the shared folder, and exact numbers over a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a plain local master may do without, with a folder of its own."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="obsidia-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/obsidia-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str = "number", dense: Column | None = None) -> DataFrame:
    """Number the rows of each group from 1 in an order, without one task for a group.

    Rows are dealt by range of (groups, order); each range numbers its own rows,
    and the ranges' counts, a row for each group and range, give the offsets. With
    `dense`, numbers count the rows where it holds (dense ranks of sorted rows:
    the first row of each value).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = F.lit(1) if dense is None else dense.cast("int")
    ranged = stored(df.repartitionByRange(n, *[F.col(g) for g in groups], *order).withColumn("_range", F.spark_partition_id()))
    keys = [*groups, "_range"]
    totals = ranged.groupBy(*keys).agg(F.sum(counted).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(f"_k{i}").eqNullSafe(F.col(k))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, same).withColumn(name, (F.sum(counted).over(upto) + F.col("_offset")).cast("int")).select(*df.columns, name)
