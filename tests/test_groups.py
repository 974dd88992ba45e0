"""Small groups in Python: right over batches, and many a call."""

from pyspark.sql import functions as F

from obsidia.operators import geometry, paged
from obsidia.operators.groups import dealt, map_groups, tasks
from obsidia.operators.score import recall


def plan(df):
    return df._jdf.queryExecution().toString()


def test_groups_are_whole_over_batches(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("c"), (-F.col("id")).alias("n"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = map_groups(rows, ["k", "c"], ["n"], lambda g: [(g[0]["k"], g[0]["c"], [r["n"] for r in g])], "k long, c string, ns array<long>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for i in range(5000):
        want.setdefault((i % 700, "x" if i % 2 == 0 else None), []).append(-i)
    assert {(r.k, r.c): r.ns for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)


def test_no_rows(spark):
    assert map_groups(spark.range(0), ["id"], [], lambda g: [(1,)], "n int").count() == 0


def test_pages_are_no_call_each(spark):
    """a page was a call of applyInPandas."""
    word = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
    words = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(x)).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x + 90.0).alias("x1"), F.lit(30.0).alias("y1")) for x, t in ((0, "Sr."), (100, "Ana"), (200, "Soto"))]).cast(word)
    pages = spark.range(600).select(F.floor(F.col("id") / 2).cast("long").alias("doc_id"), (F.col("id") % 2 + 1).cast("int").alias("page"), F.lit(2000.0).alias("width"), F.lit(2400.0).alias("height"), words.alias("words"), F.lit(None).cast(word).alias("verification_words"))
    found = paged.read_documents(pages, ["NOMBRE"])
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert sorted((r.doc_id, r.page, r.text) for r in found.collect()) == [(i // 2, i % 2 + 1, "Ana Soto") for i in range(600)]


def test_recall_is_no_call_a_document(spark):
    """a document's values of a category were a call of applyInPandas."""
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), F.lit("RUT").alias("entity_code"), F.concat(F.lit("v"), "id").alias("text"))
    out = recall(rows, rows.filter("doc_id % 2 = 0").unionByName(rows.withColumn("text", F.lit("-")).withColumn("ord", F.lit(1))))
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(i, "RUT", 1 - i % 2, i % 2, 1) for i in range(500)]


def test_supplement_is_no_call_a_page(spark):
    """a page was a call of applyInPandas; lists and arrays of boxes agree."""
    at = lambda c: F.col(c).cast("double")
    rows = spark.range(60 * 8).select((F.col("id") % 8).alias("doc_id"), F.lit(1).alias("page"), F.floor(F.col("id") / 8).cast("int").alias("idx"), F.lit("w").alias("text"), (F.col("id") * 37 % 211).alias("x0"), (F.col("id") * 53 % 97).alias("y0"))
    rows = rows.select("doc_id", "page", "idx", "text", at("x0").alias("x0"), at("y0").alias("y0"), (at("x0") + 60).alias("x1"), (at("y0") + 30).alias("y1"))
    out = geometry.supplement(rows, rows.limit(0))
    assert "FlatMapGroupsInPandas" not in plan(out)
    few, geometry.FEW = geometry.FEW, 0
    try:
        arrays = geometry.supplement(rows, rows.limit(0)).collect()
    finally:
        geometry.FEW = few
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, arrays)) and 8 < len(got) < 480


def test_dear_rows_are_dealt_out(spark):
    """rows of one small file were one task."""
    assert dealt(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == tasks(spark.range(1)) > 1
