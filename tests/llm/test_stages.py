"""The pipeline's line dedup."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from obsidia.llm.common import written


def lines_left(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}


def test_a_line_on_one_page_in_twenty_goes(spark):
    rows = [(f"body {i}" + "\nAll rights reserved." * (i % 20 == 0) + "\nseldom" * (i in (3, 77)), "a") for i in range(200)]
    assert lines_left(spark, rows) == {i: t.replace("\nAll rights reserved.", "") for i, (t, _) in enumerate(rows)}


def test_copies_of_a_page_dont_make_its_lines_boilerplate(spark):
    rows = [("copied line\nanother of it\nfooter", "a")] * 40 + [(f"page {i}\nfooter", "a") for i in range(60)] + [(None, "a")] * 9 + [("alone", None)] * 7
    left = lines_left(spark, rows)
    assert [left[i] for i in range(40)] == ["copied line\nanother of it"] * 40
    assert [left[i] for i in range(40, 100)] == [f"page {i}" for i in range(60)]
    assert left[100] is None and left[110] == "alone"


def test_pages_that_are_mostly_shared_stay_whole(spark):
    """Near copies share nearly all their lines; they are left to the near dedup, not emptied."""
    body = [f"a longer line of the copied article, number {k}" for k in range(8)]
    rows = [("\n".join([*body, f"edit {i}"]), "a") for i in range(50)] + [(f"page {i} with a text of its own\nfooter", "a") for i in range(60)]
    left = lines_left(spark, rows)
    assert [left[i] for i in range(50)] == [t for t, _ in rows[:50]]
    assert [left[i] for i in range(50, 110)] == [f"page {i} with a text of its own" for i in range(60)]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows(spark, odd_docs, no_docs, stage):
    """Nulls in any column, empty and repeated rows, an empty table, and extra columns with names used inside."""
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = odd_docs.select("doc_id", "text", "lang", "source", F.col("size").cast("long").alias("n_chars"), F.lit(1).alias("cid"), F.lit(2).alias("line"), F.lit(3).alias("component"), F.lit(4).alias("failed"))
    docs = docs.unionAll(docs.select(F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long"), *[F.lit(None).cast("int")] * 4))
    out = run(spark, docs, "")
    rows = out.collect()
    assert run(spark, no_docs, "").count() == 0
    if stage != "packing":
        assert out.columns == docs.columns
    if stage == "line_dedup":
        assert len(rows) == docs.count()
    if stage == "near_dedup":
        # ids 1 and 2 are copies; null, empty and blank texts are one group
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "6", "7", "8", "9", "10", "None"])


def test_stage_tables_are_removed(spark, sf_dir):
    before = written()
    out = corpus_pipeline.run(spark, sf_dir)
    kept = written() - before
    assert out.count() and kept < 8
