"""What the pipeline's stages hold in a Python worker at once, and how many files they write."""

import os

import pyarrow as pa
import pytest

import corpus_pipeline
from obsidia.llm import blocks, common

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])


@pytest.mark.parametrize("stage, called", [("near_dedup", "one_of_each_near_copy"), ("packing", "pack_documents")])
def test_batches_of_long_texts_are_small(spark, monkeypatch, stage, called):
    docs = spark.createDataFrame([(i, "word " * 12_000) for i in range(300)], "doc_id long, text string").coalesce(1)
    sizes = lambda docs, *_: common.materialise(docs.mapInArrow(batch_sizes, "n long, size long"))
    monkeypatch.setattr(corpus_pipeline, called, sizes)
    before = spark.conf.get(LIMIT)
    seen = getattr(corpus_pipeline, stage)(spark, docs, "").collect()
    assert sum(r.n for r in seen) == 300
    assert max(r.size for r in seen) <= common.BATCH_BYTES + 100_000
    assert spark.conf.get(LIMIT) == before


def test_whole_groups_of_wide_rows_come_in_small_tables():
    rows = [(k, [k] * 2_000) for k in range(60) for _ in range(5)]
    made = [pa.RecordBatch.from_pydict({"key": [r[0] for r in part], "wide": [r[1] for r in part]}) for part in (rows[i : i + 7] for i in range(0, len(rows), 7))]
    tables = list(blocks._whole_groups(iter(made), ["key"], 4096, 200_000))
    assert [k for t in tables for k in t.column("key").to_pylist()] == [r[0] for r in rows]
    groups = [set(t.column("key").to_pylist()) for t in tables]
    assert sum(map(len, groups)) == 60 and len(tables) > 10
    assert max(sum(len(x) for x in t.column("wide")) * 8 for t in tables) <= 200_000 + 12 * 16_000


def test_narrow_tables_of_the_near_dedup_are_few_files(spark):
    texts = [" ".join(f"w{(i // 3) * 7 + k}" for k in range(60)) + f" x{i % 3}" for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        start = common.written()
        kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
        assert kept == list(range(0, 90, 3))
        narrow = 0
        for path in common._written[start:]:
            table = spark.read.parquet(path)
            if not any(kind.startswith("array") for _, kind in table.dtypes):
                narrow += 1
                files = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
                assert len(files) <= common.few_files(spark)
        assert narrow >= 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
