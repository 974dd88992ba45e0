"""The corpus pipeline: rules, line dedup, near dedup, mix, packing, each a table for the next.

Counted as part of the subpackage of training-data operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia.llm.common import materialise, small_batches, sweep, written
from obsidia.llm.lines import drop_site_lines
from obsidia.llm.near import one_of_each_near_copy
from obsidia.llm.mixing import mix_documents
from obsidia.llm.packing import pack_documents
from obsidia.llm.quality import passing_documents
from obsidia.llm.queries import VOCABULARY

#: Of a source's other pages, the share that may hold a line in the line dedup ...
LINE_RATIO = 0.01
#: ... shrunk by so many imagined pages without it, as a source of few pages says little ...
LINE_PRIOR = 400
#: ... and the share of a page's lines that may go; pages of which more would go are copies, for the near dedup.
LINE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own and their host's rules."""
    return passing_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text."""
    done = drop_site_lines(docs, max_ratio=LINE_RATIO, prior_pages=LINE_PRIOR, copies_once=True, max_dropped=LINE_SHARE)
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles: that of the smallest id."""
    with small_batches(spark):
        return one_of_each_near_copy(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row for each piece of a document, with its place."""
    with small_batches(spark):
        return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

#: SQL can't express near-duplicate groups or the packing; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and reread.

    When a stage is written, what it read and wrote in between is removed; the
    tables of the last stage stand until the application's folder goes.
    """
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        sweep(spark, start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
