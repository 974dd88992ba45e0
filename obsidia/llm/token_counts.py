"""Operator 1: token counts by distinct pre-token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .pretokens import LONGEST, pieces, texts

#: The commonest pre-tokens, of at most 64 characters each, that every task gets: 8 MB of text at most.
HEAD = 1 << 17
#: Distinct pre-tokens that a task holds before it hands on their counts.
_ROOM = 1 << 19


def pretoken_counts(docs: DataFrame, text: str, path: str) -> DataFrame:
    """pretoken, n, pieces: every distinct pre-token of the table, its count and that of its pieces.

    Tasks add up counts first, in dictionaries of bounded size. Pre-tokens of
    over 64 characters are left out; token_counts() counts them where they stand.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = pieces(path).split, Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(split(text))
                if len(seen) > _ROOM:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pieces(path).ids
        for batch in batches:
            n = pa.array([len(ids(p.as_py())) for p in batch.column(0)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["pretoken", "n", "pieces"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "pretoken string, n long")
    distinct = counted.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(measure, "pretoken string, n long, pieces int")


def _counted(seen: Counter) -> pa.RecordBatch:
    short = [(p, n) for p, n in seen.items() if len(p) <= LONGEST]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["pretoken", "n"])


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, as the tokenizer at path counts them.

    Pieces are counted once for each distinct pre-token of the table; documents
    hold frequencies of pre-tokens, and a document's count is the sum over the
    join of both. No ids are made of any text. The join is dealt by frequency:
    the `head` commonest pre-tokens (a bounded table) are joined in the tasks
    that read the texts; what is rarer, a few per cent of all, is joined by a
    shuffle on the pre-token, in which no key is frequent, and summed by row.

    Null text: empty, 0 bytes and tokens. Rows are told apart by their place in
    the input, so repeated rows and null ids get a row each. An empty table
    gives an empty one. docs is read twice: it should be a table.
    """
    found = materialise(pretoken_counts(docs, text, path))
    common = found.orderBy(F.desc("n"), "pretoken").limit(head).select("pretoken", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(common.column(0).to_pylist(), common.column(1).to_pylist(), strict=True)))
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids, pieces_of = pieces(path).split, pieces(path).ids, known.value
        for batch in batches:
            sizes, sums, rare, counts = [], [], [], []
            for text in texts(batch.column(2)):
                total, rest, n = 0, [], []
                for p, k in Counter(split(text)).items():
                    if (one := pieces_of.get(p)) is not None:
                        total += one * k
                    elif len(p) > LONGEST:
                        total += len(ids(p)) * k
                    else:
                        rest.append(p)
                        n.append(k)
                sizes.append(len(text.encode()))
                sums.append(total)
                rare.append(rest)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
                ["doc_id", "row", "n_bytes", "known", "rare", "counts"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    parts = materialise(rows.mapInArrow(join, f"doc_id {kind}, row long, n_bytes long, known long, rare array<string>, counts array<int>"))
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "counts")).alias("at")).select("row", F.col("at.rare").alias("pretoken"), F.col("at.counts").alias("k"))
    rest = rare.join(found.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("rest"))
    done = parts.select("doc_id", "row", "n_bytes", "known").join(rest, "row", "left")
    return done.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).cast("long").alias("n_tokens"))
