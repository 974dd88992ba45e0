"""Comparison of all members of each bucket in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, partitions

#: Members of a bucket that one task holds from either side.
BLOCK = 256


def in_blocks(rows: DataFrame, member: str, compare: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK, buckets: DataFrame | None = None, most_bytes: int | None = None, files: int | None = None) -> DataFrame:
    """Run compare over every pair of blocks of each bucket.

    rows: members of buckets, with the bucket's place in columns (tab, key) and
    a long column `member`, unique in a bucket. A bucket of more than `block`
    members is dealt into blocks by hash, and each pair of blocks is a group of
    its own, so that no task holds more than two blocks of a bucket and every
    pair of members meets exactly once.

    Rows are shuffled once. Before that only the buckets are counted, from
    `buckets` (the same places without what is wide) if given; those of more
    than a block, at most rows / block, are joined to the rows.

    compare(table, group, side) gets whole groups, sorted by tab, with the
    number of each row's group and its side: rows of side 0 and 1 in a group
    are to be compared across sides, rows of side 2 with each other. It gets 16
    blocks of rows at once, or fewer where these take more than most_bytes.
    files: of the table of large buckets, see materialise().
    """
    n = partitions(rows.sparkSession)
    large = (rows if buckets is None else buckets).groupBy("tab", "key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    large = broadcast_if_small(large, files=files)
    if large is None:
        held = rows.select("*", F.lit(0).alias("_lo"), F.lit(0).alias("_hi"), F.lit(2).alias("_side"))
    else:
        held = rows.join(large, ["tab", "key"], "left")
        blocks = F.ceil(F.coalesce("_n", F.lit(1)) / block).cast("int")
        held = held.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(member), "_blocks").cast("int"))
        held = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        held = held.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
        held = held.withColumn("_side", F.when(F.col("_lo") == F.col("_hi"), 2).when(F.col("_own") == F.col("_lo"), 0).otherwise(1))
        held = held.drop("_n", "_blocks", "_own", "_other")
    keys = ["tab", "key", "_lo", "_hi"]
    dealt = held.repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, keys, 16 * block, most_bytes):
            group = np.cumsum(_starts(table, keys)) - 1
            several = np.bincount(group)[group] > 1
            if not several.all():
                table = table.filter(pa.array(several)).combine_chunks()
                if not table.num_rows:
                    continue
                group = np.cumsum(_starts(table, keys)) - 1
            yield from compare(table, group, table.column("_side").to_numpy())

    return dealt.mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from the row's before."""
    out = np.ones(table.num_rows, dtype=bool)
    if table.num_rows:
        out[1:] = False
        for k in keys:
            x = table.column(k).to_numpy()
            out[1:] |= x[1:] != x[:-1]
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int, most_bytes: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, of `least` rows or most_bytes or a little more."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= least or most_bytes is not None and sum(b.nbytes for b in kept) >= most_bytes:
            table = pa.Table.from_batches(kept).combine_chunks()
            cut = int(np.flatnonzero(_starts(table, keys))[-1])
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut)
            kept, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()


def runs(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last-plus-one row of each group."""
    cuts = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1)) if len(group) else np.empty(0, int)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


class Forest:
    """Union-find over 0..n-1 that remembers which unions joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.joined: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[k] with b[k]; only links between trees cost Python time."""
        while True:
            x, y = self.root[a], self.root[b]
            differ = np.flatnonzero(x != y)
            if not len(differ):
                return
            lo, hi = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            # hook each larger root to one smaller root that it is linked with
            _, first = np.unique(hi, return_index=True)
            self.root[hi[first]] = lo[first]
            at = differ[first]
            self.joined += zip(a[at].tolist(), b[at].tolist(), strict=True)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
