"""Operator 10: best-fit packing with exact complements."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .pretokens import pieces, texts

CAPACITY = 4096
#: The id that ends each document.
END = 1


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, part.

    A document is its ids and the end; only longer ones are cut. part numbers
    the task that made the piece. Null text: the end alone.
    """
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = pieces(path).packed
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(texts(batch.column(1))):
                ids = memoryview(packed(text) + last)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            part = pa.array(batch.column(2).take(pa.array(row, pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), part],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int")


def packing_plan(available: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many sequences each fills, that use all pieces.

    Lengths are taken from the largest. A length L leaves the gap g = capacity -
    L; the index of sums of one, two and three available lengths tells which
    combinations fill g exactly. Each is consumed as often as the counts allow,
    largest single first, then pairs, then triples. What finds no complement is
    a residual: residuals go, largest first, into the open sequence with the
    smallest gap that holds them. All work is on counts by length, so it is
    bounded by the capacity and not by the number of pieces.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in available.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length}")
        count[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> int:
        need = np.bincount(pattern, minlength=capacity + 1)
        used = np.flatnonzero(need)
        n = int((count[used] // need[used]).min())
        if n:
            count[used] -= n * need[used]
            plan.append((pattern, n))
        return n

    def pair_of(total: int) -> Iterator[tuple[int, int]]:
        """Pairs of available lengths with this sum, larger half first."""
        b = np.arange(1, total // 2 + 1)
        a = total - b
        for i in np.flatnonzero((count[a] > 0) & (count[b] > 0)).tolist():
            yield int(a[i]), int(b[i])

    rest: dict[int, int] = {}
    for length in range(capacity, 0, -1):
        if not count[length]:
            continue
        gap = capacity - length
        if gap == 0:
            consume((length,))
            continue
        if gap < capacity and count[gap]:
            consume((length, gap))
        if count[length]:
            for a, b in pair_of(gap):
                if count[a] and count[b]:
                    consume((length, a, b))
                if not count[length]:
                    break
        if count[length]:
            have = (count[: gap + 1] > 0).astype(np.float64)
            have[0] = 0
            size = 1 << (2 * gap + 1).bit_length()
            pair_sums = np.rint(np.fft.irfft(np.fft.rfft(have, size) ** 2, size))[: gap + 1] > 0
            for a in np.flatnonzero((have > 0) & pair_sums[::-1])[::-1].tolist():
                if not count[length]:
                    break
                if not count[a]:
                    continue
                for b, c in pair_of(gap - a):
                    if count[a] and count[b] and count[c]:
                        consume((length, a, b, c))
                    if not count[length] or not count[a]:
                        break
        if count[length]:
            rest[length] = int(count[length])
            count[length] = 0

    # best fit by counts: open sequences are kept by gap, those of one gap as lists of (pattern, how many)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length, n in sorted(rest.items(), reverse=True):
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                pattern, m = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
                k = min(n, m)
                if m > k:
                    open_[gap].append((pattern, m - k))
                    gaps[gap] = True
                new = (*pattern, length)
            else:
                each = capacity // length
                gap, k = capacity, n // each
                if k:
                    new = (length,) * each
                    n -= k * (each - 1)
                else:
                    k, new = 1, (length,) * n
                    n = 1
            n -= k
            left = capacity - sum(new)
            if left:
                open_.setdefault(left, []).append((new, k))
                gaps[left] = True
            else:
                plan.append((new, k))
    return plan + [x for kept in open_.values() for x in kept]


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, ranges of its pieces in order: length, first, sequence, offset, sorted by length and first.

    The piece of rank r of a length, in the range that starts at `first`, goes to
    sequence + (r - first) at offset.
    """
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    rows.sort()
    cells = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {name: cells[:, k] for k, name in enumerate(("length", "first", "sequence", "offset"))}


def pack_pieces(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces with length and part.

    Counts by length, at most `capacity` of them, come to the driver, which
    plans patterns and their multiplicities. Pieces of a length are ranked by
    part and, in it, by their own order: counts by part and length are summed
    up for the offsets, so a length that a third of all pieces have is ranked in
    as many tasks as made them. The plan's ranges, a few for each length, are
    sent to all tasks, which look up their pieces' ranks.
    """
    by_part = materialise(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    available = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(packing_plan(available, capacity))
    sent = made.sparkSession.sparkContext.broadcast(slots)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("nth", F.row_number().over(own) - 1).join(bases, ["part", "length"])
    ranked = ranked.select(*made.columns, (F.col("nth") + F.col("base")).cast("long").alias("rank"))

    names = [c for c in made.columns if c != "part"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        starts = plan["length"] * (1 << 48) + plan["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1
            sequence = plan["sequence"][at] + rank - plan["first"][at]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequence), pa.array(plan["offset"][at])], [*names, "sequence_id", "offset"])

    kinds = dict(made.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Texts are encoded once, in the scan; pieces are written without their ids.
    Repeated rows are packed each; null ids are kept; null text is the end id
    alone. An empty table gives an empty one.
    """
    return pack_pieces(materialise(token_pieces(docs, path, capacity, end, doc_id, text)), capacity)
