"""Operator 9: near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, in_blocks, runs
from .common import materialise
from .components import connected_components

THRESHOLD = 0.95
#: Vectors that the rotations are learned on, at most; taken by hash. All are indexed.
SAMPLE = 16384
#: Of the pairs that just reach the threshold, the share that the tables are to find.
RECALL = 0.97
#: Tables at most: where the recall would ask for more, keys are shortened until it doesn't.
MAX_TABLES = 64
#: Deviations of the number of differing bits, above its mean at the threshold, at which a pair of codes is still retrieved.
SLACK = 5.0
SEED = 7
_ROUNDS = 40


def learn_rotations(sample: np.ndarray, count: int, seed: int = SEED, rounds: int = _ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean of a sample and, side by side, `count` rotations for balanced binary codes.

    Iterative quantisation: from a random rotation of the principal axes,
    alternate codes B = sign(VR) and the R nearest to them (orthogonal
    Procrustes by SVD of B'V). Different starts give codes whose errors differ.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    d = sample.shape[1]
    out = []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ v)
            r = (left @ right).T
        out.append(axes @ r)
    return mean, np.hstack(out)


def table_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's key and number of tables for n vectors spread around their mean.

    A bit of two vectors at angle a differs with probability a / pi. Keys get
    log2(n) - 7 bits (8 at least), which keeps buckets of unrelated vectors near
    128 rows at every n; the number of tables follows from the recall that is
    asked for at the threshold itself.
    """
    bits = min(48, max(8, round(math.log2(max(2, n))) - 7))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def differing_after_centring(unit: np.ndarray, mean: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """For each vector of a sample, the probability that a code bit differs from that of a vector at the threshold.

    Of two unit vectors at the threshold, each with cosine c to the mean (as
    dot product), the centred ones have product threshold - 2c + |mean|² and
    squared lengths 1 - 2c + |mean|².
    """
    shift = mean @ mean - 2 * (unit @ mean)
    return np.arccos(np.clip((threshold + shift) / np.maximum(1 + shift, 1e-12), -1, 1)) / np.pi


def shape_after_centring(n: int, differs: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """Bits of a key, number of tables and radius of whole codes for n vectors.

    The expected recall over the sample is asked for, by buckets. If that takes
    more than MAX_TABLES tables, keys get shorter, so buckets grow and more pairs
    are compared, but none is given up. The radius holds the differing bits of
    pairs at the threshold, SLACK deviations above the mean, for the sample's
    vectors (all but one in a thousand of them).
    """
    bits, least = table_shape(n, threshold, recall)
    while True:
        same = (1 - differs) ** bits
        tables = least
        while (1 - (1 - same) ** tables).mean() < recall and tables <= MAX_TABLES:
            tables += 1
        if tables <= MAX_TABLES or bits == 1:
            break
        bits -= 1
    tables = min(tables, MAX_TABLES)
    p, size = float(np.quantile(differs, 0.999)), bits * tables
    return bits, tables, min(size, math.ceil(size * p + SLACK * math.sqrt(size * p * (1 - p))))


def _unit_rows(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of unit length, in double precision, filled with zeros up to the width."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    # a power of two brings each row's largest value near 1, so squares neither vanish nor overflow
    _, exponent = np.frexp(np.abs(out).max(axis=1, initial=0.0))
    out = np.ldexp(out, -exponent[:, None])
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors are one class, found by 128 bits of hash, and only classes are
    compared. Codes come from rotations learned on at most `sample` classes.
    Each class stands in every table under a substring of its code; buckets
    retrieve, block by block, the pairs whose whole codes lie within a radius.
    For this only codes move. Then the members of a bucket that have a partner
    that no earlier table brought get their vectors, and the cosine of the
    original vectors is taken in double precision; links reach the threshold
    exactly. A pair counts in the first table whose bucket it shares, so links
    are counted once without being listed; of the links themselves a spanning
    forest is kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are components of their own. Shorter vectors count as
    filled with zeros. component_id is the smallest vec_id reachable; a null
    vec_id is nobody's smallest. Repeated rows get a row each and link. An empty
    table gives an empty one.
    """
    e = F.col(embedding)
    valid = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        valid.alias("valid"),
        F.when(valid, F.xxhash64(e)).alias("k1"),
        F.when(valid, F.xxhash64(F.lit("second"), e)).alias("k2"),
        F.when(valid, e).alias("vector"),
    )
    alike = rows.filter("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = materialise(alike.withColumn("cid", F.monotonically_increasing_id()))
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if n:
        taken = classes.orderBy("k1", "k2").limit(sample).select("vector").toArrow().column(0)
        unit = _unit_rows(taken, width)
        bits, tables, radius = shape_after_centring(n, differing_after_centring(unit, unit.mean(axis=0), threshold), threshold, recall)
        mean, rotations = learn_rotations(unit, math.ceil(bits * tables / width))
        codes = materialise(_codes(classes, width, mean, rotations, bits * tables))
        places = codes.select("cid", "code", F.explode(_keys(F.col("code"), bits, tables)).alias("at")).select("cid", "code", "at.tab", "at.key")
        wanted = materialise(in_blocks(places, "cid", _bucket_members(bits, radius), "tab int, key long, cid long").distinct())
        held = wanted.join(codes, "cid").join(classes.select("cid", "copies", "vector"), "cid")
        found = materialise(in_blocks(held, "cid", _bucket_links(width, threshold, bits, radius), "u long, v long, w long", buckets=wanted))
    else:
        found = materialise(vectors.sparkSession.createDataFrame([], "u long, v long, w long"))
    counts = found.filter("w is not null").groupBy(F.col("u").alias("cid")).agg(F.sum("w").alias("others"))
    roots = connected_components(found.filter("w is null")).withColumnRenamed("node", "cid")
    placed = classes.select("k1", "k2", "cid", "copies", "least").join(counts, "cid", "left").join(roots, "cid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    done = materialise(placed.join(least, "root").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "k1", "k2").join(done, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _codes(classes: DataFrame, width: int, mean: np.ndarray, rotations: np.ndarray, size: int) -> DataFrame:
    """cid and its code, `size` bits packed from the lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = (_unit_rows(batch.column(1), width) - mean) @ rotations[:, :size] >= 0
                packed = np.packbits(bits, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], ["cid", "code"])

    return classes.select("cid", "vector").mapInArrow(run, "cid long, code binary")


def _keys(code: Column, bits: int, tables: int) -> Column:
    """array<struct<tab, key>>: the key of table t is bits [t * bits, (t + 1) * bits) of the code."""
    out = []
    for t in range(tables):
        first, last = t * bits // 8, ((t + 1) * bits - 1) // 8
        # at most 48 bits and 7 beside them, so a long holds the bytes
        hex_bytes = [F.substring(F.hex(code), 2 * b + 1, 2) for b in range(last, first - 1, -1)]
        value = F.conv(F.concat(*hex_bytes), 16, 10).cast("long")
        out.append(F.struct(F.lit(t).alias("tab"), F.shiftright(value, t * bits % 8).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("key")))
    return F.array(*out)


class _Bucket:
    """Codes of a table of groups, and which pairs of a group are to be taken."""

    def __init__(self, table: pa.Table, bits: int, radius: int):
        raw = table.column("code").combine_chunks()
        packed = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(table.num_rows, -1)
        self.code = np.unpackbits(packed, axis=1, bitorder="little")
        self.signs = self.code.astype(np.float32) * 2 - 1
        self.tab, self.bits, self.radius = table.column("tab").to_numpy(), bits, radius

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For rows a and b, where codes differ in at most the radius; places that pad a code never differ."""
        size = self.signs.shape[1]
        return self.signs[a] @ self.signs[b].T >= size - 2 * self.radius

    def first(self, i: np.ndarray, j: np.ndarray, tab: int) -> np.ndarray:
        """Is this table the first whose bucket the pairs share?"""
        out = np.ones(len(i), dtype=bool)
        for t in range(tab):
            at = slice(t * self.bits, (t + 1) * self.bits)
            out &= (self.code[i, at] != self.code[j, at]).any(axis=1)
        return out


def _sides(lo: int, hi: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a group to be compared with which others, and whether these are the same."""
    if side[lo] == 2:
        return np.arange(lo, hi), np.arange(lo, hi), True
    return lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1), False


def _bucket_members(bits: int, radius: int):
    """Members (tab, key, cid) with a close code in their bucket that shares no bucket of an earlier table."""

    def compare(table: pa.Table, group: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, marked = _Bucket(table, bits, radius), np.zeros(table.num_rows, dtype=bool)
        for lo, hi in runs(group):
            a, b, same = _sides(lo, hi, side)
            if len(a) and len(b):
                near = bucket.close(a, b)
                i, j = np.nonzero(np.triu(near, 1) if same else near)
                i, j = a[i], b[j]
                fresh = bucket.first(i, j, bucket.tab[lo])
                marked[i[fresh]] = marked[j[fresh]] = True
        yield from table.select(["tab", "key", "cid"]).filter(pa.array(marked)).to_batches()

    return compare


def _bucket_links(width: int, threshold: float, bits: int, radius: int):
    """Links of the members: (cid, null, number of other vectors) and a spanning forest (u, v, null)."""

    def compare(table: pa.Table, group: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit, bucket = _unit_rows(table.column("vector"), width), _Bucket(table, bits, radius)
        cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        forest, linked = Forest(table.num_rows), np.zeros(table.num_rows, dtype=np.int64)
        for lo, hi in runs(group):
            a, b, same = _sides(lo, hi, side)
            if not len(a) or not len(b):
                continue
            near = (unit[a] @ unit[b].T >= threshold) & bucket.close(a, b)
            i, j = np.nonzero(np.triu(near, 1) if same else near)
            i, j = a[i], b[j]
            if len(i):
                forest.add(i, j)
                fresh = bucket.first(i, j, bucket.tab[lo])
                i, j = i[fresh], j[fresh]
                linked += np.bincount(i, copies[j], len(linked)).astype(np.int64) + np.bincount(j, copies[i], len(linked)).astype(np.int64)
        some = np.flatnonzero(linked)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(cid[some]), none, pa.array(linked[some])], ["u", "v", "w"])
        if forest.joined:
            i, j = np.array(forest.joined).T
            yield pa.RecordBatch.from_arrays([pa.array(cid[i]), pa.array(cid[j]), pa.nulls(len(i), pa.int64())], ["u", "v", "w"])

    return compare
