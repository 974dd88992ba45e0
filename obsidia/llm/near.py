"""Operator 6 by similarity: SimHash of five-word shingles, wide radius, decided by whole shingle sets.

The similarity that counts, 0.8, lies some ten bits from a document's own
SimHash, farther than bands of the fingerprint itself can search. Documents
therefore meet in buckets by the least hashes of their shingles; inside, all
fingerprints are compared bit-sliced, and pairs within the radius are decided
on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, in_blocks
from .common import BATCH_BYTES, few_files, materialise
from .components import connected_components
from .simhash import close_pairs, majority, one_of_each, shingle_hashes

SHINGLE = 5
#: Texts are near-duplicates from this Jaccard similarity of their sets of shingles, as a fraction.
SIMILAR = (4, 5)
#: Bits in which fingerprints may differ. At 0.8 two sets have a cosine of 0.89, so 10 bits differ on average, with a deviation of 3; of unrelated texts 32.
RADIUS = 22
#: Tables and least hashes of a key: a pair at 0.8 shares a bucket with probability 1 - (1 - 0.8^5)^20 = 0.9996.
TABLES, ROWS = 20, 5
#: Links that each member of a bucket proposes first.
FIRST_LINKS = 3
SEED = 42
_STEP = 512
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 64, (TABLES * ROWS, 1), dtype=np.uint64)
_FACTOR = _RNG.integers(0, 1 << 63, (TABLES * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The set of a text's shingles, by hash, in order; a text without words has the empty shingle."""
    parts = list(shingle_hashes(words, SHINGLE, SEED)) or [np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)]
    return np.unique(np.concatenate(parts))


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each table, from the least of the hashes under some mixings."""
    least = np.full(TABLES * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _STEP):
        least = np.minimum(least, ((hashes[i : i + _STEP] ^ _FLIP) * _FACTOR).min(axis=1))
    return (least.reshape(TABLES, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _words(text: pa.BinaryScalar) -> list[bytes]:
    return (text.as_py() or b"").lower().split()


def _sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, cid (hash of the lower-cased words), bucket keys and SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, keys, fps = [], [], []
            for t in batch.column(2).cast(pa.binary()):
                words = _words(t)
                hashes = shingle_set(words)
                cids.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                keys.append(bucket_keys(hashes))
                fps.append(majority([hashes]))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            listed = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, TABLES, dtype=np.int32), pa.array(flat))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cids, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed[0], listed, signed[1]], ["doc_id", "text_hash", "cid", "keys", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, cid long, keys array<long>, fp long")


def _shingle_sets(docs: DataFrame, text: str, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """cid and the whole set of shingles of each class named in cids."""
    wanted = cids.distinct().join(classes.select("cid", "text_hash"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(_words(t)).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cid", "shingles"])

    texts = docs.select(F.xxhash64(F.col(text)).alias("_hash"), F.col(text).cast("string").alias("text")).join(wanted, F.col("_hash") == F.col("text_hash"))
    # copies of a wanted text meet before its set is made
    once = texts.groupBy("cid").agg(F.first("text").alias("text"))
    return once.mapInArrow(run, "cid long, shingles array<long>")


def _close(table: pa.Table, group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of a bucket that have different roots and fingerprints within the radius."""
    fps, root = table.column("fp").to_numpy().view(np.uint64), table.column("root").to_numpy()
    for i, j in close_pairs(fps, group, side, radius=RADIUS):
        apart = root[i] != root[j]
        if apart.any():
            yield i[apart], j[apart]


def _nearest(table: pa.Table, group: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each row's close partners the FIRST_LINKS nearest, as (u, v)."""
    cid, fps = table.column("cid").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    best = np.empty((3, 0), np.int64)
    for i, j in _close(table, group, side):
        distance = np.bitwise_count(fps[i] ^ fps[j])
        best = np.concatenate([best, [i, distance, j], [j, distance, i]], axis=1)
        best = best[:, np.lexsort(best[::-1])]
        first = np.flatnonzero(np.diff(best[0], prepend=-1))
        nth = np.arange(best.shape[1]) - np.repeat(first, np.diff(first, append=best.shape[1]))
        best = best[:, nth < FIRST_LINKS]
    if best.shape[1]:
        u, v = cid[best[0]], cid[best[2]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _undecided(table: pa.Table, group: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Members (tab, key, cid) that have a close partner of another root."""
    marked = np.zeros(table.num_rows, dtype=bool)
    for i, j in _close(table, group, side):
        marked[i] = marked[j] = True
    rows = table.select(["tab", "key", "cid"]).filter(pa.array(marked))
    yield from rows.to_batches()


def _similar(table: pa.Table, group: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning forest (u, v) of the rows whose sets are as similar as SIMILAR asks."""
    cid, lists = table.column("cid").to_numpy(), table.column("shingles").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    forest, (part, whole) = Forest(table.num_rows), SIMILAR
    sizes = np.diff(ends)
    for i, j in _close(table, group, side):
        # Jaccard can't exceed the ratio of the sizes
        possible = whole * np.minimum(sizes[i], sizes[j]) >= part * np.maximum(sizes[i], sizes[j])
        for a, b in zip(i[possible].tolist(), j[possible].tolist(), strict=True):
            if forest.root[a] != forest.root[b]:
                n = int(sizes[a] + sizes[b])
                shared = len(np.intersect1d(flat[ends[a] : ends[a + 1]], flat[ends[b] : ends[b + 1]], assume_unique=True))
                if whole * shared >= part * (n - shared):
                    forest.add(np.array([a]), np.array([b]))
    if forest.joined:
        i, j = np.array(forest.joined).T
        yield pa.RecordBatch.from_arrays([pa.array(cid[i]), pa.array(cid[j])], ["u", "v"])


def _confirmed(docs: DataFrame, text: str, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are as similar as SIMILAR asks."""
    few = few_files(docs.sparkSession)
    pairs = materialise(pairs.distinct(), few)
    sets = materialise(_shingle_sets(docs, text, classes, pairs.select(F.col("u").alias("cid")).unionAll(pairs.select(F.col("v").alias("cid")))))
    both = pairs.join(sets.select(F.col("cid").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("cid").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    part, whole = SIMILAR
    return materialise(both.filter(whole * shared >= part * (F.size("a") + F.size("b") - shared)).select("u", "v"), few)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id, text_hash and component (a class that names it) for every row of docs.

    Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more are linked; component_id is the smallest doc_id reachable, null where
    no row of the component has an id. A-Z are lower-cased, words are parted by
    the bytes 9-13 and 32. Texts of the same words are one class, blank and null
    ones too. Classes that share a bucket and whose SimHash differs in at most
    RADIUS bits are candidates; each link is confirmed on whole sets, so no pair
    below 0.8 is linked. Repeated rows get a row each, an empty table an empty one.

    Large groups are joined first by the FIRST_LINKS nearest partners of each
    member of a bucket, so links grow with the members. Pairs that still lie in
    different components are then all compared inside their buckets, to which
    the sets of their members go; only a spanning forest leaves a task. Tables
    of ids and links are written in few_files().
    """
    few = few_files(docs.sparkSession)
    seen = materialise(_sketches(docs, doc_id, text))
    classes = materialise(seen.groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))

    def members(rooted: DataFrame) -> DataFrame:
        return rooted.select("cid", "root", "fp", F.posexplode("keys").alias("tab", "key"))

    first = _confirmed(docs, text, classes, in_blocks(members(classes.withColumn("root", F.col("cid"))), "cid", _nearest, "u long, v long", files=few))
    roots = connected_components(first, few).withColumnRenamed("node", "cid")
    rooted = materialise(classes.select("cid", "keys", "fp").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    left = materialise(in_blocks(members(rooted), "cid", _undecided, "tab int, key long, cid long", files=few).distinct(), few)
    sets = materialise(_shingle_sets(docs, text, classes, left.select("cid")))
    held = left.join(rooted.select("cid", "root", "fp"), "cid").join(sets, "cid")
    links = materialise(first.unionAll(in_blocks(held, "cid", _similar, "u long, v long", buckets=left, most_bytes=BATCH_BYTES, files=few)), few)
    roots = connected_components(links, few).withColumnRenamed("node", "cid")
    placed = classes.select("cid", "least").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    verdicts = materialise(placed.join(least, "root").select("cid", "component_id", F.col("root").alias("component")), few)
    return seen.select("doc_id", "text_hash", "cid").join(verdicts, "cid").select("doc_id", "component_id", "text_hash", "component")


def one_of_each_near_copy(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component of near_copies(), by the rules of one_of_each()."""
    return one_of_each(docs, near_copies(docs, doc_id, text), doc_id, text, few_files(docs.sparkSession))
