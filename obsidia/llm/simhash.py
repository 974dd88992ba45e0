"""Operator 6: SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, in_blocks
from .common import broadcast_if_small, materialise
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
#: Of 4 bands of 16 bits, two that differ in at most 2 places share 2 whole bands.
BAND = 16
#: Shingles whose bits are counted at once.
_STEP = 1 << 15
#: Words of 64 pairs that are compared at once.
_WORDS = 1 << 15


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text's words, repeats included, in arrays of bounded size.

    Fewer words than a shingle are one shingle; no words have none.
    """
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _STEP):
        k = min(_STEP, n - i)
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[i : i + k].tolist(), ends[i + width - 1 : i + width - 1 + k].tolist(), strict=True)), np.uint64, k)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of hashes: a bit is set if it is set in over half of them. No hashes give 0."""
    set_bits, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in parts:
        n += len(hashes)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the XXH64 of all shingles of a UTF-8 text, repeats included.

    A-Z are lower-cased; words are parted by the bytes 9-13 and 32.
    """
    return majority(shingle_hashes(text.lower().split(), width, seed))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed long, of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, fp long")


def _tables() -> list[tuple[int, list[int]]]:
    """For each table, the bits of its key as a mask, and the places of the other bits."""
    bands = range(BITS // BAND)
    out = []
    for pair in combinations(bands, 2):
        mask = sum(((1 << BAND) - 1) << (b * BAND) for b in pair)
        out.append((mask, [i for i in range(BITS) if not mask >> i & 1]))
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def close_pairs(fps: np.ndarray, group: np.ndarray, side: np.ndarray, places: Iterable[int] = range(BITS), radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i, j) of rows of one group whose fingerprints differ in at most radius of places.

    group: numbers of the rows' groups, in order. Bits are held vertically: one
    plane for each place, a bit for each row. At a lag d, row i meets row i + d,
    so 64 pairs of a lag are one word, and a plane's differences are the plane
    and itself shifted by d. Two planes at a time are added to carry-save
    counters; these start so far below their end that they overflow where the
    radius is exceeded, and `over` holds those pairs. Words whose pairs are all
    over are abandoned after each few planes.
    """
    n = len(fps)
    if n < 2:
        return
    ids = group.astype(np.int64) - int(group[0])
    sizes = np.bincount(ids)[ids]
    words = -(-n // 64)

    def pack(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((words + 2) * 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    planes = [pack((fps >> np.uint64(p) & np.uint64(1)).astype(np.uint8)) for p in places]
    at, lag, live, waiting = [], [], [], 0
    rows = np.arange(n)
    for d in range(1, int(sizes.max())):
        # only groups longer than the lag have pairs left at it
        rows = rows[sizes[rows] > d]
        here = rows[rows < n - d]
        here = here[ids[here] == ids[here + d]]
        here = here[(side[here] == 2) | (side[here] != side[here + d])]
        if len(here):
            bits = np.zeros(words * 64, dtype=np.uint8)
            bits[here] = 1
            mask = np.packbits(bits, bitorder="little").view(np.uint64)
            some = np.flatnonzero(mask)
            at.append(some)
            lag.append(np.full(len(some), d))
            live.append(mask[some])
            waiting += len(some)
            if waiting >= _WORDS:
                yield from _survivors(planes, np.concatenate(at), np.concatenate(lag), np.concatenate(live), radius)
                at, lag, live, waiting = [], [], [], 0
    if waiting:
        yield from _survivors(planes, np.concatenate(at), np.concatenate(lag), np.concatenate(live), radius)


def _survivors(planes: list[np.ndarray], at: np.ndarray, lag: np.ndarray, live: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of some words (64 rows from 64 * at, each with the row a lag behind) that stay within the radius."""
    full, last = np.uint64(0xFFFFFFFFFFFFFFFF), len(planes[0]) - 1
    over = ~live
    start = (1 << radius.bit_length()) - 1 - radius
    counters = [np.full(len(at), full if start >> k & 1 else 0, np.uint64) for k in range(radius.bit_length())]
    far, right = np.minimum(at + lag // 64, last), (lag % 64).astype(np.uint64)
    next_, left = np.minimum(far + 1, last), np.uint64(63) - right

    def differences(plane: np.ndarray) -> np.ndarray:
        return plane[at] ^ (plane[far] >> right | plane[next_] << np.uint64(1) << left)

    for k in range(0, len(planes), 2):
        a = differences(planes[k])
        b = differences(planes[k + 1]) if k + 1 < len(planes) else np.zeros_like(a)
        ones = counters[0]
        half = ones ^ a
        carry = (ones & a) | (half & b)
        counters[0] = half ^ b
        for c in range(1, len(counters)):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if k % 8 == 6:
            alive = over != full
            if not alive.all():
                at, lag, over, far, next_, right, left = at[alive], lag[alive], over[alive], far[alive], next_[alive], right[alive], left[alive]
                counters = [c[alive] for c in counters]
                if not len(at):
                    return
    word, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    i = at[word] * 64 + bit
    if len(i):
        yield i, i + lag[word]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of fingerprints within the radius.

    distinct: fp, each once. Every fingerprint goes to a table for each choice
    of two of its four bands; fingerprints within 2 bits share a key in at least
    one. Buckets are compared by close_pairs() over the 32 bits outside the key.
    Of a group's links, those of a spanning forest are returned, so a dense
    group of m gives at most m - 1, and no connection is lost.
    """
    if not 1 <= radius <= 2:
        raise ValueError("four bands find all pairs up to 2 bits")
    tables = _tables()
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for t, (mask, _) in enumerate(tables)])).alias("at"))
    keyed = keyed.select("at.tab", "at.key", "fp")

    def compare(table: pa.Table, group: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, tab = table.column("fp").to_numpy(), table.column("tab").to_numpy()
        for t in np.unique(tab):
            lo, hi = np.searchsorted(tab, [t, t + 1])
            own, forest = fps[lo:hi], Forest(hi - lo)
            for i, j in close_pairs(own.view(np.uint64), group[lo:hi], side[lo:hi], tables[t][1], radius):
                forest.add(i, j)
            if forest.joined:
                i, j = np.array(forest.joined).T
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], ["u", "v"])

    return in_blocks(keyed, "fp", compare, "u long, v long")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id, root and text_hash for every row of docs.

    Fingerprints within the radius are linked; component_id is the smallest
    doc_id reachable, root a fingerprint that names the component. Copies share a fingerprint, so only distinct fingerprints
    are compared and joined; each carries its smallest doc_id. Ids and
    fingerprints, 16 bytes a document, are written once; texts stay in the
    scan. Null and blank texts have fingerprint 0 and link like others. A null
    doc_id counts for nobody's smallest; component_id is null where no row of
    the component has an id. Repeated rows get a row each. An empty table gives
    an empty one.
    """
    fps = materialise(fingerprints(docs, doc_id, text, width))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = materialise(fingerprint_links(distinct.select("fp"), radius))
    roots = connected_components(links)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(placed.join(least, "root").select("fp", "component_id", "root"))
    return fps.join(classes, "fp").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "root", "text_hash")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each near-duplicate component: that of the smallest id; see one_of_each()."""
    found = simhash_components(docs, doc_id, text, width, radius).select("doc_id", "text_hash", F.col("root").alias("component"))
    return one_of_each(docs, found, doc_id, text)


def one_of_each(docs: DataFrame, members: DataFrame, doc_id: str, text: str, files: int | None = None) -> DataFrame:
    """docs with one document of each component that members (doc_id, text_hash, component) tell.

    It is that of the smallest id; ids that tie, and rows without an id, which
    come last, go by the hash of the text. Rows are told apart by id and 64 bits
    of hash of the text; rows that agree in both are one document.

    Who goes is decided on ids and hashes. These are broadcast to the scan of
    the texts if they are counted to be few (BROADCAST_ROWS), so that no text is
    shuffled; else Spark joins them by shuffle. Only texts of repeated rows meet.
    files: of the tables of ids and hashes, see materialise().
    """
    rows = members.groupBy("doc_id", "text_hash", "component").agg(F.count(F.lit(1)).alias("rows"))
    rows = materialise(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")), files)
    # a table, so that Spark may broadcast it or split the rows of a large component
    first = materialise(rows.groupBy("component").agg(F.min("place").alias("first")), files)
    judged = rows.join(first, "component").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (F.col("place") == F.col("first")).alias("_stays"), (F.col("rows") > 1).alias("_several"))
    decided = broadcast_if_small(judged.filter(~F.col("_stays") | F.col("_several")), files=files)
    if decided is None:
        return docs
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    left = hashed.join(decided, same, "left_anti").select(*docs.columns)
    again = broadcast_if_small(decided.filter("_stays"), files=files)
    if again is None:
        return left
    several = hashed.join(again, same, "left_semi").groupBy(doc_id, "_text_hash").agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return left.unionAll(several.select("_row.*"))
