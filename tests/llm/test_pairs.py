"""Operators 6 and 9 against brute force."""

import random

import numpy as np
import pytest
import xxhash

from obsidia.llm import queries as q
from obsidia.llm.components import connected_components
from obsidia.llm.embeddings import embedding_links, table_shape
from obsidia.llm.simhash import _tables, close_pairs, fingerprint, one_of_each_group, simhash_components


def find_components(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(docs, rows):
    fps = [plain_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = find_components(len(docs), links)
    least = {}
    for (i, _), r in zip(docs, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(repr((i, f"{f:016x}", least.get(r))) for (i, _), f, r in zip(docs, fps, roots, strict=True))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in rows) == want
    return {i for i in least.values()}


def test_simhash_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_simhash(docs, q.op6_simhash(spark, sf_dir).collect())


def test_simhash_of_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_simhash(docs, simhash_components(odd_docs).collect())
    assert simhash_components(no_docs).count() == 0 and one_of_each_group(no_docs).count() == 0


def test_one_of_each_group(spark, odd_docs):
    rows = one_of_each_group(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "6", "7", "8", "9", "10", "None"])
    assert [r.text for r in rows if r.doc_id is None] == ["no id at all here"]


def test_long_texts_are_hashed_whole():
    text = " ".join(random.Random(1).choices("abcdefgh", k=70_000))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(6))
def test_bit_slices_find_all_close_pairs(seed):
    rng = random.Random(seed)
    mask, places = _tables()[seed]
    fps, group, side = [], [], []
    for g in range(40):
        base, sided = rng.getrandbits(64), rng.random() < 0.4
        for _ in range(rng.choice([2, 3, 5, 70, 150])):
            x = base
            for _ in range(rng.choice([0, 1, 1, 2, 3, 9])):
                x ^= 1 << rng.choice(places)
            fps.append(x)
            group.append(g)
            side.append(rng.randrange(2) if sided else 2)
    got = {(int(a), int(b)) for i, j in close_pairs(np.array(fps, np.uint64), np.array(group), np.array(side), places) for a, b in zip(i, j, strict=True)}
    n = len(fps)
    want = {(i, j) for i in range(n) for j in range(i + 1, min(n, i + 150)) if group[i] == group[j] and (side[i] == 2 or side[i] != side[j]) and (fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("radius", [1, 3, 10, 22])
def test_bit_slices_at_any_radius(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(9)]
    fps = np.array([rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 20))) for _ in range(300)], np.uint64)
    group = np.sort(np.array([rng.randrange(6) for _ in range(300)]))
    got = {(int(a), int(b)) for i, j in close_pairs(fps, group, np.full(300, 2), radius=radius) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius} and got


def test_ties_and_rows_without_ids_leave_one_of_each(spark):
    """Rows that differ in case and blanks have one fingerprint: without ids, or with the same one, one of them stays."""
    rows = [(None, "One two three four five"), (None, "one TWO three four  five"), (None, "ONE two three four five"), (5, "Six seven eight"), (5, "six seven EIGHT"), (5, "six seven EIGHT"), (9, "other words here")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int").repartition(3)
    out = one_of_each_group(docs).collect()
    assert sorted((str(r.doc_id), r.text.lower().replace("  ", " "), r.component) for r in out) == [("5", "six seven eight", 1), ("9", "other words here", 1), ("None", "one two three four five", 1)]


def test_buckets_beyond_a_block(spark, monkeypatch):
    from obsidia.llm import blocks, simhash

    monkeypatch.setattr(simhash, "in_blocks", lambda *a: blocks.in_blocks(*a, block=7))
    rng = random.Random(5)
    base = rng.getrandbits(62)
    fps = sorted({base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(150)})
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    at = {x: i for i, x in enumerate(fps)}
    got = find_components(len(fps), [(at[r.u], at[r.v]) for r in links])
    assert got == find_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(700, k) for k in range(701, 900)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = find_components(1000, links)
    nodes = {x for link in links for x in link if link[0] != link[1]}
    assert got == {x: want[x] for x in nodes}


def check_links(rows, got, least_recall=0.9):
    def usable(e):
        return e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)

    unit = {}
    for k, (_, e) in enumerate(rows):
        if usable(e):
            v = np.array(e, dtype=np.float64)
            v /= np.abs(v).max()
            unit[k] = v / np.linalg.norm(v)
    keys = list(unit)
    m = np.stack([unit[k] for k in keys])
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    links = [(keys[i], keys[j]) for i, j in zip(*np.nonzero(near), strict=True)]
    count = np.bincount([a for a, _ in links], minlength=len(rows))
    found = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    total = sum(found[i].n_links for i, _ in rows)
    assert least_recall * count.sum() <= total <= count.sum()
    for (i, _), n in zip(rows, count, strict=True):
        assert found[i].n_links <= n and found[i].kept == (found[i].component_id == i)
    if total == count.sum():
        roots = find_components(len(rows), links)
        least = {}
        for (i, _), r in zip(rows, roots, strict=True):
            least[r] = min(i, least.get(r, i))
        assert all(found[i].component_id == least[r] for (i, _), r in zip(rows, roots, strict=True))
    return total / count.sum() if count.sum() else 1.0


def test_links_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert check_links(rows, q.op9_embedding_links(spark, sf_dir).collect()) >= 0.9


def test_links_near_the_threshold_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        base = rng.standard_normal(32)
        base /= np.linalg.norm(base)
        for cosine in rng.uniform(0.94, 0.999, 2):
            other = rng.standard_normal(32)
            other -= other @ base * base
            other /= np.linalg.norm(other)
            rows.append([float(x) for x in cosine * base + np.sqrt(1 - cosine**2) * other])
        rows.append([float(x) for x in base])
    rows += [rows[0]] * 40 + [[x * 1e200 for x in rows[5]], [x * 1e-200 for x in rows[5]]]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31]
    all_rows = list(enumerate(rows + odd))
    docs = spark.createDataFrame([(i, e, 0, 0) for i, e in all_rows], "vec_id long, embedding array<double>, cid int, k1 int")
    got = embedding_links(docs).collect()
    assert check_links(all_rows, got) >= 0.9
    tail = {r.vec_id: r for r in got}
    assert all(tail[i].n_links == 0 and tail[i].kept for i, _ in all_rows[-len(odd) :])


def test_no_vectors_and_no_ids(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_links(empty).count() == 0
    some = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(repr, (tuple(r) for r in embedding_links(some).collect())))
    assert got == sorted(map(repr, [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True)]))


def test_tables_follow_the_number_of_vectors():
    assert table_shape(100)[0] == 8 and table_shape(50_000)[0] == 9 and table_shape(10**9)[0] == 23
    assert all(table_shape(10**k)[1] < table_shape(10 ** (k + 1))[1] for k in range(5, 9))
