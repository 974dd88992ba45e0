"""Operators 3, 5, 7 and 8 against DuckDB or plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from obsidia.llm import queries as q
from obsidia.llm.common import count_words, running_totals, words_of
from obsidia.llm.lines import drop_site_lines
from obsidia.llm.mixing import mix_documents, mix_sizes
from obsidia.llm.quality import host_verdicts, passing_documents, quality_rules
from obsidia.llm.sharding import contiguous_shards, shard_documents


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text or "").split(" ") if w]


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = q.queries()[name](spark, sf_dir)
    want = con.sql(q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got.select(columns).collect()) == plain(want.select(*columns).fetchall())


def test_words(odd_docs):
    from pyspark.sql import functions as F

    for r in odd_docs.select("text", words_of(F.col("text")).alias("w"), count_words(F.col("text")).alias("n")).collect():
        assert r.w == words(r.text) and r.n == len(r.w)


def water(sizes, weights, top=3):
    """Targets by bisection on the level."""
    total = sum(sizes)
    lo, hi = 0.0, 3.0 * total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(top * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(top * s, w * hi) for s, w in zip(sizes, weights, strict=True)]


def test_mix(odd_docs, no_docs):
    rows = mix_sizes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sizes = Counter()
    for r in odd_docs.collect():
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, water([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-3
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
    mixed = Counter(r.doc_id for r in mix_documents(odd_docs).collect())
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.repeats
    assert mixed == +want
    assert mix_sizes(no_docs).count() == 0 and mix_documents(no_docs).count() == 0


def test_taken_words_come_near_the_targets(spark, sf_dir):
    rows = mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    taken, longest = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    for r in rows:
        assert abs(taken[r.source] - r.target) <= longest[r.source] / 2 + 1


def test_rows_without_ids_and_repeated_rows_are_taken_one_by_one(spark):
    """Sources of null ids, of one repeated row, and of rows that differ; each comes near its target."""
    rows = [(None, f"some words of text {i}", "a") for i in range(1000)] + [(7, "the same five words here", "b")] * 1000 + [(i, f"text number {i} has seven words in", "c") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mix_sizes(docs).collect()
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    assert len(out) == len(rows) and all(abs(taken[r.source] - r.target) <= 7 for r in out)
    mixed = Counter((r.source, r.text) for r in mix_documents(docs).collect())
    assert {s: sum(n * len(words(t)) for (x, t), n in mixed.items() if x == s) for s in "abc"} == dict(taken)
    again = Counter(map(tuple, mix_sizes(docs.repartition(7)).collect()))
    assert again == Counter(map(tuple, out))


def check_shards(rows, texts, shards=8):
    """Near-equal bytes without gaps; equal texts together unless all copies are over a twentieth of a target."""
    total = sum(r["size"] for r in rows)
    slots, sums, copies, of = defaultdict(list), Counter(), Counter(), defaultdict(set)
    by_id = {(str(i), zlib.crc32((t or "").encode())): t or "" for i, t in texts}
    for r in rows:
        text = by_id[str(r.doc_id), r.text_crc32]
        copies[text] += r["size"]
        of[text].add(r.shard)
    whole = [t for t in copies if copies[t] * shards <= 0.05 * total]
    assert all(len(of[t]) == 1 for t in whole)
    for r in rows:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for k, s in slots.items():
        assert sorted(s) == list(range(len(s)))
        assert abs(sums[k] - total / shards) <= max([r["size"] for r in rows] + [copies[t] for t in whole])
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_shards(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = q.op5_prefix_shards(spark, sf_dir).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    digests = {r.doc_id: hashlib.md5(r.text.encode()).digest() for r in docs.collect()}
    ordered = sorted(rows, key=lambda r: (digests[r.doc_id], r.doc_id))
    assert [(r.shard, r.slot) for r in ordered] == sorted((r.shard, r.slot) for r in rows)
    check_shards(shard_documents(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert shard_documents(no_docs).count() == 0


def test_groups_of_copies_and_one_too_large_for_a_shard(spark):
    texts = ["hot text " * 20] * 700 + [f"pair {i // 2} " * 9 for i in range(600)] + [f"single {i} " * 15 for i in range(700)]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = shard_documents(docs).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    hot = zlib.crc32(texts[0].encode())
    assert len({r.shard for r in rows if r.text_crc32 == hot}) > 2


def test_running_totals_of_one_repeated_key(spark):
    rows = spark.createDataFrame([(None if i % 3 else 5, i % 7) for i in range(3000)], "k int, v long")
    out = running_totals(rows, ["k"], ["v"]).collect()
    assert sorted((r.before_v, r.v) for r in out)[-1][0] <= sum(r.v for r in out)
    ends = sorted((r.before_v + r.v) for r in out)
    starts = sorted(r.before_v for r in out)
    assert starts[1:] == ends[:-1] and starts[0] == 0
    assert contiguous_shards(rows.withColumn("v", rows.v + 1), ["k"], "v", 5).groupBy("shard").count().count() == 5


def repeat_words(w):
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_quality_figures(odd_docs, no_docs):
    by_text = {r.text: r for r in odd_docs.collect()}
    rows = quality_rules(odd_docs.withColumnRenamed("host", "other")).collect()
    assert len(rows) == odd_docs.count()
    want = []
    for text in [r.text for r in odd_docs.collect()]:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        want.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat_words(w), len(w) < 50 or 100 * repeat_words(w) > 50 * len(w)))
    assert sorted(want) == sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert by_text and quality_rules(no_docs).count() == 0 and passing_documents(no_docs).count() == 0


def test_junk_hosts_lose_their_documents_and_others_dont(spark):
    rows = [("junk", True)] * 990 + [("junk", False)] * 10 + [("fine", False)] * 900 + [("fine", True)] * 100 + [("small", True)] * 2 + [(None, False)] * 10
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert {h: r.host_kept for h, r in got.items()} == {"junk": False, "fine": True, "small": True, None: True}
    assert 0.1 < got["small"].rate < 1 and got["small"].n_docs == 2
    same = host_verdicts(spark.createDataFrame([("a", True), ("b", True)], "host string, failed boolean")).collect()
    assert all(r.rate == 1 for r in same)


def test_passing_documents_follow_the_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    assert {r.doc_id for r in passing_documents(docs).collect()} == kept and 0 < len(kept) < docs.count()


def test_site_lines(spark, no_docs):
    rows = [(i, f"HEAD\nbody {i}\n\n HEAD \nmore {i}", "a", 0, 0) for i in range(20)]
    rows += [(100 + i, f"HEAD\nother {i}", "b", 0, 0) for i in range(4)] + [(200, None, "a", 0, 0), (201, "", "a", 0, 0), (202, "HEAD", "a", 0, 0), (203, "HEAD", None, 0, 0), (204, "HEAD\n", "a", 0, 0), (204, "HEAD\n", "a", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host int, n_lines int").repartition(3)
    out = {(r.doc_id, r.source): r for r in drop_site_lines(docs).collect()}
    assert out[3, "a"].text == "body 3\n\nmore 3" and (out[3, "a"].n_lines, out[3, "a"].n_dropped) == (5, 2)
    assert out[101, "b"].text == "other 1" and out[203, None].text == "HEAD"
    assert out[200, "a"].text is None and out[201, "a"].text == "" and out[202, "a"].text == "" and out[204, "a"].text == ""
    assert out[200, "a"].n_lines == 0 and out[201, "a"].n_lines == 1
    assert drop_site_lines(docs).columns.count("n_lines") == 1 and drop_site_lines(docs).count() == len(rows)
    assert drop_site_lines(no_docs).count() == 0


def test_hosts_of_few_pages(spark):
    """A line counts by the host's other pages, so one page loses nothing and two lose what they share."""
    rows = [(1, "shared\nmine", "two"), (2, "shared\nyours", "two"), (3, "alone\nalone", "one"), (4, "x\ny", "three"), (5, "x\nz", "three"), (6, "w", "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in drop_site_lines(docs).collect()} == {1: "mine", 2: "yours", 3: "alone\nalone", 4: "y", 5: "z", 6: "w"}
    assert {r.n_dropped for r in drop_site_lines(docs, prior_pages=20).collect()} == {0}
    # each shared line is a half of its page
    assert {r.doc_id: r.n_dropped for r in drop_site_lines(docs, max_dropped=0.49).collect()} == dict.fromkeys(range(1, 7), 0)


def test_a_junk_host_goes_with_its_sound_documents(spark):
    """One source fails mostly, by symbols and short texts; the sound documents of it go, those of others stay."""
    sound = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{sound} {i}" if i % 10 == 0 else ("# $ % " * 60 + str(i) if i % 2 else "short"), "junk") for i in range(200)]
    rows += [(1000 + i, "short" if i % 8 == 0 else f"{sound} {i}", f"host{i % 10}") for i in range(400)] + [(2000, f"{sound} x", None), (2001, "# " * 70, "host1"), (2002, sound.replace(" ", "# "), "host2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = {r.doc_id: r for r in quality_rules(docs).collect()}
    want = {i for i, t, s in rows if s != "junk" and t.startswith("word") and "#" not in t}
    assert {i for i, r in out.items() if r.kept} == want and 2000 in want
    assert not out[10].base_failed and not out[10].host_kept and out[1001].host_kept
    assert not out[2002].base_failed and not out[2002].kept and out[2002].host_kept
    assert {r.doc_id for r in passing_documents(docs).collect()} == want
