"""Aliases, verification, sheets, propagation, workflow, audit, queue and streams."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from obsidia.functions.normalize import norm, norm_soft, plain_norm, plain_soft
from obsidia.operators import cells, jobs, workflow
from obsidia.operators.detect import detect, findings
from obsidia.operators.propagate import occurrences, propagate
from obsidia.operators.pseudonyms import batch_aliases, persistent_aliases
from obsidia.operators.score import recall
from obsidia.operators.treat import apply_findings, stats
from obsidia.operators.verify import leaks, scan_leaks, verification
from obsidia.plans import queries as q
from obsidia.plans.tables import numbered
from obsidia.streaming.queue import item_states, step


@pytest.fixture(scope="module")
def con(sf_dir):
    import os

    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_queries_match_their_sql(spark, sf_dir, con, name):
    got, want = q.QUERIES[name](spark, sf_dir), con.sql(q.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_normal_forms(spark):
    texts = ["Ñandú  ÁÉÍ @x-1", "ﬁ ß İ ", "", "12.345.678-5", "ç̧ à́ ệ Å K"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", norm(F.col("t")).alias("h"), norm_soft(F.col("t")).alias("s")).collect():
        assert (r.h, r.s) == (plain_norm(r.t), plain_soft(r.t))


def test_numbers_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(400)) for _ in range(900)]
    got = numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v")]).collect()
    for g in "ab":
        own = sorted((r.number, r.v) for r in got if r.g == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for x, v in rows if x == g)


def test_aliases(spark):
    found = spark.createDataFrame([(1, "NOMBRE", "Ana Pérez", "accepted"), (1, "NOMBRE", "ana  perez", "edited"), (1, "NOMBRE", "Zoe", "rejected"), (1, "RUT", "1-9", "accepted"), (2, "NOMBRE", "Zoe", "accepted")], "scope_id int, entity_code string, text string, status string")
    got = {(r.scope_id, r.entity_code, r.value): r.alias for r in batch_aliases(found, ["scope_id"]).collect()}
    assert got == {(1, "NOMBRE", "anaperez"): "Persona-01", (1, "RUT", "19"): "RUT-01", (2, "NOMBRE", "zoe"): "Persona-01"}
    none = spark.createDataFrame([], "scope_id int, entity_code string, value_hash string, alias string")
    first = persistent_aliases(found, none)
    more = found.unionByName(spark.createDataFrame([(1, "NOMBRE", "Abel", "accepted")], found.schema))
    second = persistent_aliases(more, first)
    assert {r.alias for r in second.filter("scope_id = 1 and entity_code = 'NOMBRE'").collect()} == {"Persona-01", "Persona-02"}
    assert set(map(tuple, first.collect())) <= set(map(tuple, second.collect()))


def test_verification(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    sought = spark.createDataFrame([(1, "12.345.678-5"), (1, "Ana"), (2, "192.0.2.6"), (2, "Juan Pérez"), (3, "abcdef")], "doc_id int, value string")
    pieces = spark.createDataFrame([(1, "id 123456785 ok"), (1, "Ana"), (2, "fecha 19/2026"), (2, "JUAN\tperez!"), (3, "abc"), (3, "def")], "doc_id int, text string")
    assert sorted(map(tuple, leaks(sought, pieces, ["doc_id"]).collect())) == [(1, "12.345.678-5"), (2, "Juan Pérez")]
    meta = spark.createDataFrame([(3, "dc:creator", "x"), (1, "dc:title", "")], "doc_id int, name string, value string")
    got = {r.doc_id: (r.ok, r.n_sought, r.leaked, r.metadata_ok) for r in verification(docs, sought, pieces, ["doc_id"], meta).collect()}
    assert got == {1: (False, 2, ["12.345.678-5"], True), 2: (False, 2, ["Juan Pérez"], True), 3: (False, 1, [], False)}
    assert pieces.select(scan_leaks(F.col("text"), ["12.345.678-5"]).alias("x")).filter("size(x) > 0").count() == 1


def test_detect_treat_and_verify_leave_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("txt").alias("location"), F.lit(0).alias("ord"), "text")
    found = findings(detect(docs, ["EMAIL", "IP", "TARJETA"]), ["doc_id", "location"])
    found = found.unionByName(propagate(docs, found).withColumns({"source": F.lit("auto"), "status": F.lit("accepted"), "finding_id": F.lit("")}))
    done = apply_findings(docs, found, "anonymize")
    assert leaks(found.select("doc_id", F.col("text").alias("value")), done, ["doc_id"]).count() == 0
    assert done.count() == docs.count() and stats(found, ["doc_id"]).agg(F.sum("total")).first()[0] == found.count()


def test_sheet_columns(spark):
    rows = [("S!A1", "Planilla de reclamos de la comuna, con un título larguísimo y folio"), ("S!A2", "Folio"), ("S!A3", " 123 "), ("S!A4", "12"), ("S!A5", "N/A"), ("S!B2", "Reclamante"), ("S!B3", "Li"), ("S!B4", "Ana Soto"), ("S!C3", "x"), ("txt", "folio")]
    sheet = spark.createDataFrame([(1, a, t) for a, t in rows], "doc_id int, location string, text string")
    got = {(r.location, r.start, r.end, r.entity_code, r.text) for r in cells.column_findings(sheet, ["FOLIO", "NOMBRE"]).collect()}
    assert got == {("S!A3", 1, 4, "FOLIO", "123"), ("S!B3", 0, 2, "NOMBRE", "Li"), ("S!B4", 0, 8, "NOMBRE", "Ana Soto")}
    found = spark.createDataFrame([(1, "S!B4", 0, 3, "NOMBRE", "Ana", 0.7), (1, "S!B3", 0, 2, "NOMBRE", "Li", 0.7), (1, "S!C3", 0, 1, "IP", "x", 0.9)], "doc_id int, location string, start int, end int, entity_code string, text string, score double")
    ruled = {(r.location, r.text, r.score) for r in cells.with_columns_rule(found, sheet, ["FOLIO", "NOMBRE"]).collect()}
    assert ruled == {("S!A3", "123", 0.85), ("S!B4", "Ana Soto", 0.85), ("S!B3", "Li", 0.7), ("S!C3", "x", 0.9)}


def test_propagation(spark):
    assert occurrences("Abcdef xabcdef abcdef", [("abcdef", "NOMBRE")], [(0, 6)]) == [(15, 21, "NOMBRE")]
    assert occurrences("xabcdefx aaaaaaa", [("abcdef", "FOLIO"), ("aaaaaa", "FOLIO")], []) == [(1, 7, "FOLIO"), (9, 15, "FOLIO")]
    assert occurrences("veronica@x.cl veronica", [("veronica", "NOMBRE")], []) == [(14, 22, "NOMBRE")]
    blocks = spark.createDataFrame([(1, 0, "a", "folio 2020-77"), (1, 1, "b", "ver 2020-77 y 2020-77x"), (2, 0, "a", "2020-77"), (1, 2, "c", None)], "doc_id long, ord int, location string, text string")
    found = spark.createDataFrame([(1, "a", 6, 13, "FOLIO", "2020-77")], "doc_id long, location string, start int, end int, entity_code string, text string")
    assert sorted((r.doc_id, r.location, r.start, r.end) for r in propagate(blocks, found).collect()) == [(1, "b", 4, 11), (1, "b", 14, 21)]


def test_recall(spark):
    want = spark.createDataFrame([(1, 0, "RUT", "1.111-1"), (1, 1, "RUT", "2222"), (1, 0, "FIRMA", "x")], "doc_id int, ord int, entity_code string, text string")
    got = spark.createDataFrame([(1, 0, "RUT", "RUT 11111"), (1, 1, "RUT", "9"), (1, 0, "FIRMA", "(y)")], want.schema)
    assert sorted(map(tuple, recall(want, got).collect())) == [(1, "FIRMA", 1, 0, 0), (1, "RUT", 1, 1, 1)]


def test_broken_audit_chains_are_found(spark):
    events = spark.createDataFrame([(c, i, "t", "u", None if i % 2 else "ip", "e", f"{{{i}}}") for c in (1, 2, 3) for i in range(1, 40)], "chain int, id long, ts string, username string, ip string, event string, details string")
    log = workflow.chain_events(events).persist()
    assert all(r.ok for r in workflow.audit_breaks(log, ["chain"]).collect())
    cut = log.filter("not (chain = 2 and id = 17)").withColumn("event", F.when((F.col("chain") == 3) & (F.col("id") == 5), "x").otherwise(F.col("event")))
    assert {r.chain: r.broken_at for r in workflow.audit_breaks(cut, ["chain"]).collect()} == {1: None, 2: 18, 3: 5}
    single = workflow.audit_breaks(log.filter("chain = 1").drop("chain")).first()
    assert single.ok


def test_same_rows(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert workflow.same_rows(a, a.repartition(2)) and not workflow.same_rows(a, a.distinct())


def test_queue_states():
    state = ("queued", 0, 0.0)
    for event, at, want in [("done", 0, ("queued", 0, 0.0)), ("claim", 1, ("processing", 1, 11.0)), ("claim", 2, ("processing", 1, 11.0)), ("claim", 12, ("processing", 2, 22.0)), ("transient", 13, ("queued", 2, 0.0)), ("claim", 14, ("processing", 3, 24.0)), ("transient", 15, ("failed", 3, 0.0))]:
        state = step(state, event, at, lease=10)
        assert state == want
    assert step(("queued", 0, 0.0), "cancel", 1)[0] == "cancelled"


def test_queue_stream(spark, tmp_path):
    rows = [(1, "submit", 0.0), (1, "claim", 1.0), (1, "done", 2.0), (2, "submit", 0.0), (2, "claim", 1.0), (3, "cancel", 5.0)]
    spark.createDataFrame(rows, "item_id long, event string, at double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id long, event string, at double").json(str(tmp_path / "in"))
    query = item_states(stream).writeStream.format("memory").queryName("items").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {(r.item_id, r.status, r.attempts) for r in spark.table("items").collect()} == {(1, "done", 1), (2, "processing", 1), (3, "cancelled", 0)}


def test_job_pages_and_hosts(spark):
    items = spark.createDataFrame([(i, 1, "queued", 0, None, u, None, None) for i, u in enumerate(["https://a.cl/x", "ftp://a.cl/x", "http://A.cl:80/y", "https://b.cl", "no url"])], "id long, job_id int, status string, attempts int, lease_until double, source_url string, target_url string, error string")
    assert sorted(r.id for r in jobs.allowed(items, ["a.cl"]).collect()) == [0, 2]
    assert [r.id for r in jobs.queue_page(items, 1, 2, 1).collect()] == [1, 2]
    assert {r.status for r in jobs.cancel(items, 1).collect()} == {"cancelled"} and jobs.has_room(items, 95, 100) and not jobs.has_room(items, 96, 100)
