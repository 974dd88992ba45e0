"""The whole way, SQL functions, and imports."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from obsidia.catalog import TREATMENTS
from obsidia.operators.workflow import chain_events, same_rows
from obsidia.plans.protect import protect, register
from obsidia.sources.sqlite import check_tables, import_problems, read_sqlite
from obsidia.streaming.queue import item_states, poll

BLOCKS = [
    (1, 0, "body/p/0", "Sr. Juan Pérez, RUT 12.345.678-5, correo a@b.cl, folio 2020-771"),
    (1, 1, "body/p/1", "Ver 2020-771 y a@b.cl; firma JUAN PÉREZ."),
    (2, 0, "H!A1", "Folio"),
    (2, 1, "H!A2", "88-1234"),
    (2, 2, "H!B1", "sin datos"),
    (3, 0, "txt", None),
]


@pytest.mark.parametrize("treatment", TREATMENTS)
def test_treated_documents_verify(spark, treatment):
    blocks = spark.createDataFrame(BLOCKS, "doc_id long, ord int, location string, text string")
    out = protect(blocks, treatment)
    assert all(r.ok for r in out.verification.collect()) and out.verification.count() == 3
    texts = {(r.doc_id, r.location): r.text for r in out.blocks.collect()}
    assert len(texts) == len(BLOCKS) and texts[2, "H!A1"] == "Folio" and texts[2, "H!B1"] == "sin datos" and texts[3, "txt"] is None
    assert "12.345.678-5" not in texts[1, "body/p/0"] and "2020-771" not in texts[1, "body/p/1"] and texts[2, "H!A2"] != "88-1234"
    counts = {r.doc_id: r.stats for r in out.stats.collect()}
    assert counts[1] == {"NOMBRE": 2, "RUT": 1, "EMAIL": 2, "FOLIO": 2} and counts[2] == {"FOLIO": 1}
    if treatment == "pseudonymize":
        assert texts[1, "body/p/0"] == "Sr. Persona-01, RUT RUT-01, correo Correo-01, folio Folio-01"
        assert texts[1, "body/p/1"] == "Ver Folio-01 y Correo-01; firma Persona-01."
    if treatment == "anonymize":
        assert texts[2, "H!A2"] == "[FOLIO]"


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "IP 10.0.0.7"), (2, None)], "k int, t string").createOrReplaceTempView("some_texts")
    assert [tuple(r) for r in spark.sql("SELECT k, s.code, s.value FROM some_texts, LATERAL pii_spans(t, array('IP')) s").collect()] == [(1, "IP", "10.0.0.7")]
    assert [len(r[0]) for r in spark.sql("SELECT detect_spans(t, array('IP')) FROM some_texts ORDER BY k").collect()] == [1, 0]


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE users (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO users VALUES (?, ?)", [(1, "a"), (2, None)])
    users = read_sqlite(spark, path, "users", "id long, name string")
    assert same_rows(users, spark.createDataFrame([(2, None), (1, "a")], "id long, name string"))
    assert check_tables(spark, path, ["users", "jobs"]) == ({"jobs"}, set())
    assert users.filter(F.col("name").isNull()).count() == 1


def test_import_problems(spark, tmp_path):
    """A whole audit chain may come in; one with an altered row, or a file with other tables, may not."""
    schema = "id long, ts string, username string, ip string, event string, details string, prev_hash string, hash string"
    events = spark.createDataFrame([(0, i, f"2024-01-0{i}", "ana", None, "login", "{}") for i in (1, 2, 3)], "chain int, id long, ts string, username string, ip string, event string, details string")
    rows = [tuple(r)[1:] for r in chain_events(events).orderBy("id").collect()]
    for name, alter in (("whole", None), ("altered", 2)):
        path = str(tmp_path / f"{name}.db")
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE audit_log (id INTEGER, ts TEXT, username TEXT, ip TEXT, event TEXT, details TEXT, prev_hash TEXT, hash TEXT)")
            db.executemany("INSERT INTO audit_log VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(*r[:2], "eva", *r[3:]) if r[0] == alter else r for r in rows])
        found = import_problems(spark, path, ["audit_log"], "audit_log", schema)
        assert found == ([] if alter is None else ["audit_log broken at 2"])
    assert import_problems(spark, path, ["users"], "users", schema) == ["missing users", "unexpected audit_log"]


def test_polling_a_queue(spark, tmp_path):
    events = [(1, "submit", 1.0), (1, "claim", 2.0), (2, "submit", 1.0), (1, "done", 3.0)]
    spark.createDataFrame(events, "item_id long, event string, at double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id long, event string, at double").parquet(str(tmp_path / "in"))
    seen = {}
    query = poll(item_states(stream), lambda batch, n: seen.update({r.item_id: r.status for r in batch.collect()}), str(tmp_path / "check"), 0.2)
    query.processAllAvailable()
    query.stop()
    assert seen == {1: "done", 2: "queued"}
