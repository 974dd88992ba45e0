"""Queries over review, approval, audit and pages, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, review

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_STATES = "uploaded processing review submitted approved protecting pending_approval protected protected_with_warnings verification_failed rejected failed".split()
_ACTIONS = "process processed edit approve submit protect protected accept reject return fail".split()
_LIST = lambda names: "([" + ", ".join(f"'{n}'" for n in names) + "])"


def _pick(names: list[str], k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("doc_id"), (c % 200).alias("batch_id"), _pick(_STATES, k).alias("status"), F.lit(None).cast("string").alias("treatment"), F.when(c % 3 > 0, c % 3 == 1).alias("verified"),
        F.when(c % 2 == 0, F.col("o_orderdate")).alias("submitted_at"), F.lit("x").alias("submitted_by"), F.when(c % 4 == 0, F.col("o_orderdate")).alias("decision_at"), F.lit(None).cast("string").alias("decision_by"),
        F.lit(None).cast("string").alias("decision_note"), F.lit(None).cast("timestamp").alias("protected_at"), F.lit(None).cast("string").alias("error"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("uploaded_by"),
    )


_DOCS = f"SELECT o_orderkey AS doc_id, o_custkey % 200 AS batch_id, {_LIST(_STATES)}[1 + o_orderkey % 12] AS status, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 = 1 END AS verified, o_custkey % 2 = 0 AS sub, o_custkey % 4 = 0 AS dec, o_orderdate, o_orderpriority, o_custkey FROM orders"


@_query(f"""WITH d AS ({_DOCS}), a AS (SELECT *, {_LIST(_ACTIONS)}[1 + (doc_id // 12) % 11] AS action, o_custkey % 5 > 0 AS treats FROM d),
f AS (SELECT *, CASE action
 WHEN 'process' THEN status = 'uploaded' WHEN 'processed' THEN status = 'processing' WHEN 'edit' THEN status IN ('review', 'verification_failed', 'protected_with_warnings')
 WHEN 'approve' THEN status IN ('review', 'verification_failed', 'protected_with_warnings') AND treats WHEN 'submit' THEN status IN ('review', 'verification_failed', 'protected_with_warnings') AND treats
 WHEN 'protect' THEN status IN ('approved', 'submitted') WHEN 'protected' THEN status = 'protecting' WHEN 'fail' THEN status IN ('processing', 'protecting') ELSE status = 'pending_approval' END AS ok FROM a)
SELECT doc_id, CASE WHEN NOT ok THEN status ELSE CASE action
 WHEN 'process' THEN 'processing' WHEN 'processed' THEN 'review' WHEN 'edit' THEN CASE WHEN status = 'protected_with_warnings' THEN 'review' ELSE status END WHEN 'approve' THEN 'approved' WHEN 'submit' THEN 'submitted'
 WHEN 'protect' THEN 'protecting' WHEN 'protected' THEN CASE WHEN sub AND NOT dec THEN 'pending_approval' WHEN o_custkey % 7 > 0 THEN 'protected' ELSE 'protected_with_warnings' END
 WHEN 'accept' THEN CASE WHEN verified THEN 'protected' ELSE 'protected_with_warnings' END WHEN 'reject' THEN 'rejected' WHEN 'return' THEN 'review' ELSE 'failed' END END AS status,
 CASE WHEN ok AND action IN ('approve', 'submit') THEN 'redact' END AS treatment,
 CASE WHEN ok AND action IN ('accept', 'reject', 'return') THEN 'admin' END AS decision_by, CASE WHEN ok AND action IN ('reject', 'return') THEN 'nota' END AS decision_note,
 CASE WHEN ok AND (action = 'return' OR (action = 'edit' AND status = 'protected_with_warnings')) THEN NULL WHEN ok AND action = 'protected' THEN o_custkey % 7 > 0 ELSE verified END AS verified,
 CASE WHEN ok THEN NULL ELSE action || ' in ' || status END AS refused FROM f""")
def q_moved(spark, sf_dir):
    """Every state under every action: what it becomes, what is set and cleared, and what is refused."""
    docs = _orders(spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c"))
    actions = docs.select("doc_id").join(customer, "doc_id").select(
        "doc_id", _pick(_ACTIONS, F.floor(F.col("doc_id") / 12)).alias("action"), F.lit("admin").alias("username"), F.lit("1999-01-01 00:00:00").cast("timestamp").alias("at"), F.lit("nota").alias("note"),
        F.when(F.col("c") % 5 > 0, "redact").otherwise("blur").alias("treatment"), (F.col("c") % 7 > 0).alias("verified"),
    )
    return review.moved(docs, actions).select("doc_id", "status", "treatment", "decision_by", "decision_note", "verified", "refused")


_CODES = ["NOMBRE", "RUT", "FOLIO"]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc_id")).count()
    rows = lines.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
    return rows.select(
        F.concat_ws("-", "doc_id", "n").alias("finding_id"), "doc_id", "n", _pick(_CODES, F.col("n")).alias("entity_code"), F.when(F.col("n") % 4 == 0, "manual").otherwise("auto").alias("source"),
        F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("int").alias("reviewed_at"),
    )


_FOUND = f"""SELECT doc_id || '-' || n AS finding_id, doc_id, n, {_LIST(_CODES)}[1 + n % 3] AS entity_code, n % 4 = 0 AS manual
FROM (SELECT l_orderkey AS doc_id, unnest(range(1, count(*) + 1)) AS n FROM lineitem GROUP BY 1)"""
_MAY = f"SELECT o_orderkey AS doc_id FROM orders WHERE {_LIST(_STATES)}[1 + o_orderkey % 12] IN ('review', 'verification_failed', 'protected_with_warnings')"


@_query(f"""WITH f AS ({_FOUND}), e AS ({_MAY})
SELECT finding_id, CASE WHEN e.doc_id IS NULL THEN 'accepted' WHEN n = 1 THEN 'accepted' WHEN f.doc_id % 2 = 0 AND entity_code = 'RUT' THEN 'rejected' WHEN f.doc_id % 2 = 1 THEN 'rejected' ELSE 'accepted' END AS status,
CASE WHEN e.doc_id IS NULL THEN NULL WHEN n = 1 THEN 'ana' WHEN (f.doc_id % 2 = 0 AND entity_code = 'RUT') OR f.doc_id % 2 = 1 THEN 'luis' END AS reviewed_by FROM f LEFT JOIN e USING (doc_id)""")
def q_reviewed(spark, sf_dir):
    """Findings after reviews by id, in bulk, and in bulk of one category."""
    found = _findings(spark, sf_dir)
    docs = _orders(spark, sf_dir)
    none = F.lit(None).cast("string")
    one = docs.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-1")).alias("finding_id"), none.alias("entity_code"), F.lit("accepted").alias("status"), F.lit("ana").alias("username"), F.lit(1).alias("at"))
    bulk = docs.select("doc_id", none.alias("finding_id"), F.when(F.col("doc_id") % 2 == 0, "RUT").alias("entity_code"), F.lit("rejected").alias("status"), F.lit("luis").alias("username"), F.lit(2).alias("at"))
    odd = docs.select("doc_id", none.alias("finding_id"), none.alias("entity_code"), F.lit("edited").alias("status"), F.lit("eva").alias("username"), F.lit(3).alias("at"))
    return review.reviewed(found, one.unionByName(bulk).unionByName(odd), docs).select("finding_id", "status", "reviewed_by")


@_query(f"WITH f AS ({_FOUND}), e AS ({_MAY}) SELECT finding_id, n FROM f WHERE NOT (manual AND doc_id IN (SELECT doc_id FROM e))")
def q_without_manual(spark, sf_dir):
    """Findings after all are asked to be deleted: the manual ones of documents under review are gone."""
    found = _findings(spark, sf_dir)
    return review.without_manual(found, found.select("finding_id"), _orders(spark, sf_dir)).select("finding_id", "n")


@_query(f"""WITH e AS ({_MAY}) SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey NOT IN (SELECT doc_id FROM e) THEN 'NOT_EDITABLE' ELSE (['UNKNOWN_ENTITY', 'BAD_BOX', 'NO_PLACE', 'BAD_OFFSETS', NULL, NULL])[1 + o_custkey % 6] END AS error_code,
CASE WHEN o_custkey % 6 IN (0, 1, 5) THEN 1 END AS page, CASE WHEN o_custkey % 6 IN (3, 4) THEN 'body/p/1' END AS location, CASE WHEN o_custkey % 2 = 0 THEN '(manual)' ELSE 'Ana' END AS text FROM orders""")
def q_manual_findings(spark, sf_dir):
    """Requests of reviewers, right and wrong in each way."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    m = F.col("o_custkey") % 6
    box = F.when(m.isin(0, 5), F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))).when(m == 1, F.array(*map(F.lit, (3.0, 2.0, 1.0, 4.0))))
    requests = o.select(
        F.lit(1).alias("request_id"), F.col("o_orderkey").alias("doc_id"), F.when(m == 0, "OTRO").otherwise("NOMBRE").alias("entity_code"), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("Ana").alias("text"), F.lit(None).cast("int").alias("page"),
        box.alias("box"), F.when(m.isin(3, 4), "body/p/1").alias("location"), F.when(m == 3, -1).otherwise(2).alias("start"), F.lit(5).alias("end"),
    )
    return review.manual_findings(requests, _orders(spark, sf_dir)).select("doc_id", "error_code", "page", "location", "text")


@_query("""SELECT c_mktsegment AS document_type, code AS entity_code, max(c_custkey % 2)::INT AS enabled FROM customer, (VALUES ('NOMBRE'), ('RUT')) v(code) GROUP BY 1, 2""")
def q_replaced_policies(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    matrix = c.groupBy(F.col("c_mktsegment").alias("document_type")).agg((F.max(F.col("c_custkey") % 2) == 1).alias("enabled")).withColumn("entity_code", F.explode(F.array(*map(F.lit, ("NOMBRE", "RUT", "NADA")))))
    return review.replaced_policies(matrix)


_TREATED = ["redact", "TACHAR", "seudonimizar", "Enmascarar  total", "borrar", ""]
_LEVELS = ["fast", "Rapido", "equilibrado", "EXHAUSTIVO", "lento"]


@_query(f"""WITH r AS (SELECT c_custkey AS request_id, {_LIST(["redact", "redact", "pseudonymize", "mask_full"])}[1 + c_custkey % 6] AS treatment, {_LIST(["fast", "fast", "balanced", "exhaustive"])}[1 + c_custkey % 5] AS analysis_level, c_mktsegment, c_custkey FROM customer)
SELECT request_id, CASE WHEN c_custkey % 3 = 0 THEN 'RUT' WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'NOMBRE,IP' END AS entities, treatment, analysis_level,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'BAD_TYPE' WHEN treatment IS NULL THEN 'BAD_TREATMENT' WHEN analysis_level IS NULL THEN 'BAD_LEVEL' END AS error_code FROM r""")
def q_options(spark, sf_dir):
    """Options of requests by code or by what the screen calls them."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    requests = c.select(k.alias("request_id"), F.col("c_mktsegment").alias("document_type"), F.when(k % 3 == 0, F.array(F.lit("RUT"), F.lit("NADA"))).otherwise(F.array(F.lit("NADA"))).alias("entities"), _pick(_TREATED, k).alias("treatment"), _pick(_LEVELS, k).alias("analysis_level"))
    types = c.select(F.col("c_mktsegment").alias("document_type")).distinct().withColumn("active", F.when(F.col("document_type") == "BUILDING", 0).otherwise(1))
    effective = types.filter("document_type <> 'BUILDING'").select("document_type", F.array(F.lit("NOMBRE"), F.lit("IP")).alias("entities"))
    return review.resolved_options(requests, types, effective).select("request_id", F.array_join("entities", ",").alias("entities"), "treatment", "analysis_level", "error_code")


@_query(f"""WITH d AS ({_DOCS}) SELECT doc_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = doc_id) AS n_findings FROM d WHERE status IN ('submitted', 'protecting', 'pending_approval')""")
def q_pending(spark, sf_dir):
    return review.pending(_orders(spark, sf_dir), _findings(spark, sf_dir)).select("doc_id", "n_findings")


@_query(f"""WITH d AS ({_DOCS}) SELECT batch_id, min(o_orderdate) AS started, count(*) AS n_documents, count(*) FILTER (status IN ('protected', 'protected_with_warnings')) AS n_done FROM d WHERE o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY started DESC NULLS LAST, batch_id LIMIT 100""")
def q_batches(spark, sf_dir):
    return review.batches(_orders(spark, sf_dir), "1-URGENT", "operador")


@_query(f"""WITH d AS ({_DOCS}) SELECT 'queue' AS area, status, count(*) AS n FROM d WHERE status IN ('uploaded', 'processing', 'submitted', 'approved', 'protecting') GROUP BY 2
UNION ALL SELECT 'jobs', (['queued', 'processing', 'done'])[1 + event_id % 3], count(*) FROM events WHERE event_id % 3 < 2 GROUP BY 2""")
def q_health(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/events.parquet").select(_pick(["queued", "processing", "done"], F.col("event_id")).alias("status"))
    return review.health(_orders(spark, sf_dir), items)


@_query("SELECT p_partkey AS doc_id, word AS text FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE contains(lower(word), 're')")
def q_word_search(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.explode(F.split("p_name", " ")).alias("text"))
    return review.word_search(words, "RE")


@_query("""WITH p AS (SELECT * FROM events WHERE event_type = 'click' AND user_id::VARCHAR LIKE '%1%' ORDER BY event_id DESC LIMIT 200)
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'redact' ELSE '' END AS treatment, CASE WHEN c_custkey IS NOT NULL AND c_custkey % 2 = 0 THEN 'balanced' ELSE 'fast' END AS analysis_level,
'{"documento": "' || coalesce(c_name, 'Documento eliminado') || '"' || CASE WHEN event_id % 2 = 0 THEN ', "stats": {"treatment": "redact"}' ELSE '' END || '}' AS details
FROM p LEFT JOIN customer ON c_custkey = user_id * 5""")
def q_audit_page(spark, sf_dir):
    """The newest events of a kind and of some users, with their documents' titles."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stats = F.when(F.col("event_id") % 2 == 0, ', "stats": {"treatment": "redact"}').otherwise("")
    log = e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("string").alias("ts"), F.col("user_id").cast("string").alias("username"), F.lit("192.0.2.1").alias("ip"), F.col("event_type").alias("event"),
        F.concat(F.lit('{"document_id": "'), (F.col("user_id") * 5).cast("string"), F.lit('"'), stats, F.lit("}")).alias("details"), F.lit("").alias("prev_hash"), F.lit("").alias("hash"),
    )
    docs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("original_name"), F.when(F.col("c_custkey") % 2 == 0, "balanced").alias("analysis_level"))
    return review.audit_page(log, docs, "click", "1", 200).select("id", "treatment", "analysis_level", "details")


@_query("""SELECT p_partkey AS doc_id, idx FROM part, (VALUES (0), (2), (5)) v(idx)""")
def q_supplement(spark, sf_dir):
    """Words of a second reading: one is covered by the first, one by a word taken before it, one lies in its middle."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.col("p_brand").alias("text"))
    box = lambda i, x, y: F.struct(F.lit(i).alias("idx"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(x + 40.0).alias("x1"), F.lit(y + 10.0).alias("y1"))
    second = parts.withColumn("b", F.explode(F.array(box(0, 0, 0), box(1, 15, 2), box(2, 30, 0), box(3, 200, 0), box(4, 31, 1), box(5, 100, 0)))).select("doc_id", "page", "text", "b.*")
    first = parts.withColumn("b", F.explode(F.array(box(0, 202, 1)))).select("doc_id", "page", "text", "b.*")
    return geometry.supplement(second, first).select("doc_id", "idx")


@_query("""SELECT c_custkey AS doc_id, c_custkey % 10 >= 7 AND c_custkey % 3 > 0 AS scanned, c_custkey % 10 >= 7 AND c_custkey % 3 > 0 AND (c_custkey % 4 = 2 OR (c_custkey % 4 = 1 AND c_custkey % 5 = 0)) AS wider,
c_custkey % 10 >= 7 AND c_custkey % 3 > 0 AND c_custkey % 4 = 2 AS verifying FROM customer""")
def q_readings(spark, sf_dir):
    """Which pages are scans, and which further readings they get by level."""
    k = F.col("c_custkey")
    image = lambda w: F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), w.cast("double").alias("x1"), F.lit(100.0).alias("bottom"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, F.when(k % 3 > 0, F.array(image(F.lit(1)), image(k % 10 * 10))).alias("images"), F.element_at(F.array(*map(F.lit, ("fast", "balanced", "exhaustive", "fast"))), (k % 4 + 1).cast("int")).alias("level"))
    pages = c.withColumn("scanned", geometry.full_scan(F.col("images"), F.lit(100.0), F.lit(100.0)))
    return pages.withColumn("r", geometry.second_readings(F.col("level"), F.col("scanned"), k % 5 == 0)).select(k.alias("doc_id"), "scanned", "r.wider", "r.verifying")
