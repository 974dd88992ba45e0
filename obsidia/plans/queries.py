"""Registered queries of the library's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ANONYMOUS, BLOCK, ENTITIES
from ..functions.normalize import LOOK_ALIKES, canonical, norm, norm_soft, strip_marks
from ..functions.patterns import DETECTORS
from ..functions.spans import detector_spans, matches
from ..operators import cells as cell_rules
from ..operators import geometry, jobs, workflow
from ..operators.detect import TEXT_CODES, detect, findings
from ..operators.pseudonyms import batch_aliases, persistent_aliases
from ..operators.treat import anonymize, mask_partial, redact, treat_spans
from ..operators.verify import leaks
from . import forms, reviews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A moment for ages and leases, so that reruns agree.
NOW = "1998-08-02 00:00:00"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CANONICAL = "translate(coalesce(text, ''), " + " || ".join(f"chr({ord(c)})" for v in LOOK_ALIKES.values() for c in v) + ", '" + "".join(k * len(v) for k, v in LOOK_ALIKES.items()) + "')"


def _values(spark, sf_dir, code, table="documents", key="doc_id", text="text"):
    rows = _t(spark, sf_dir, table).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return findings(detect(rows, [code]), ["doc_id"]).select("doc_id", F.col("text").alias("value"))


# detectors


@_query(
    rf"""SELECT doc_id, regexp_replace(unnest(regexp_extract_all({_CANONICAL}, '[\p{{L}}\p{{N}}_.%+-]{{1,64}}@[A-Za-z0-9.-]{{1,255}}\.[A-Za-z]{{2,24}}')), '[.,;:)]+$', '') AS value FROM documents"""
)
def q_email_strict(spark, sf_dir):
    """Well-formed mail addresses of every document."""
    docs = _t(spark, sf_dir, "documents")
    found = docs.withColumn("text", canonical(F.coalesce(F.col("text"), F.lit("")))).withColumn("spans", detector_spans(F.col("text"), DETECTORS[0]))
    return findings(found, ["doc_id"]).select("doc_id", F.col("text").alias("value"))


@_query()
def q_email(spark, sf_dir):
    """Mail addresses, also with gaps and spelled signs."""
    return _values(spark, sf_dir, "EMAIL")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@_query(
    rf"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all({_CANONICAL}, '[0-9.]+')) AS run FROM documents),
hits AS (SELECT doc_id, regexp_extract(run, '^({_OCTET}(?:\.{_OCTET}){{3}})(?:\.|$)', 1) AS value FROM runs)
SELECT doc_id, value FROM hits WHERE value <> ''"""
)
def q_ip(spark, sf_dir):
    return _values(spark, sf_dir, "IP")


_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[len(d) - i + 1] ELSE (CASE WHEN d[len(d) - i + 1] > 4 THEN 2 * d[len(d) - i + 1] - 9 ELSE 2 * d[len(d) - i + 1] END) END)) % 10 = 0"


@_query(
    rf"""WITH marked AS (SELECT doc_id, regexp_replace({_CANONICAL}, '([^0-9])([0-9])', '\1¦\2', 'g') AS text FROM documents),
hits AS (SELECT doc_id, replace(unnest(regexp_extract_all(text, '(?:^|¦)((?:[0-9]{{4}}[\s-]?¦?){{3}}[0-9]{{4}})(?:[^0-9]|$)', 1)), '¦', '') AS value FROM marked),
digits AS (SELECT doc_id, value, list_transform(string_split(regexp_replace(value, '[^0-9]', '', 'g'), ''), lambda c: c::INT) AS d FROM hits)
SELECT doc_id, value FROM digits WHERE {_LUHN}"""
)
def q_card(spark, sf_dir):
    return _values(spark, sf_dir, "TARJETA")


_RUT = r"(?:^|[^0-9.])([0-9]{1,2}(?:[ \t\f]*\.?[ \t\f]*[0-9]{3}){2}[ \t\f]*-?\s*[0-9kK])(?:[^0-9]|$)"


@_query(
    rf"""WITH hits AS (SELECT doc_id, unnest(regexp_extract_all({_CANONICAL}, '{_RUT}', 1)) AS value FROM documents),
compact AS (SELECT doc_id, value, upper(regexp_replace(value, '[^0-9kK]', '', 'g')) AS c FROM hits),
parts AS (SELECT *, string_split(reverse(c[:-2]), '') AS b, c[-1] AS dv FROM compact WHERE length(c) >= 8)
SELECT doc_id, value FROM parts WHERE try_cast(c[:-2] AS BIGINT) < 50000000
AND dv = (['0','K','9','8','7','6','5','4','3','2','1'])[(1 + list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i]::INT * (2 + (i - 1) % 6))) % 11)::BIGINT]"""
)
def q_rut(spark, sf_dir):
    return _values(spark, sf_dir, "RUT")


@_query(r"""SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?i)(?:https?://|www\.)\S+'))::INT AS n FROM pages""")
def q_urls(spark, sf_dir):
    """Addresses in raw pages."""
    return _t(spark, sf_dir, "pages").select("page_id", F.size(matches(F.coalesce("html", F.lit("")), r"(?iU)(?:https?://|www\.)\S+")).alias("n"))


@_query()
def q_web(spark, sf_dir):
    return _values(spark, sf_dir, "WEB_REDES", "pages", "page_id", "html")


def _register_codes() -> None:
    for code in ("TELEFONO", "NOMBRE"):
        QUERIES[f"q_{code.lower()}"] = lambda spark, sf_dir, code=code: _values(spark, sf_dir, code)


_register_codes()


@_query()
def q_counts_by_lang(spark, sf_dir):
    """Findings by language and category."""
    found = detect(_t(spark, sf_dir, "documents").select("lang", "text"), TEXT_CODES)
    return found.select("lang", F.explode("spans").alias("s")).groupBy("lang", F.col("s.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


# treatments


@_query("SELECT doc_id, length(coalesce(text, ''))::INT AS before, length(coalesce(text, ''))::INT AS after, true AS blanks_stay FROM documents")
def q_redact_length(spark, sf_dir):
    """Redaction keeps the length and the white space of every text."""
    done = treat_spans(detect(_t(spark, sf_dir, "documents").select("doc_id", "text")), "redact")
    blanks = lambda c: F.regexp_replace(c, r"(?U)\S", "x")
    whole = F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.length(whole).alias("before"), F.length("treated").alias("after"), (blanks(whole) == blanks(F.col("treated"))).alias("blanks_stay"))


@_query(rf"SELECT c_custkey, regexp_replace(c_name, '\S', '{BLOCK}', 'g') AS redacted, '********' AS masked FROM customer")
def q_redact(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", redact(F.col("c_name")).alias("redacted"), F.lit("********").alias("masked"))


@_query(
    r"""WITH c AS (SELECT c_custkey, c_name, least(3, greatest(length(regexp_replace(c_name, '[^\p{L}\p{N}]', '', 'g')) - 1, 0)) AS visible FROM customer)
SELECT c_custkey, array_to_string(list_transform(range(1, length(c_name) + 1), lambda i: CASE WHEN regexp_matches(c_name[i], '[\p{L}\p{N}]') AND length(regexp_replace(c_name[1:i], '[^\p{L}\p{N}]', '', 'g')) > visible THEN '*' ELSE c_name[i] END), '') AS masked FROM c"""
)
def q_mask_partial(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", mask_partial(F.col("c_name"), F.lit("NOMBRE")).alias("masked"))


_CODES = list(ENTITIES)
_CODE_OF_CUSTOMER = "([" + ", ".join(f"'{c}'" for c in _CODES) + "])[1 + c_custkey % 15]"


def _customer_code():
    return F.element_at(F.array(*map(F.lit, _CODES)), (F.col("c_custkey") % 15 + 1).cast("int"))


@_query("SELECT c_custkey, '[' || CASE " + _CODE_OF_CUSTOMER + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ANONYMOUS.items()) + f" ELSE {_CODE_OF_CUSTOMER} END || ']' AS label FROM customer")
def q_anonymize(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", anonymize(_customer_code()).alias("label"))


def _customer_findings(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("scope_id"), F.lit("NOMBRE").alias("entity_code"), F.col("c_name").alias("text"), F.lit("accepted").alias("status"), "c_custkey")


_NORM = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9@]', '', 'g')"
_SOFT = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9@]+', ' ', 'g'))"


@_query(
    f"""SELECT DISTINCT c_nationkey AS scope_id, 'NOMBRE' AS entity_code, {_NORM.format("c_name")} AS value,
'Persona-' || printf('%02d', dense_rank() OVER (PARTITION BY c_nationkey ORDER BY {_NORM.format("c_name")})) AS alias FROM customer"""
)
def q_pseudonyms(spark, sf_dir):
    """Aliases of all customers by nation."""
    return batch_aliases(_customer_findings(spark, sf_dir), ["scope_id"])


_HASH = "sha256('NOMBRE:' || {0})"


@_query(
    f"""WITH v AS (SELECT DISTINCT c_nationkey AS scope_id, c_custkey, {_NORM.format("c_name")} AS value FROM customer),
known AS (SELECT scope_id, {_HASH.format("value")} AS value_hash, 2 * row_number() OVER (PARTITION BY scope_id ORDER BY value) AS number FROM v WHERE c_custkey % 3 = 0),
fresh AS (SELECT scope_id, {_HASH.format("value")} AS value_hash, row_number() OVER (PARTITION BY scope_id ORDER BY value) AS nth FROM v WHERE c_custkey % 3 <> 0),
tops AS (SELECT f.scope_id, max(nth) + (SELECT count(*) FROM known k WHERE k.scope_id = f.scope_id) AS top FROM fresh f GROUP BY f.scope_id),
numbers AS (SELECT scope_id, unnest(range(1, top + 1)) AS number FROM tops),
free AS (SELECT scope_id, number, row_number() OVER (PARTITION BY scope_id ORDER BY number) AS nth FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.scope_id = n.scope_id AND k.number = n.number))
SELECT scope_id, 'NOMBRE' AS entity_code, value_hash, 'Persona-' || printf('%02d', number) AS alias FROM known
UNION ALL SELECT scope_id, 'NOMBRE', value_hash, 'Persona-' || printf('%02d', number) FROM fresh JOIN free USING (scope_id, nth)"""
)
def q_pseudonyms_persistent(spark, sf_dir):
    """New customers take the numbers that known ones left free."""
    from pyspark.sql import Window

    all_ = _customer_findings(spark, sf_dir)
    value = norm(F.col("text"))
    number = (2 * F.row_number().over(Window.partitionBy("scope_id").orderBy(value))).cast("int")
    known = all_.filter("c_custkey % 3 = 0").select("scope_id", "entity_code", F.sha2(F.concat(F.lit("NOMBRE:"), value).cast("binary"), 256).alias("value_hash"), F.format_string("Persona-%02d", number).alias("alias"))
    return persistent_aliases(all_, known)


# normal forms and verification


@_query(f"SELECT doc_id, md5({_NORM.format('text')}) AS hard, md5({_SOFT.format('text')}) AS soft FROM documents")
def q_norm(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(norm(F.col("text")).cast("binary")).alias("hard"), F.md5(norm_soft(F.col("text")).cast("binary")).alias("soft"))


@_query("SELECT n_nationkey, lower(strip_accents(n_name || ' ÁÉÍÓÚ ñ Ç ü å')) AS bare FROM nation")
def q_strip(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", strip_marks(F.concat("n_name", F.lit(" ÁÉÍÓÚ ñ Ç ü å"))).alias("bare"))


_LEAK = f"""WITH lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
sought AS (SELECT DISTINCT doc_id, line AS value, {_NORM.format("line")} AS hard, {_SOFT.format("line")} AS soft FROM lines WHERE i = 1 AND length({_NORM.format("line")}) >= 4),
pieces AS (SELECT doc_id, {_NORM.format("line")} AS hard, {_SOFT.format("line")} AS soft FROM lines WHERE i > 1)
SELECT doc_id, value FROM sought s WHERE EXISTS (SELECT 1 FROM pieces p WHERE p.doc_id = s.doc_id AND (contains(p.soft, s.soft) OR (length(s.hard) >= 9 AND contains(p.hard, s.hard))))"""


@_query(_LEAK)
def q_verify_leaks(spark, sf_dir):
    """First lines that a later line of the same document holds again."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return leaks(lines.filter("i = 0").select("doc_id", F.col("text").alias("value")), lines.filter("i > 0"), ["doc_id"])


# policies, lists and reports

_POLICIES = [("*", "FECHA", 0), ("*", "FOLIO", 0), ("BUILDING", "FOLIO", 1), ("BUILDING", "IP", 0), ("MACHINERY", "NOMBRE", 0)]
_POLICY_SQL = "VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _POLICIES)
_ENTITY_SQL = "VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(ENTITIES))
_MATRIX = f"""WITH p(document_type, code, enabled) AS ({_POLICY_SQL}), e(ord, code) AS ({_ENTITY_SQL}), t AS (SELECT DISTINCT c_mktsegment AS document_type FROM customer),
matrix AS (SELECT t.document_type, ord::INT AS ord, e.code, coalesce(own.enabled, star.enabled, 1)::INT AS enabled FROM t, e
LEFT JOIN p own ON own.document_type = t.document_type AND own.code = e.code LEFT JOIN p star ON star.document_type = '*' AND star.code = e.code)"""


def _policies(spark, sf_dir):
    types = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("document_type")).distinct()
    return types, spark.createDataFrame(_POLICIES, "document_type string, entity_code string, enabled int")


@_query(f"{_MATRIX} SELECT * FROM matrix")
def q_policy_matrix(spark, sf_dir):
    return workflow.policy_matrix(*_policies(spark, sf_dir))


@_query(f"{_MATRIX} SELECT document_type, string_agg(code, ',' ORDER BY ord) AS entities FROM matrix WHERE enabled <> 0 GROUP BY document_type")
def q_effective_entities(spark, sf_dir):
    return workflow.effective_entities(*_policies(spark, sf_dir)).withColumn("entities", F.array_join("entities", ","))


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'protected' WHEN 'O' THEN 'review' ELSE 'protected_with_warnings' END"
_LINE_STATE = "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'edited' END"


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("batch_id"), F.concat(F.lit("doc-"), "o_orderkey").alias("name"), F.lit("txt").alias("format"), F.lit("redact").alias("treatment"),
        F.expr(_STATE).alias("status"), F.lit(1).alias("pages"), F.col("o_orderpriority").alias("uploaded_by"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("protected_at"),
        (F.col("o_orderstatus") != "P").alias("verified"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate")).alias("submitted_at"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderdate")).alias("decision_at"),
    )


def _lines(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_LINE_STATE).alias("status"))


@_query(
    f"""WITH page AS (SELECT o_orderkey AS doc_id, {_STATE} AS status FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 1000)
SELECT doc_id, status, (SELECT count(*) FROM lineitem WHERE l_orderkey = doc_id) AS n_findings, (SELECT count(*) FROM lineitem WHERE l_orderkey = doc_id AND {_LINE_STATE} IN ('accepted', 'edited')) AS n_accepted FROM page"""
)
def q_document_list(spark, sf_dir):
    """The newest 1000 documents with their counts of findings."""
    return workflow.listed(_orders(spark, sf_dir), _lines(spark, sf_dir), "x", "auditor").select("doc_id", "status", "n_findings", "n_accepted")


@_query(
    f"""SELECT o_orderkey AS doc_id, o_custkey AS batch_id, {_STATE} AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND {_LINE_STATE} IN ('accepted', 'edited')) AS accepted,
CASE WHEN o_orderstatus = 'P' THEN 'sí' ELSE 'no' END AS warning FROM orders"""
)
def q_batch_report(spark, sf_dir):
    return workflow.batch_report(_orders(spark, sf_dir), _lines(spark, sf_dir)).select("doc_id", "batch_id", "status", "accepted", "warning")


@_query(f"SELECT o_orderpriority AS uploaded_by, count(*) FILTER ({_STATE} = 'review') AS review, count(*) FILTER ({_STATE} = 'protected') AS protected FROM orders GROUP BY 1")
def q_status_counts(spark, sf_dir):
    return workflow.status_counts(_orders(spark, sf_dir), "uploaded_by", ["review", "protected"])


@_query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_visible(spark, sf_dir):
    return workflow.visible(_orders(spark, sf_dir), "1-URGENT", "operador").select("doc_id")


@_query(
    f"""SELECT o_orderkey AS doc_id, date_diff('second', o_orderdate, TIMESTAMP '{NOW}') / 86400.0 > 30 AS drop_original, date_diff('second', o_orderdate, TIMESTAMP '{NOW}') / 86400.0 > 365 AS drop_protected
FROM orders WHERE {_STATE} IN ('protected', 'protected_with_warnings')"""
)
def q_retention(spark, sf_dir):
    return workflow.retention(_orders(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@_query(
    """WITH d AS (SELECT o_orderkey AS doc_id, (['uploaded','processing','submitted','protecting','approved','verification_failed','review'])[1 + o_orderkey % 7] AS status,
o_custkey % 2 = 0 AS sub, o_custkey % 4 = 0 AS dec, o_orderstatus <> 'P' AS verified FROM orders),
r AS (SELECT *, CASE WHEN status IN ('uploaded', 'processing') THEN 'process' WHEN status = 'submitted' OR (status = 'protecting' AND sub AND NOT dec) THEN 'approve' WHEN status = 'approved' OR (status = 'protecting' AND NOT sub) THEN 'protect' END AS redo FROM d)
SELECT doc_id, redo, CASE redo WHEN 'process' THEN 'uploaded' WHEN 'approve' THEN 'submitted' WHEN 'protect' THEN 'approved'
ELSE CASE WHEN status <> 'verification_failed' THEN status WHEN sub AND NOT dec THEN 'pending_approval' WHEN verified THEN 'protected' ELSE 'protected_with_warnings' END END AS status FROM r"""
)
def q_requeue(spark, sf_dir):
    states = F.array(*map(F.lit, ["uploaded", "processing", "submitted", "protecting", "approved", "verification_failed", "review"]))
    docs = _orders(spark, sf_dir).withColumn("status", F.element_at(states, (F.col("doc_id") % 7 + 1).cast("int")))
    return workflow.requeued(docs).select("doc_id", "redo", "status")


@_query("SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 5 = 0 THEN 'rejected' ELSE " + _STATE + " END AS status FROM orders")
def q_review(spark, sf_dir):
    """States after a review's changes are laid over them."""
    docs = _orders(spark, sf_dir)
    return workflow.overlay(docs.select("doc_id", "status"), docs.filter("batch_id % 5 = 0").select("doc_id", F.lit("rejected").alias("status")), ["doc_id"])


_ROLES = "(['auditor','revisor','regular','operador','desconocido'])[1 + event_id % 5]"


@_query(
    f"""WITH c AS (SELECT user_id::VARCHAR AS username, {_ROLES} AS role FROM events),
p(role, rank) AS (VALUES ('administrador', 0), ('auditor', 1), ('aprobador', 2), ('revisor', 3), ('operador', 4), ('regular', 5))
SELECT username, coalesce(arg_min(p.role, rank), 'regular') AS role FROM c LEFT JOIN p USING (role) GROUP BY username"""
)
def q_roles(spark, sf_dir):
    names = F.array(*map(F.lit, ["auditor", "revisor", "regular", "operador", "desconocido"]))
    claims = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("username"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("role"))
    return workflow.role_of(claims, "regular")


@_query("SELECT event_id::VARCHAR AS token, c_name AS username FROM events JOIN customer ON user_id = c_custkey WHERE value > 50 AND c_custkey % 3 > 0")
def q_sessions(spark, sf_dir):
    events, users = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "customer")
    sessions = events.select(F.col("event_id").cast("string").alias("token"), "user_id", F.col("value").alias("expires"))
    people = users.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.lit("regular").alias("role"), F.when(F.col("c_custkey") % 3 > 0, 1).otherwise(0).alias("active"))
    return workflow.live_sessions(sessions, people, 50).select("token", "username")


# audit and queue


def _audit_log(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return workflow.chain_events(
        events.select(
            F.col("user_id").alias("chain"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("user_id").cast("string").alias("username"),
            F.when(F.col("event_id") % 2 == 0, "192.0.2.1").alias("ip"), F.col("event_type").alias("event"), F.col("props").alias("details"),
        )
    )


@_query("SELECT user_id AS chain, min(event_id) FILTER (event_id % 1000 = 7) AS broken_at, count(*) FILTER (event_id % 1000 = 7) = 0 AS ok FROM events GROUP BY user_id")
def q_audit_verify(spark, sf_dir):
    """The first altered row of each chain, after the details of some rows were altered."""
    log = _audit_log(spark, sf_dir)
    altered = log.withColumn("details", F.when(F.col("id") % 1000 == 7, F.concat("details", F.lit("!"))).otherwise(F.col("details")))
    return workflow.audit_breaks(altered, ["chain"]).select("chain", "broken_at", "ok")


_ITEMS = """SELECT event_id AS id, user_id AS job_id, (['queued','processing','done','processing'])[1 + event_id % 4] AS status, (event_id % 5)::INT AS attempts,
CASE WHEN event_id % 4 IN (1, 3) THEN value ELSE NULL END AS lease_until, 'https://b.example/' || event_id AS source_url, NULL AS error FROM events"""


def _items(spark, sf_dir):
    states = F.array(*map(F.lit, ["queued", "processing", "done", "processing"]))
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"),
        F.when((F.col("event_id") % 4).isin(1, 3), F.col("value")).alias("lease_until"), F.concat(F.lit("https://b.example/"), "event_id").alias("source_url"),
        F.lit(None).cast("string").alias("target_url"), F.lit(None).cast("string").alias("error"),
    )


@_query(
    f"""WITH i AS ({_ITEMS}), f AS (SELECT id FROM i WHERE status = 'queued' OR (status = 'processing' AND lease_until < 50) ORDER BY id LIMIT 20)
SELECT id, CASE WHEN f.id IS NULL THEN status ELSE 'processing' END AS status, (attempts + CASE WHEN f.id IS NULL THEN 0 ELSE 1 END)::INT AS attempts, CASE WHEN f.id IS NULL THEN lease_until ELSE 1850.0 END AS lease_until, f.id IS NOT NULL AS claimed
FROM i LEFT JOIN f USING (id)"""
)
def q_job_claim(spark, sf_dir):
    """The queue after twenty items are claimed."""
    return jobs.claim(_items(spark, sf_dir), 50.0, 20).select("id", "status", "attempts", "lease_until", "claimed")


@_query(
    f"""WITH i AS ({_ITEMS}), o AS (SELECT *, (['done','transient','permanent','verification_failed'])[1 + (id // 4) % 4] AS outcome FROM i),
s AS (SELECT *, CASE WHEN status <> 'processing' THEN status WHEN attempts > 3 THEN 'failed' WHEN outcome IN ('done', 'verification_failed') THEN outcome WHEN outcome = 'permanent' OR attempts >= 3 THEN 'failed' ELSE 'queued' END AS new FROM o)
SELECT id, new AS status, CASE WHEN status = 'processing' AND new <> 'queued' THEN NULL ELSE source_url END AS source_url,
CASE WHEN status <> 'processing' THEN NULL WHEN attempts > 3 THEN 'Reintentos agotados' ELSE 'e' END AS error FROM s"""
)
def q_job_finish(spark, sf_dir):
    """The queue after every item in work ended somehow."""
    items = _items(spark, sf_dir)
    kinds = F.array(*map(F.lit, ["done", "transient", "permanent", "verification_failed"]))
    outcomes = items.select("id", F.element_at(kinds, (F.floor(F.col("id") / 4) % 4 + 1).cast("int")).alias("outcome"), F.lit("e").alias("error"))
    return jobs.finish(items, outcomes).select("id", "status", "source_url", "error")


@_query(f"WITH i AS ({_ITEMS}) SELECT job_id, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status IN ('queued', 'processing')) = 0 AS finished FROM i GROUP BY job_id")
def q_job_counts(spark, sf_dir):
    return jobs.job_counts(_items(spark, sf_dir)).select("job_id", "queued", "done", "finished")


@_query("SELECT page_id FROM pages WHERE regexp_extract(lower(url), '^(https?)://([^/:?#]+)', 2) = 'm.ththth.example.net'")
def q_allowed_hosts(spark, sf_dir):
    return jobs.allowed(_t(spark, sf_dir, "pages"), ["m.ththth.example.net"], "url").select("page_id")


# sheets, pages and words


def _sheet(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    cells = c.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("H!A"), F.col("c_custkey") + 2).alias("location"), F.col("c_name").alias("text"))
    segments = c.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("H!B"), F.col("c_custkey") + 2).alias("location"), F.col("c_mktsegment").alias("text"))
    heads = c.select(F.col("c_nationkey").alias("doc_id"), F.lit("H!A1").alias("location"), F.lit("Nombre del reclamante").alias("text")).distinct()
    return cells.unionByName(segments).unionByName(heads)


@_query("SELECT c_nationkey AS doc_id, 'H!A' || (c_custkey + 2) AS location, 0 AS start, length(c_name)::INT AS \"end\", 'NOMBRE' AS entity_code, c_name AS text FROM customer")
def q_sheet_columns(spark, sf_dir):
    """Cells below a header that names a category."""
    return cell_rules.column_findings(_sheet(spark, sf_dir), TEXT_CODES).drop("score")


def _part_words(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ")).alias("idx", "text"))
    x0 = (F.col("idx") % 3) * 60.0
    y0 = F.floor(F.col("idx") / 3) * 20.0
    return p.select("doc_id", F.lit(1).alias("page"), "idx", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.length("text") * 5).alias("x1"), (y0 + 12).alias("y1"))


_PART_WORDS = """WITH w AS (SELECT doc_id, (i - 1)::INT AS idx, ws[i] AS text FROM (SELECT p_partkey AS doc_id, string_split(concat_ws(' ', p_name, p_brand, p_type), ' ') AS ws, unnest(range(1, len(string_split(concat_ws(' ', p_name, p_brand, p_type), ' ')) + 1)) AS i FROM part)),
b AS (SELECT *, (idx % 3) * 60.0 AS x0, (idx // 3) * 20.0 AS y0, (idx % 3) * 60.0 + length(text) * 5 AS x1 FROM w)"""


@_query(
    f"""{_PART_WORDS}, s AS (SELECT *, CASE WHEN idx = 0 THEN '' WHEN idx % 3 > 0 AND x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY idx) <= 36 THEN ' ' ELSE chr(10) END AS separator FROM b)
SELECT doc_id, idx, separator, (sum(length(separator) + length(text)) OVER (PARTITION BY doc_id ORDER BY idx) - length(text))::INT AS start FROM s"""
)
def q_page_texts(spark, sf_dir):
    """Words of a page as text: separators and offsets."""
    return geometry.page_texts(_part_words(spark, sf_dir)).select("doc_id", "idx", "separator", "start")


@_query(f"{_PART_WORDS} SELECT doc_id, idx FROM b WHERE idx % 2 = 1")
def q_uncovered_words(spark, sf_dir):
    """Words that a first reading, of every other word, doesn't cover."""
    words = _part_words(spark, sf_dir)
    return geometry.uncovered_words(words, words.filter("idx % 2 = 0")).select("doc_id", "idx")


@_query("SELECT case_, (SELECT count(*) FROM nation) = n AS same FROM (VALUES ('copy', (SELECT count(*) FROM nation)), ('twice a row', (SELECT count(*) + 1 FROM nation)), ('one changed', -1)) v(case_, n)")
def q_same_rows(spark, sf_dir):
    """Is a table the same multiset of rows as its copy, as one with a row twice, as one with a row changed?"""
    nation = _t(spark, sf_dir, "nation")
    one = F.col("n_nationkey") == 1
    others = {"copy": nation.repartition(3), "twice a row": nation.unionAll(nation.filter(one)), "one changed": nation.withColumn("n_name", F.when(one, "x").otherwise(F.col("n_name")))}
    return spark.createDataFrame([(k, workflow.same_rows(nation, v)) for k, v in others.items()], "case_ string, same boolean")


QUERIES.update(forms.QUERIES | reviews.QUERIES)
SQL.update(forms.SQL | reviews.SQL)
