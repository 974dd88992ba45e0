"""Queries over texts and pages that are made from table columns, so that every category has values to find, and their DuckDB SQL.

A text is one SQL expression that Spark and DuckDB read alike; what is to be
found in it is another one, and the rows where that holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import BLOCK
from ..operators import paged, workflow
from ..operators.detect import TEXT_CODES, detect, findings
from ..operators.groups import dealt
from ..operators.propagate import propagate
from ..operators.score import recall
from ..operators.treat import treat_spans

_FIRST, _LAST = "split_part('Juan,Maria,Pedro,Ana,Luis', ',', CAST(1 + k % 5 AS INT))", "split_part('Soto,Rojas,Vega,Torres', ',', CAST(1 + k % 4 AS INT))"
_PAD = "lpad(CAST({0} AS STRING), {1}, '0')"

#: category: text, value, condition of the rows (k: order, c: customer) whose text holds the value.
FORMS = {
    "FOLIO": ("CASE WHEN k % 7 = 0 THEN 'Folio sin numero ' || k ELSE 'Ingresa por mesa; Folio N° ' || (2000 + k % 30) || '-' || k || ' hoy' END", "(2000 + k % 30) || '-' || k", "k % 7 <> 0"),
    "CUENTA_BANCARIA": ("CASE WHEN k % 5 = 0 THEN 'cuenta corriente N° 12345' ELSE 'pago a la cuenta corriente N° ' || (100000000 + k) || ' del banco' END", "CAST(100000000 + k AS STRING)", "k % 5 <> 0"),
    "PASAPORTE": (f"CASE WHEN k % 6 = 0 THEN 'Pasaporte N° AB12 vencido' ELSE 'pasaporte N° P' || {_PAD.format('k', 7)} || ' vigente' END", f"'P' || {_PAD.format('k', 7)}", "k % 6 <> 0"),
    "FECHA_NACIMIENTO": ("CASE WHEN k % 4 = 0 THEN 'nacido en Talca, 1980' ELSE 'nacida el ' || (1 + k % 28) || '/' || (1 + k % 12) || '/' || (1950 + k % 60) || ' en Talca' END", "(1 + k % 28) || '/' || (1 + k % 12) || '/' || (1950 + k % 60)", "k % 4 <> 0"),
    "FECHA": (
        f"'emitida el ' || {_PAD.format('1 + k % 31', 2)} || '/' || {_PAD.format('1 + k % 12', 2)} || '/' || (1850 + k % 200) || ' en Talca'",
        f"{_PAD.format('1 + k % 31', 2)} || '/' || {_PAD.format('1 + k % 12', 2)} || '/' || (1850 + k % 200)",
        f"1850 + k % 200 >= 1900 AND try_cast((1850 + k % 200) || '-' || {_PAD.format('1 + k % 12', 2)} || '-' || {_PAD.format('1 + k % 31', 2)} AS DATE) IS NOT NULL",
    ),
    "TELEFONO": ("CASE WHEN k % 8 = 0 THEN 'periodo 2013 2017 y siguientes' ELSE 'llamar al +56 9 ' || (1000 + k % 9000) || ' ' || (1000 + c % 9000) || ' en horario' END", "'+56 9 ' || (1000 + k % 9000) || ' ' || (1000 + c % 9000)", "k % 8 <> 0"),
    "PATENTE": (f"CASE WHEN k % 9 = 0 THEN 'Santiago, DE ' || (2000 + k % 30) ELSE 'vehiculo ' || substr('BCDFGHJKLPRSTVWXYZ', CAST(1 + k % 15 AS INT), 4) || '-' || {_PAD.format('k % 100', 2)} || ' azul' END", f"substr('BCDFGHJKLPRSTVWXYZ', CAST(1 + k % 15 AS INT), 4) || '-' || {_PAD.format('k % 100', 2)}", "k % 9 <> 0"),
    "DIRECCION": ("CASE WHEN k % 3 = 0 THEN 'vive en la avenida' ELSE 'domicilio en Av. Los Pinos ' || (1 + k % 9000) || CASE WHEN k % 2 = 0 THEN ', comuna de Talca' ELSE '' END || '.' END", "'Av. Los Pinos ' || (1 + k % 9000) || CASE WHEN k % 2 = 0 THEN ', comuna de Talca' ELSE '' END", "k % 3 <> 0"),
    "NOMBRE": (f"CASE WHEN k % 6 = 0 THEN 'El Ministerio de Hacienda informa' ELSE 'comparece don ' || {_FIRST} || ' ' || {_LAST} || ' y firma' END", f"{_FIRST} || ' ' || {_LAST}", "k % 6 <> 0"),
    "EMAIL": ("CASE WHEN k % 2 = 0 THEN 'reunion at oficina.com hoy' ELSE 'escribir a u' || k || ' arroba correo.cl' END", "'u' || k || ' arroba correo.cl'", "k % 2 <> 0"),
    "WEB_REDES": ("CASE WHEN k % 5 = 0 THEN 'usuario s' || k || ' sin pagina' ELSE 'ver https://s' || k || '.example.cl/p?id=1 hoy' END", "'https://s' || k || '.example.cl/p?id=1'", "k % 5 <> 0"),
    "IP": ("'desde 10.' || (k % 300) || '.0.' || (c % 250) || ' a las nueve'", "'10.' || (k % 300) || '.0.' || (c % 250)", "k % 300 < 256"),
}
_ORDERS = "SELECT o_orderkey AS k, o_custkey AS c FROM orders"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    # a small file of keys is one task, of which texts would be made and read
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")))
    return orders.select(F.col("k").alias("doc_id"), F.expr(text).alias("text"))


def _register_form(code: str) -> None:
    text, value, holds = FORMS[code]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = findings(detect(_rows(spark, sf_dir, text), [code]), ["doc_id"])
        return found.select("doc_id", "start", "end", F.col("text").alias("value"))

    name = f"q_form_{code.lower()}"
    QUERIES[name] = query
    # the value stands once in its text
    SQL[name] = f"""WITH o AS ({_ORDERS}), f AS (SELECT k AS doc_id, {text} AS text, {value} AS value FROM o WHERE {holds})
SELECT doc_id, (strpos(text, value) - 1)::INT AS start, (strpos(text, value) - 1 + length(value))::INT AS "end", value FROM f"""


for _code in FORMS:
    _register_form(_code)


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_LINES = ("FOLIO", "NOMBRE", "FECHA_NACIMIENTO", "WEB_REDES", "IP", "PASAPORTE")
_LETTER = " || chr(10) || ".join(f"({FORMS[c][0]})" for c in _LINES)
_LETTER_VALUES = " UNION ALL ".join(f"SELECT k AS doc_id, '{c}' AS entity_code, {FORMS[c][1]} AS value FROM o WHERE {FORMS[c][2]}" for c in _LINES)


@_query(f"WITH o AS ({_ORDERS}) {_LETTER_VALUES}")
def q_detect(spark, sf_dir):
    """All categories of letters of several lines, overlaps resolved by priority."""
    found = findings(detect(_rows(spark, sf_dir, _LETTER), set(TEXT_CODES) - {"FECHA", "TELEFONO"}), ["doc_id"])
    return found.select("doc_id", "entity_code", F.col("text").alias("value"))


@_query(f"""WITH o AS ({_ORDERS}), f AS (SELECT k, {FORMS["FOLIO"][0]} AS text, {FORMS["FOLIO"][1]} AS value FROM o)
SELECT k AS doc_id, CASE WHEN k % 7 = 0 THEN text ELSE replace(text, value, regexp_replace(value, '\\S', '{BLOCK}', 'g')) END AS treated FROM f""")
def q_form_redact(spark, sf_dir):
    """Texts with their values redacted."""
    return treat_spans(detect(_rows(spark, sf_dir, FORMS["FOLIO"][0]), ["FOLIO"]), "redact").select("doc_id", "treated")


@_query(f"""WITH o AS ({_ORDERS}), f AS (SELECT k, {FORMS["FOLIO"][1]} AS value FROM o WHERE k % 7 <> 0)
SELECT k AS doc_id, 'l/1' AS location, 6 AS start, (6 + length(value))::INT AS "end", 'FOLIO' AS entity_code, value AS text FROM f WHERE length(value) >= 6
UNION ALL SELECT k, 'l/1', (15 + length(value))::INT, (15 + 2 * length(value))::INT, 'FOLIO', value FROM f WHERE length(value) >= 6""")
def q_propagate(spark, sf_dir):
    """Found values at their other places: twice in another line of the same document."""
    first = _rows(spark, sf_dir, FORMS["FOLIO"][0]).withColumns({"ord": F.lit(0), "location": F.lit("l/0")})
    second = _rows(spark, sf_dir, f"'segun ' || {FORMS['FOLIO'][1]} || ' y (ver) ' || {FORMS['FOLIO'][1]} || '.'").withColumns({"ord": F.lit(1), "location": F.lit("l/1")})
    blocks = first.unionByName(second)
    return propagate(blocks, findings(detect(blocks.filter("ord = 0"), ["FOLIO"]), ["doc_id", "location"])).drop("score")


@_query(f"""WITH o AS ({_ORDERS})
SELECT k AS doc_id, 'FOLIO' AS entity_code, (CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END)::BIGINT AS hits, (CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS missed, 0::BIGINT AS extra FROM o""")
def q_recall(spark, sf_dir):
    """Found values against known ones: one a document, of half of them another one that no text holds."""
    found = findings(detect(_rows(spark, sf_dir, FORMS["FOLIO"][0]), ["FOLIO"]), ["doc_id"]).select("doc_id", F.col("start").alias("ord"), "entity_code", "text")
    known = _rows(spark, sf_dir, FORMS["FOLIO"][1]).select("doc_id", F.lit(0).alias("ord"), F.lit("FOLIO").alias("entity_code"), "text")
    more = known.filter("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("ord"), "entity_code", F.lit("zz-none").alias("text"))
    return recall(known.unionByName(more), found)


_EVENTS = """SELECT user_id AS chain, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth,
concat_ws('|', strftime(ts, '%Y-%m-%dT%H:%M:%S'), user_id::VARCHAR, CASE WHEN event_id % 2 = 0 THEN '192.0.2.1' ELSE 'None' END, event_type, props) AS said FROM events"""


@_query(f"""WITH RECURSIVE e AS ({_EVENTS}), c AS (
SELECT chain, id, nth, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || said) AS hash FROM e WHERE nth = 1
UNION ALL SELECT e.chain, e.id, e.nth, c.hash, sha256(c.hash || '|' || e.said) FROM c JOIN e ON e.chain = c.chain AND e.nth = c.nth + 1)
SELECT chain, id, prev_hash, hash FROM c""")
def q_audit_chain(spark, sf_dir):
    """Events of each user chained by hash."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("chain"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("user_id").cast("string").alias("username"),
        F.when(F.col("event_id") % 2 == 0, "192.0.2.1").alias("ip"), F.col("event_type").alias("event"), F.col("props").alias("details"),
    )
    return workflow.chain_events(events).select("chain", "id", "prev_hash", "hash")


#: Lines of a page: left edge, top, text.
_PAGE_LINES = [
    (10, 100, f"'Sr. ' || {_FIRST} || ' ' || {_LAST} || ' consulta sobre el convenio'"),
    (10, 200, "'Ana Vega jueza titular'"),
    (10, 300, "'RUT 12.' || lpad(CAST(k % 1000 AS STRING), 3, '0') || '.678-' || (k % 10)"),
    (10, 400, "'en calle Los Aromos'"),
    (10, 440, "'N° ' || (1 + k % 900) || ', oficina 3'"),
    (400, 600, "'Residencia'"),
    (400, 650, "'Los Pinos ' || (1 + k % 700) || ' Talca'"),
    (400, 700, "'sin numero'"),
]


def _page_words(text: str, x: int, y: int):
    tokens = F.split(F.expr(text), " ")
    left = lambda i: F.lit(float(x)) + F.length(F.array_join(F.slice(tokens, F.lit(1), i), "")) * 9 + i * 8
    return F.transform(tokens, lambda t, i: F.struct(t.alias("text"), left(i).cast("double").alias("x0"), F.lit(float(y)).alias("y0"), (left(i) + F.length(t) * 9).cast("double").alias("x1"), F.lit(y + 30.0).alias("y1")))


@_query(f"""WITH o AS (SELECT c_custkey AS k FROM customer)
SELECT k AS doc_id, 1 AS page, 'NOMBRE' AS entity_code, {_FIRST} || ' ' || {_LAST} AS text, 0.88::DOUBLE AS score FROM o
UNION ALL SELECT k, 1, 'NOMBRE', 'Ana Vega', 0.85::DOUBLE FROM o
UNION ALL SELECT k, 1, 'DIRECCION', 'calle Los Aromos N° ' || (1 + k % 900) || ' oficina 3', 0.88::DOUBLE FROM o
UNION ALL SELECT k, 1, 'DIRECCION', 'Los Pinos ' || (1 + k % 700), 0.88::DOUBLE FROM o
UNION ALL SELECT k, 1, 'RUT', '12.' || lpad(CAST(k % 1000 AS STRING), 3, '0') || '.678-' || (k % 10), 0.0::DOUBLE FROM o""")
def q_pages(spark, sf_dir):
    """Findings by layout: a title, a role, a labelled id whatever its check character, a street over two lines, a column of addresses."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    words = F.concat(*[_page_words(text, x, y) for x, y, text in _PAGE_LINES])
    word = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
    pages = customers.select(F.col("k").alias("doc_id"), F.lit(1).alias("page"), F.lit(2000.0).alias("width"), F.lit(2400.0).alias("height"), words.cast(word).alias("words"), F.lit(None).cast(word).alias("verification_words"))
    found = paged.read_documents(pages, ["NOMBRE", "DIRECCION", "RUT"])
    # an id's score tells whether its check character fits
    return found.select("doc_id", "page", "entity_code", "text", F.when(F.col("entity_code") == "RUT", 0.0).otherwise(F.col("score")).alias("score"))
