"""Golden spans, and Spark's detection against the plain one."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsidia.catalog import BLOCK, ENTITIES
from obsidia.functions.names import FIRST_NAMES, SURNAMES, NameFinder
from obsidia.functions.normalize import plain_canonical, plain_norm, plain_soft, plain_strip, repair_at
from obsidia.functions.plain import detect_spans, valid_date, valid_luhn, valid_phone, valid_plate, valid_rut
from obsidia.functions.spans import matches
from obsidia.functions.validators import CHECKS
from obsidia.operators.detect import TEXT_CODES, detect, findings
from obsidia.operators.treat import mask_partial, replacement, treat_spans

FIRST = FIRST_NAMES | frozenset("leopoldo adelita jean william michelle nathalie pablina yanet".split())
LAST = SURNAMES | frozenset("huenchuman paillalef catrileo antilef huenchuleo oyarzun prueba ejemplo".split())
ALL = "Solicitud de don Juan Pérez González, RUT 12.345.678-5, domicilio Av. Providencia 1234, Depto 56, Providencia, correo jperez@example.test, teléfono +56 9 8765 4321, nacido el 04/05/1980, patente BCDF-12, IP 10.0.0.7, pasaporte N° AB123456, cuenta corriente N° 12345678901, folio 2026-001234, tarjeta 4111 1111 1111 1111, www.ejemplo.cl."

#: text, codes, spans (code, value) in order.
CASES = [
    (
        ALL, TEXT_CODES,
        [("NOMBRE", "Juan Pérez González"), ("RUT", "12.345.678-5"), ("DIRECCION", "Av. Providencia 1234, Depto 56, Providencia"), ("EMAIL", "jperez@example.test"), ("TELEFONO", "+56 9 8765 4321"), ("FECHA_NACIMIENTO", "04/05/1980"),
         ("PATENTE", "BCDF-12"), ("IP", "10.0.0.7"), ("PASAPORTE", "AB123456"), ("CUENTA_BANCARIA", "12345678901"), ("FOLIO", "2026-001234"), ("TARJETA", "4111 1111 1111 1111"), ("WEB_REDES", "www.ejemplo.cl")],
    ),
    ("Subsecretaría de Telecomunicaciones, Ministerio de Hacienda, RUT 12.345.678-9.", TEXT_CODES, []),
    ("soporte@example. test", ["EMAIL"], [("EMAIL", "soporte@example. test")]),
    ("ver soporte @example.test / fin", ["EMAIL"], [("EMAIL", "soporte @example.test")]),
    ("soporte@\nexample.test", ["EMAIL"], [("EMAIL", "soporte@\nexample.test")]),
    ("soporte arroba example.test", ["EMAIL"], [("EMAIL", "soporte arroba example.test")]),
    ("soporte (at) example.test", ["EMAIL"], [("EMAIL", "soporte (at) example.test")]),
    ("soporte＠example.test", ["EMAIL"], [("EMAIL", "soporte＠example.test")]),
    ("Punto 3 .\ncontacto@example.test fin", ["EMAIL"], [("EMAIL", "contacto@example.test")]),
    ("Nos juntamos at google.com el lunes", ["EMAIL"], []),
    ("ventas(M empresa.cl, contacto", ["EMAIL"], [("EMAIL", "ventas(M empresa.cl")]),
    ("RUT 12.345.678‑5 y j．perez＠ejemplo．cl.", ["RUT", "EMAIL"], [("RUT", "12.345.678‑5"), ("EMAIL", "j．perez＠ejemplo．cl")]),
    ("Ver https://o.example.test/oferta?id=\n8841 antes", ["WEB_REDES"], [("WEB_REDES", "https://o.example.test/oferta?id=\n8841")]),
    ("Visite www.ejemplo.cl\nSantiago", ["WEB_REDES"], [("WEB_REDES", "www.ejemplo.cl")]),
    ("sigue a @usuario_1 hoy", ["WEB_REDES"], [("WEB_REDES", "@usuario_1")]),
    ("EXPERIENCIA\n2023\n2013 Diseñadora", ["TELEFONO"], []),
    ("Período 2022 2018 en la empresa", ["TELEFONO"], []),
    ("Fono (2) 2123 4567", ["TELEFONO"], [("TELEFONO", "(2) 2123 4567")]),
    ("Teléfono: 09-8123456", ["TELEFONO"], [("TELEFONO", "09-8123456")]),
    ("09-8123456, 2013-2017", ["TELEFONO"], []),
    ("Cédula 11.111.111-\n1", ["RUT"], [("RUT", "11.111.111-\n1")]),
    ("RUT 12 345 678-5", ["RUT"], [("RUT", "12 345 678-5")]),
    ("Proveedor RUT 76.543.210-3", ["RUT"], []),
    ("FECHA 15 DE SEPTIEMBRE DE\n2025; patentes AB.1234 y BCDF.12; DE 2025.", ["FECHA", "PATENTE"], [("FECHA", "15 DE SEPTIEMBRE DE\n2025"), ("PATENTE", "AB.1234"), ("PATENTE", "BCDF.12")]),
    ("ruido 02.01.001 y 31.02.2004", ["FECHA"], []),
    ("el 29/02/2024 y el 29/02/2023 y 1-1-99", ["FECHA"], [("FECHA", "29/02/2024"), ("FECHA", "1-1-99")]),
    ("Causa Rol C-1234-2020; Causa Rol C-1235-2020", ["FOLIO", "TELEFONO"], [("FOLIO", "C-1234-2020"), ("FOLIO", "C-1235-2020")]),
    ("Cuenta corriente N” 1234567890\nPasaporte N* PTEST1234", ["CUENTA_BANCARIA", "PASAPORTE"], [("CUENTA_BANCARIA", "1234567890"), ("PASAPORTE", "PTEST1234")]),
    ("Sr. Rene Ejemplo Prueba y Diego Prueba Ejemplo", ["NOMBRE"], [("NOMBRE", "Rene Ejemplo Prueba"), ("NOMBRE", "Diego Prueba Ejemplo")]),
    ("María Pérez y Juan Arriagada", ["NOMBRE"], [("NOMBRE", "María Pérez"), ("NOMBRE", "Juan Arriagada")]),
    ("José Ortega y Gasset", ["NOMBRE"], [("NOMBRE", "José Ortega y Gasset")]),
    ("Rayén Arriagada Huenchumán", ["NOMBRE"], [("NOMBRE", "Rayén Arriagada Huenchumán")]),
    ("Colegio Arriagada Vergara", ["NOMBRE"], []),
    ("Abogado Integrante Carlos Antonio Prueba E.", ["NOMBRE"], [("NOMBRE", "Carlos Antonio Prueba")]),
    ("Sr. Felipe Muñoz consulta sobre el convenio", ["NOMBRE"], [("NOMBRE", "Felipe Muñoz")]),
    ("Sr. Pedro Pérez de la comuna presenta", ["NOMBRE"], [("NOMBRE", "Pedro Pérez")]),
    ('caratulado "SCHNEIDER con INDUSTRIAS S.A."', ["NOMBRE"], [("NOMBRE", "SCHNEIDER")]),
    ("😀 RUT 12.345.678-5 😀", ["RUT"], [("RUT", "12.345.678-5")]),
    (None, TEXT_CODES, []),
    ("", TEXT_CODES, []),
]


def spark_spans(spark, texts, codes):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    out = detect(rows, codes, first_names=FIRST, surnames=LAST).orderBy("k").collect()
    return [[(s["start"], s["end"], s["code"]) for s in r.spans] for r in out]


def test_golden_spans(spark):
    by_codes = {}
    for text, codes, want in CASES:
        by_codes.setdefault(tuple(codes), []).append((text, want))
    for codes, cases in by_codes.items():
        for (text, want), spans in zip(cases, spark_spans(spark, [t for t, _ in cases], codes), strict=True):
            got = [(c, (text or "")[s:e]) for s, e, c in spans]
            assert got == want, text
            assert spans == detect_spans(text or "", codes, NameFinder(FIRST, LAST))


def test_documents_have_the_plain_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    finder = NameFinder()
    for r in detect(docs).collect():
        assert [(s["start"], s["end"], s["code"]) for s in r.spans] == detect_spans(r.text or "", TEXT_CODES, finder)


@pytest.fixture(scope="module")
def fuzz(spark):
    """Random strings made of what patterns look for, with both readings."""
    import random

    rng = random.Random(11)
    bits = ["12.345.678-5", "11.111.111", "-1", " ", "\n", "4111 1111", " 1111 1111", "10.0.0.7", "256.1.1.1", "a@b.cl", "@", "(at)", "arroba", "www.", "x.cl", "folio ", "N° ", "2020-1", "BCDF", "12", "Sr. ", "Juan ", "Pérez ", "y ", "31/12/1999", "fono ", "09-8123456", "+56 9 ", "8765 4321", ".", ",", "ñ", "Av. ", "Sol ", "123"]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(500)]


def test_random_texts_have_the_plain_spans(spark, fuzz):
    finder = NameFinder(FIRST, LAST)
    for text, spans in zip(fuzz, spark_spans(spark, fuzz, TEXT_CODES), strict=True):
        assert spans == detect_spans(text, TEXT_CODES, finder), repr(text)


def test_treated_texts(spark, fuzz):
    rows = spark.createDataFrame([(t,) for t in fuzz[:150]], "text string")
    found = detect(rows, first_names=FIRST, surnames=LAST)
    for r in treat_spans(found, "redact").collect():
        assert len(r.treated) == len(r.text)
        inside = {i for s in r.spans for i in range(s["start"], s["end"])}
        assert all(b == (BLOCK if i in inside and not a.isspace() else a) for i, (a, b) in enumerate(zip(r.text, r.treated, strict=True)))
    for r in treat_spans(found, "mask_full").collect():
        at, want = 0, ""
        for s in r.spans:
            want, at = want + r.text[at : s["start"]] + "********", s["end"]
        assert r.treated == want + r.text[at:]


def test_offsets_of_matches(spark):
    row = spark.range(1).select(matches(F.lit("aaXbaX"), "a+").alias("m"), matches(F.lit("k=12, k=3"), r"k=(\d+)", 1).alias("g"), matches(F.lit("zz"), "a").alias("n")).first()
    assert [(m["start"], m["end"]) for m in row.m] == [(0, 2), (4, 5)]
    assert [(m["start"], m["end"], m["value"]) for m in row.g] == [(2, 4, "12"), (8, 9, "3")] and row.n == []


def test_checks_agree(spark):
    plain = {"rut": valid_rut, "luhn": valid_luhn, "phone": valid_phone, "plate": valid_plate, "date": valid_date}
    values = {
        "rut": ["12.345.678-5", "12345678-9", "11.111.111-1", "7-1", "", "76.543.210-3", "20.000.003-K", "1.234.567-4", "k", "10.000.013-k"] + [f"9.{n}-{c}" for n in ("876.543", "123.456") for c in "0123456789kK"],
        "luhn": ["4111 1111 1111 1111", "4111 1111 1111 1112", "5500-0000-0000-0004", "1", "0000000000000"],
        "phone": ["+56 9 8765 4321", "2023\n2013", "2022 2018", "2861-2018", "9 8765 4321", "56912345678"],
        "plate": ["BCDF-12", "DE 2025", "AB1234"],
        "date": ["31.02.2004", "29/02/2024", "01/01/99", "02.01.001", "1-1-1899", "32 de enero de 2020", "3 de enero 2020", "0 de mayo de 2000", "31/12/2100", "1/1/2101"],
    }
    for name, texts in values.items():
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(CHECKS[name](F.col("v"))).collect()]
        assert got == [plain[name](t) for t in texts], name


def test_treatments(spark):
    row = spark.range(1).select(
        mask_partial(F.lit("12.345.678-5"), F.lit("RUT")).alias("rut"),
        *[mask_partial(F.lit(t), F.lit("NOMBRE")).alias(f"n{i}") for i, t in enumerate(["X", "Li", "Ana", "Luis", ""])],
        mask_partial(F.lit("(firma)"), F.lit("FIRMA")).alias("firma"),
        replacement(F.lit("a b"), F.lit("EMAIL"), "redact").alias("red"),
        replacement(F.lit("a"), F.lit("EMAIL"), "anonymize").alias("anon"),
        replacement(F.lit("a"), F.lit("NOMBRE"), "pseudonymize").alias("alias"),
        replacement(F.lit("a"), F.lit("RUT"), "mask_full").alias("full"),
    ).first()
    assert tuple(row) == ("12.3**.***-*", "*", "L*", "An*", "Lui*", "", "***", f"{BLOCK} {BLOCK}", "[CORREO]", "Persona-01", "********")
    with pytest.raises(ValueError):
        replacement(F.lit("a"), F.lit("RUT"), "other")


def test_findings_are_stable(spark):
    rows = spark.createDataFrame([(1, ALL)], "doc_id long, text string")
    once, again = (findings(detect(rows), ["doc_id"]).orderBy("start").collect() for _ in range(2))
    assert once == again and len({r.finding_id for r in once}) == len(once)
    assert all(r.text == ALL[r.start : r.end] for r in once) and {r.score for r in once} == {0.7, 0.8, 0.95}
    assert set(ENTITIES) - {r.entity_code for r in once} <= {"FECHA", "FIRMA"}


def test_misread_at_signs(spark):
    texts = [f"valentina.caso{x}example.test" for x in ("(W", "(a)", "(Q)", "(g", "[e]")] + ["suma (a) tres"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(repair_at(F.col("t"))).collect()]
    assert got == ["valentina.caso@example.test"] * 5 + ["suma (a) tres"]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_plain_normal_forms(text):
    assert len(plain_canonical(text)) == len(text)
    assert plain_soft(text).replace(" ", "") == plain_norm(text) and plain_strip(text) == plain_strip(plain_strip(text)).lower()
