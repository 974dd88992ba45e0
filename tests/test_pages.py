"""Words with boxes, and files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from obsidia.functions.names import FIRST_NAMES, SURNAMES, NameFinder
from obsidia.operators import geometry as g
from obsidia.operators import layout, paged
from obsidia.operators.detect import detect, findings
from obsidia.sources import files, sinks


def line(text, y=100, x=10, h=30):
    out = []
    for token in text.split():
        width = max(9 * len(token), 9)
        out.append(layout.Word(token, x, y, x + width, y + h))
        x += width + 8
    return out


READER = layout.PageReader(NameFinder(FIRST_NAMES, SURNAMES | {"schneider"}))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Sr. Oliva destaca que este proyecto representa una oportunidad", "Oliva"),
        ("Sr. Felipe Muñoz consulta sobre el convenio con la universidad", "Felipe Muñoz"),
        ("Srta. Clara Soto, felicita a los expositores", "Clara Soto"),
        ("Sr. Juan de la Cruz explica la propuesta", "Juan de la Cruz"),
        ("Don Florian Mauricio Schneider Pérez, para estos efectos", "Florian Mauricio Schneider Pérez"),
        ("Sr. Pedro Pérez de la comuna presenta antecedentes", "Pedro Pérez"),
    ],
)
def test_names_end_before_the_sentence(text, expected):
    words = line(text)
    found = [f for f in READER.read(words, 2000, 2400, ["NOMBRE"]) if f.code == "NOMBRE"]
    assert [f.text for f in found] == [expected]
    assert found[0].boxes == tuple(w.box for w in words[1 : 1 + len(expected.split())])


@pytest.mark.parametrize(("text", "expected"), [("Sr. josé gómez informa que se revisará", "josé gómez"), ("Sr. J. Pérez explica los antecedentes", "J Pérez"), ("Sr. Carlos López y González presenta antecedentes", "Carlos López y González"), ("Señor y dueño de todo", None), ("Sr. Ministro Juan Pérez", None)])
def test_titles(text, expected):
    assert [f.text for f in READER.after_titles(layout.Page(line(text)))] == ([expected] if expected else [])


def test_layout_rules():
    roles = line("Ana M üller Soto jueza titular")
    roles[2] = roles[2]._replace(x0=roles[1].x1, x1=roles[1].x1 + 45)
    roles[3] = roles[3]._replace(x0=roles[2].x1 + 8, x1=roles[2].x1 + 44)
    roles[4] = roles[4]._replace(x0=roles[3].x1 + 8, x1=roles[3].x1 + 60)
    assert [f.text for f in READER.before_roles(layout.Page(roles))] == ["Ana Müller Soto"]
    assert [f.text for f in READER.labelled_ids(layout.Page(line("RUT 12.345.678-9 otro")))] == ["12.345.678-9"]
    assert READER.labelled_ids(layout.Page(line("RUT 76.543.210-3"))) == []
    page = line("Residencia", 100, 400) + line("Los Pinos 123 Talca", 150, 400) + line("sin numero", 200, 400)
    assert [f.text for f in READER.residences(layout.Page(page))] == ["Los Pinos 123"]
    page = line("en calle Los Aromos", 100) + line("N° 45, oficina 3", 140)
    assert [f.text for f in READER.wrapped_streets(layout.Page(page))] == ["calle Los Aromos N° 45 oficina 3"]
    page = line("comer", 100, 300) + line("cializadora Juan", 140, 300)
    company = layout.Finding("NOMBRE", "cializadora Juan", tuple(w.box for w in page[1:]), 0.7)
    assert READER.plausible(layout.Page(page), [company]) == []
    short, full = layout.Finding("NOMBRE", "Ana", ((0, 0, 5, 5),), 0.7), layout.Finding("NOMBRE", "Ana Soto", ((0, 0, 20, 5),), 0.7)
    assert READER.plausible(layout.Page([]), [short, full, layout.Finding("NOMBRE", "Motor 3", ((50, 0, 60, 5),), 0.7)]) == [full]


def test_repeated_and_configured_names():
    first, second = line("Paula Sahr Henríquez firma"), line("PAULASAHR HENRIQUEZ y") + line("otra PAULA SAHR HENRÍQUEZ.", 300)
    found = [(1, layout.Finding("NOMBRE", "Paula Sahr Henríquez", tuple(w.box for w in first[:3]), 0.7))]
    again = layout.repeated_values([(1, first), (2, second)], found)
    assert [(n, f.text) for n, f in again] == [(2, "PAULA SAHR HENRÍQUEZ"), (2, "PAULASAHR HENRIQUEZ")] or {n for n, _ in again} == {2}
    names = layout.exact_names([(1, line("El Señor Zeta Beta")), (2, line("Gama vive; zeta no, Zeta sí"))], ["Zeta Beta Gama", "Zeta"])
    assert [(n, f.text, f.score) for n, f in names] == [(1, "Zeta Beta", 1.0), (2, "Gama", 1.0), (2, "Zeta", 1.0)]
    assert layout.has_reference(line("Oficio número 12 de"), [["numero", "12"]]) and not layout.has_reference(line("x"), [["y"], []])
    full = [(n, layout.Finding("NOMBRE", "Miguel Aravena Angulo", ((0, 0, 1, 1),), 0.7)) for n in (1, 2)]
    found = layout.abbreviated_names([(3, 1000, line("MIG ARAVENA ANGULO"))], full, FIRST_NAMES)
    assert [(n, f.text, f.score) for n, f in found] == [(3, "MIG ARAVENA ANGULO", 0.82)]


def test_sequences_of_a_second_reading():
    words = line("Oficio Ordinario, Número 12 Señor Juán Sotto Vega vive en Calle Uno")
    assert [w.text for w in layout.reread_header(words, ["oficio", "ordinario"])] == ["Oficio", "Ordinario,"]
    assert layout.reread_header(words, ["otro"]) == [] == layout.reread_header(words, [])
    rules = [{"tokens": ["juan", "sotto", "vega"], "field": "name", "corrections": {"1": "Soto"}}, {"tokens": ["calle", "uno"], "field": "address", "corrections": {}}]
    first, second = line("nada Juán Sotto Vega"), line("Juan Sotto Vega y Calle Uno. Calle Uno")
    got = layout.reread_paragraphs([first, second, line("Calle Uno")], rules, [["name", "address"]])
    assert [w.text for w in got] == ["Juán", "Soto", "Vega", "Calle", "Uno."] and got[0].box == first[1].box
    assert layout.reread_paragraphs([first, second], rules, [["name"]]) == [first[1], first[2]._replace(text="Soto"), first[3]]


def test_pages_as_tables(spark):
    word = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
    rows = [(1, 1, 2000.0, 2400.0, [tuple([w.text, *map(float, w.box)]) for w in line("Sr. Felipe Muñoz consulta; correo a@b.cl")], None), (1, 2, 2000.0, 2400.0, [tuple([w.text, *map(float, w.box)]) for w in line("vino FELIPE MUÑOZ ayer")], None), (2, 1, 10.0, 10.0, [], None), (3, 1, 10.0, 10.0, None, None)]
    pages = spark.createDataFrame(rows, f"doc_id long, page int, width double, height double, words {word}, verification_words {word}")
    codes = ["NOMBRE", "EMAIL"]
    assert sorted((r.page, r.entity_code, r.text) for r in paged.read_pages(pages, codes).collect()) == [(1, "EMAIL", "a@b.cl"), (1, "NOMBRE", "Felipe Muñoz"), (2, "NOMBRE", "FELIPE MUÑOZ")]
    got = paged.read_documents(pages, codes, ["consulta"]).collect()
    assert {(r.page, r.text) for r in got} >= {(1, "Felipe Muñoz"), (2, "FELIPE MUÑOZ"), (1, "a@b.cl"), (1, "consulta")}
    words = pages.select("doc_id", "page", F.posexplode("words").alias("idx", "w")).select("doc_id", "page", "idx", "w.*")
    texts = {}
    for r in g.page_texts(words).orderBy("doc_id", "page", "idx").collect():
        texts[r.doc_id, r.page] = texts.get((r.doc_id, r.page), "") + r.separator + r.text
        assert len(texts[r.doc_id, r.page]) == r.end
    assert texts[1, 2] == layout.Page(line("vino FELIPE MUÑOZ ayer")).text()[0]


def test_gaps_boxes_and_decisions(spark):
    rows = [(1, 1, "ab", 0.0, float(y), 10.0, y + 10.0, 1000.0) for y in (300, 312, 360, 372, 500, 512)]
    words = spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, page_height double")
    assert [(r.top, r.bottom) for r in g.gap_regions(words).collect()] == [(318, 363)]
    row = spark.range(1).select(
        g.ocr_decision(F.lit("sin ancla"), F.lit(100), F.lit(0), F.lit(9.0)).alias("a"), g.ocr_decision(F.lit("el Rut es"), F.lit(100), F.lit(0), F.lit(9.0)).alias("b"),
        g.ocr_decision(F.lit("x"), F.lit(100), F.lit(12), F.lit(9.0)).alias("c"), g.ocr_decision(F.lit("x"), F.lit(100), F.lit(1), F.lit(5.5)).alias("d"),
        files.needs_ocr(F.lit("áé" * 15)).alias("e"), files.needs_ocr(F.lit("a " * 29)).alias("f"),
    ).first()
    assert tuple(row) == (False, True, True, True, False, True)
    boxes = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 5.0, 7.0, 0, 100.0, 200.0, 200.0, 400.0), (10.0, 20.0, 30.0, 40.0, 5.0, 7.0, 90, 100.0, 200.0, 200.0, 400.0)], "x0 double, top double, x1 double, bottom double, origin_x double, origin_y double, rotate int, page_width double, page_height double, image_width double, image_height double")
    assert [(r.px0, r.py0, r.px1, r.py1) for r in g.to_pixels(boxes).collect()] == [(10, 54, 51, 95), (6, 50, 47, 91)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


DOCX_PARTS = (
    {
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Rut 12.3</w:t></w:r><w:r><w:t>45.678-5 fin</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>dos</w:t></w:r></w:p><w:sectPr><w:headerReference w:type="default" r:id="r1"/></w:sectPr></w:body></w:document>',
        "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>cabecera</w:t></w:r></w:p></w:hdr>",
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="header1.xml"/><Relationship Id="r2" Target="mailto:a@b.cl" TargetMode="External"/></Relationships>',
        "docProps/core.xml": "<p><dc:creator>Ana</dc:creator><dc:title></dc:title></p>",
    }
)
DOCX = archive(DOCX_PARTS)
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX_PARTS = (
    {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Hoja" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Folio</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row><row><c r="A2" t="inlineStr"><is><t>77-1</t></is></c><c r="B2" t="inlineStr"><is><t> </t></is></c></row></sheetData></worksheet>',
    }
)
XLSX = archive(XLSX_PARTS)


def test_files(spark, tmp_path):
    for name, data in {"a.txt": "ñandú".encode(), "b.TXT": "ñandú".encode("latin-1"), "c.docx": DOCX, "d.xlsx": XLSX, "e.docx": b"broken", "f.exe": b"x", "g.zip": archive({"x/h.txt": b"hola", "__MACOSX/y.txt": b"", ".hid.txt": b"", "z.bin": b"1", "big.txt": b"0" * 50})}.items():
        (tmp_path / name).write_bytes(data)
    read = files.read_files(spark, str(tmp_path))
    assert {r.name: r.error_code for r in read.select("name", "error_code").collect()} == {"a.txt": None, "b.TXT": None, "c.docx": None, "d.xlsx": None, "e.docx": None, "f.exe": "UNSUPPORTED_FORMAT", "g.zip": None}
    blocks = {(r.path[-6:], r.location): (r.text, r.error_code) for r in files.text_blocks(read).collect()}
    assert blocks == {
        ("/a.txt", "txt"): ("ñandú", None), ("/b.TXT", "txt"): ("ñandú", None), ("c.docx", "body/p/0"): ("Rut 12.345.678-5 fin", None), ("c.docx", "body/p/2"): ("dos", None), ("c.docx", "header/0/p/0"): ("cabecera", None),
        ("d.xlsx", "Hoja!A1"): ("Folio", None), ("d.xlsx", "Hoja!A2"): ("77-1", None), ("e.docx", None): (None, "CORRUPT_FILE"),
    }
    entries = {r.entry: (r.length, r.error_code) for r in files.archive_entries(read, max_bytes=20).collect()}
    assert entries == {"x/h.txt": (4, None), "z.bin": (None, "UNSUPPORTED_FORMAT"), "big.txt": (None, "TOO_LARGE")}
    assert {r.name for r in files.read_files(spark, str(tmp_path), 10).filter("error_code = 'TOO_LARGE'").collect()} == {"c.docx", "d.xlsx", "g.zip"}
    path = read.filter("name = 'c.docx'").first().path
    todo = spark.createDataFrame([(path, "body/p/0", 4, 16, "[RUT]")], "path string, location string, start int, end int, new string")
    done = sinks.treated_docx(read.filter("name = 'c.docx'"), todo).first()
    assert dict(files.docx_blocks(bytes(done.content)))["body/p/0"] == "Rut [RUT] fin"
    with zipfile.ZipFile(io.BytesIO(done.content)) as z:
        assert b"mailto" not in z.read("word/_rels/document.xml.rels") and b"Ana" not in z.read("docProps/core.xml")
    assert {(r.name, r.value) for r in sinks.docx_metadata(read.filter("name = 'c.docx'")).collect()} == {("dc:creator", "Ana"), ("dc:title", "")}


def test_treated_office_files_hold_nothing_of_what_was_replaced(spark, tmp_path):
    """Body, a header that two sections share, shared and inline strings, properties: written, read back, searched."""
    two = DOCX_PARTS | {
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Rut 12.3</w:t></w:r><w:r><w:t>45.678-5 fin</w:t></w:r></w:p><w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="r1"/></w:sectPr></w:pPr></w:p><w:sectPr><w:headerReference w:type="default" r:id="r1"/></w:sectPr></w:body></w:document>',
        "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>de ana@b</w:t></w:r><w:r><w:t>.cl hoy</w:t></w:r></w:p></w:hdr>",
        "docProps/app.xml": "<Properties><Company>Ana SpA</Company><Manager>Ana</Manager><Pages>1</Pages></Properties>",
    }
    sheet = XLSX_PARTS | {"xl/sharedStrings.xml": f"<sst {S}><si><t>ana@b.cl</t></si><si><t>Folio</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><v>5</v></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>Rut 12.345.678-5</t></is></c></row></sheetData></worksheet>'}
    for name, data in {"a.docx": archive(two), "b.xlsx": archive(sheet), "c.xlsx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    read = files.read_files(spark, str(tmp_path))
    blocks = files.text_blocks(read).filter("error_code IS NULL")
    found = findings(detect(blocks, ["RUT", "EMAIL"]), ["path", "location"]).withColumn("new", F.concat(F.lit("["), "entity_code", F.lit("]")))
    done = sinks.treated_files(read, found.select("path", "location", "start", "end", "new"))
    rows = {r.path[-6:]: r for r in done.collect()}
    assert rows["c.xlsx"].error_code == "CORRUPT_FILE" and rows["c.xlsx"].content is None
    assert dict(files.docx_blocks(bytes(rows["a.docx"].content))) == {"body/p/0": "Rut [RUT] fin", "header/0/p/0": "de [EMAIL] hoy", "header/1/p/0": "de [EMAIL] hoy"}
    assert dict(files.xlsx_cells(bytes(rows["b.xlsx"].content))) == {"Hoja!A1": "Folio", "Hoja!A2": "[EMAIL]", "Hoja!B2": "Rut [RUT]"}
    for r in (rows["a.docx"], rows["b.xlsx"]):
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            assert not any(word in z.read(n) for n in z.namelist() for word in (b"ana@b", b"45.678", b"Ana", b"mailto"))


def test_batch_archives(spark):
    docs = spark.createDataFrame([(1, 7, "a.txt", "protected"), (2, 7, "a.txt", "protected_with_warnings"), (3, 7, "b", "failed"), (4, 8, "c.txt", "protected")], "doc_id int, batch_id int, name string, status string")
    contents = spark.createDataFrame([(i, bytes([i])) for i in range(1, 5)], "doc_id int, content binary")
    got = {}
    for r in sinks.batch_archives(docs, contents).collect():
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            got[r.batch_id] = {n: z.read(n) for n in z.namelist()}
    assert got == {7: {"a.txt": b"\x01", "a-2.txt": b"\x02", sinks.NOTICE: b"a-2.txt\n"}, 8: {"c.txt": b"\x04"}}


def test_reports_and_texts(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc_id int, ord int, text string")
    sinks.write_texts(blocks, str(tmp_path / "t"))
    assert {(r.doc_id, r.value) for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect()} == {(1, "a\nb\n"), (2, "c\n")}
    sinks.write_csv(blocks, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    docs = spark.createDataFrame([(1, "x", "protected"), (1, "y", "protected_with_warnings"), (1, "z", "failed")], "batch_id int, name string, status string")
    assert tuple(sinks.batch_zip(docs).first()) == (1, ["x", "y"], "y")
    profile = tmp_path / "p.json"
    profile.write_text('{"names": ["Ana"], "completion_groups": [["a", "b"]]}')
    assert files.read_profile(spark, str(profile)) == {"names": ["Ana"], "reference_sequences": [], "header_tokens": [], "paragraph_rules": [], "completion_groups": [["a", "b"]]}
    pages = spark.createDataFrame([(1,), (1,), (2,)], "doc_id int")
    assert {(r.doc_id, r.error_code) for r in files.page_errors(pages, 1).collect()} == {(1, "TOO_MANY_PAGES"), (2, None)}
