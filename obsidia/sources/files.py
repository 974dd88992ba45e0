"""Files as tables: bytes, text blocks, spreadsheet cells and archive entries."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import PAGED_FORMATS, TEXT_FORMATS

#: Largest file, archive in all, and pages, by default.
MAX_FILE = 200 * 1024 * 1024
MAX_ARCHIVE = 500 * 1024 * 1024
MAX_PAGES = 500
_ALIASES = {"jpeg": "jpg", "tif": "tiff"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BLOCKS = "path string, ord int, location string, text string, error_code string"


def format_of(path):
    """A path's format: its suffix in lower case, jpeg and tif by their other names."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for p in _ALIASES.items() for x in p])[suffix], suffix)


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """path, name, format, length, sha256, content, error_code of all files below a path.

    Files beyond the size are listed without content and with an error; the
    condition on length reaches the source, which then doesn't read them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    fmt = format_of(name)
    small = files.filter(F.col("length") <= max_bytes).select("path", name.alias("name"), fmt.alias("format"), "length", F.sha2("content", 256).alias("sha256"), "content")
    small = small.withColumn("error_code", F.when(~F.col("format").isin(*PAGED_FORMATS, "tiff", *TEXT_FORMATS, "zip"), "UNSUPPORTED_FORMAT"))
    none = lambda kind: F.lit(None).cast(kind)
    large = files.filter(F.col("length") > max_bytes).select("path", name.alias("name"), fmt.alias("format"), "length", none("string").alias("sha256"), none("binary").alias("content"), F.lit("TOO_LARGE").alias("error_code"))
    return small.unionByName(large)


def decode_text(content):
    """Bytes as UTF-8 if they are, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def text_blocks(files: DataFrame) -> DataFrame:
    """path, ord, location, text, error_code of txt, docx and xlsx files; one row a block.

    Text files are decoded in Spark; Office files, which are archives of XML, in
    Python, a file at a time. A broken file is one row with CORRUPT_FILE.
    """
    plain = files.filter((F.col("format") == "txt") & F.col("content").isNotNull()).select("path", F.lit(0).alias("ord"), F.lit("txt").alias("location"), decode_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error_code"))
    office = files.filter(F.col("format").isin("docx", "xlsx") & F.col("content").isNotNull()).select("path", "format", "content")

    def run(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                try:
                    found = list((docx_blocks if r.format == "docx" else xlsx_cells)(r.content))
                    out = [(r.path, i, at, text, None) for i, (at, text) in enumerate(found)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError):
                    out = [(r.path, 0, None, None, "CORRUPT_FILE")]
                yield pd.DataFrame(out, columns=["path", "ord", "location", "text", "error_code"])

    return plain.unionByName(office.mapInPandas(run, BLOCKS))


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    try:
        root = ET.fromstring(archive.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {r.get("Id"): (r.get("Target") if r.get("Target", "").startswith("/") else f"{folder}/{r.get('Target')}").lstrip("/") for r in root.iter(f"{_RELS}Relationship")}


#: Names of the parts of a section, in order.
_SECTION_PARTS = {("header", "default"): "header", ("footer", "default"): "footer", ("header", "first"): "first_header", ("footer", "first"): "first_footer", ("header", "even"): "even_header", ("footer", "even"): "even_footer"}


def docx_parts(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(prefix of locations, file) of a docx: the body, then each section's headers and footers, which sections may share."""
    main = ET.fromstring(archive.read("word/document.xml"))
    relations = _relations(archive, "word/document.xml")
    parts = [("body", "word/document.xml")]
    for k, section in enumerate(main.iter(f"{_W}sectPr")):
        own = {(kind, r.get(f"{_W}type", "default")): relations.get(r.get(f"{_R}id")) for kind in ("header", "footer") for r in section.iter(f"{_W}{kind}Reference")}
        parts += [(f"{name}/{k}", own[key]) for key, name in _SECTION_PARTS.items() if own.get(key)]
    return parts


def docx_paragraphs(part: bytes) -> tuple[ET.Element, list[list[ET.Element]]]:
    """The tree of a part and the text elements of each of its paragraphs."""
    root = ET.fromstring(part)
    body = root.find(f"{_W}body")
    return root, [list(p.iter(f"{_W}t")) for p in (root if body is None else body).iter(f"{_W}p")]


def docx_blocks(content: bytes):
    """(location, text) of paragraphs with text: body, then each section's headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for prefix, name in docx_parts(archive):
            for i, runs in enumerate(docx_paragraphs(archive.read(name))[1]):
                if runs:
                    yield f"{prefix}/p/{i}", "".join(t.text or "" for t in runs)


def xlsx_sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the sheets of an xlsx, in order."""
    relations = _relations(archive, "xl/workbook.xml")
    return [(sheet.get("name"), relations[sheet.get(f"{_R}id")]) for sheet in ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet")]


def shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ET.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_S}si")]


def cell_text(cell: ET.Element, shared: list[str]) -> str | None:
    """The string that a cell holds; None for numbers, dates and the like."""
    value, kind = cell.findtext(f"{_S}v"), cell.get("t")
    if kind == "s" and value is not None:
        return shared[int(value)]
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    return value if kind == "str" else None


def xlsx_cells(content: bytes):
    """(Sheet!A1, text) of cells with text that is not blank, in order of rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = shared_strings(archive)
        for name, part in xlsx_sheets(archive):
            for cell in ET.fromstring(archive.read(part)).iter(f"{_S}c"):
                text = cell_text(cell, shared)
                if text and text.strip():
                    yield f"{name}!{cell.get('r')}", text


def archive_entries(files: DataFrame, max_bytes: int = MAX_ARCHIVE, max_file: int = MAX_FILE) -> DataFrame:
    """path, entry, format, length, content, error_code of the files in zip files.

    Folders, hidden entries and resource forks are left out; unsupported formats
    and what is beyond the sizes, as really unpacked, have an error instead of
    content. Entries are handed on one by one.
    """
    supported = {*PAGED_FORMATS, *TEXT_FORMATS}

    def run(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                left = max_bytes
                try:
                    archive = zipfile.ZipFile(io.BytesIO(r.content))
                except zipfile.BadZipFile:
                    yield _entry(r.path, None, None, None, "CORRUPT_FILE")
                    continue
                for info in archive.infolist():
                    name = info.filename
                    if info.is_dir() or name.rpartition("/")[2].startswith(".") or name.startswith("__MACOSX"):
                        continue
                    suffix = (re.search(r"\.([A-Za-z0-9]+)$", name) or [None, ""])[1].lower()
                    if suffix not in supported:
                        yield _entry(r.path, name, suffix, None, "UNSUPPORTED_FORMAT")
                        continue
                    most = min(left, max_file)
                    try:
                        with archive.open(info) as f:
                            content = f.read(most + 1)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                        yield _entry(r.path, name, suffix, None, "CORRUPT_FILE")
                        continue
                    if len(content) > most:
                        yield _entry(r.path, name, suffix, None, "TOO_LARGE")
                        continue
                    left -= len(content)
                    yield _entry(r.path, name, _ALIASES.get(suffix, suffix), content, None)

    zips = files.filter((F.col("format") == "zip") & F.col("content").isNotNull()).select("path", "content")
    return zips.mapInPandas(run, "path string, entry string, format string, length long, content binary, error_code string")


def _entry(path, name, fmt, content, error) -> pd.DataFrame:
    return pd.DataFrame([(path, name, fmt, None if content is None else len(content), content, error)], columns=["path", "entry", "format", "length", "content", "error_code"]).astype({"length": "Int64"})


def page_errors(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """doc_id, error_code of documents with more pages than allowed (0: any number)."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("doc_id", F.when((F.lit(most) > 0) & (F.col("n") > most), "TOO_MANY_PAGES").alias("error_code"))


def needs_ocr(text):
    """Does a page's text layer have fewer than 30 letters and digits?"""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) < 30


def read_profile(spark: SparkSession, path: str) -> dict:
    """A rule profile: names, reference_sequences, header_tokens, paragraph_rules, completion_groups; lists, or it fails."""
    schema = "names array<string>, reference_sequences array<array<string>>, header_tokens array<string>, paragraph_rules array<struct<tokens:array<string>,field:string,corrections:map<string,string>>>, completion_groups array<array<string>>"
    row = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path).first()
    return {k: v or [] for k, v in (row.asDict(recursive=True) if row else {}).items()}
