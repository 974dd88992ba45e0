"""Treated documents and reports as files."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import cell_text, docx_paragraphs, docx_parts, shared_strings, xlsx_sheets

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Properties of a package that name people, firms or subjects, and its parts that hold properties.
_PROPERTIES = re.compile(rb"(<((?:dc|cp|vt)?:?(?:creator|lastModifiedBy|title|subject|keywords|description|category|Manager|Company|HyperlinkBase|lpwstr))(?:\s[^>]*)?>)[^<]*(</\2>)")
_PROPERTY_PARTS = ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml")
_MAILTO = re.compile(rb'Target="\s*mailto:[^"]*"', re.I)
_Spans = dict[str, list[tuple[int, int, str]]]


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """A report as CSV with a header; with `files`, in at most so many parts."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_texts(blocks: DataFrame, path: str) -> None:
    """A folder a document (doc_id=...) with its text in order, UTF-8; documents are dealt by id."""
    text = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("value"))
    text.repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(path)


def _rewritten(content: bytes, part: Callable[[str, bytes], bytes]) -> bytes:
    """A package with its parts rewritten; links to mail addresses are neutralised, and properties blanked."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            data = old.read(info)
            if info.filename.endswith(".rels"):
                data = _MAILTO.sub(b'Target="about:blank"', data)
            elif info.filename in _PROPERTY_PARTS:
                data = _PROPERTIES.sub(rb"\1\3", data)
            else:
                data = part(info.filename, data)
            new.writestr(info.filename, data)
    return out.getvalue()


def _xml(root: ET.Element, data: bytes) -> bytes:
    """A tree as XML, with the prefixes of its source."""
    for _, (name, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        ET.register_namespace(name, uri)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def replaced(text: str, todo: list[tuple[int, int, str]]) -> str:
    """A text with spans (start, end, new) replaced."""
    for start, end, new in sorted(todo, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def spliced_docx(content: bytes, spans: _Spans) -> bytes:
    """A docx with spans (start, end, new) replaced in body, headers and footers, over all runs that they touch.

    Sections that share a header have one location each for it; a part takes the
    spans of the first location that has any, as they are the same.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        prefixes: dict[str, list[str]] = {}
        for prefix, name in docx_parts(archive):
            prefixes.setdefault(name, []).append(prefix)

    def part(name: str, data: bytes) -> bytes:
        if name not in prefixes:
            return data
        root, paragraphs = docx_paragraphs(data)
        changed = False
        for i, runs in enumerate(paragraphs):
            todo = next((own for prefix in prefixes[name] if (own := spans.get(f"{prefix}/p/{i}"))), [])
            for start, end, text in sorted(todo, reverse=True):
                changed = True
                at, new = 0, text
                for run in runs:
                    own = run.text or ""
                    s, e = max(start - at, 0), min(end - at, len(own))
                    if s < e:
                        run.text, new = own[:s] + new + own[e:], ""
                        run.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                    at += len(own)
        return _xml(root, data) if changed else data

    return _rewritten(content, part)


def spliced_xlsx(content: bytes, spans: _Spans) -> bytes:
    """An xlsx with spans (start, end, new) of cells replaced; such a cell holds its text itself from then on.

    Shared strings that no cell refers to any more are emptied, so a replaced
    value doesn't stay in the package. Formulas of replaced cells go with their
    cached values.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared, sheets = shared_strings(archive), {part: name for name, part in xlsx_sheets(archive)}
        trees: dict[str, ET.Element] = {}
        used: set[int] = set()
        for part, name in sheets.items():
            trees[part] = ET.fromstring(archive.read(part))
            for cell in trees[part].iter(f"{_S}c"):
                todo, text = spans.get(f"{name}!{cell.get('r')}"), cell_text(cell, shared)
                if todo and text is not None:
                    for child in list(cell):
                        cell.remove(child)
                    cell.set("t", "inlineStr")
                    new = ET.SubElement(ET.SubElement(cell, f"{_S}is"), f"{_S}t")
                    new.text = replaced(text, todo)
                    new.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                elif cell.get("t") == "s":
                    used.add(int(cell.findtext(f"{_S}v")))

    def part(name: str, data: bytes) -> bytes:
        if name in trees:
            return _xml(trees[name], data)
        if name == "xl/sharedStrings.xml":
            root = ET.fromstring(data)
            for k, item in enumerate(root.iter(f"{_S}si")):
                if k not in used:
                    for child in list(item):
                        item.remove(child)
                    ET.SubElement(item, f"{_S}t")
            return _xml(root, data)
        return data

    return _rewritten(content, part)


#: Formats that can be written back.
SPLICERS = {"docx": spliced_docx, "xlsx": spliced_xlsx}


def treated_files(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """path, content, error_code of docx and xlsx files after their replacements (path, location, start, end, new).

    Files without replacements lose links to mail addresses and properties too.
    A file is written by the task that reads it; a broken one has CORRUPT_FILE.
    """
    listed = replacements.groupBy("path").agg(F.collect_list(F.struct("location", "start", "end", "new")).alias("todo"))
    joined = files.filter(F.col("format").isin(*SPLICERS) & F.col("content").isNotNull()).select("path", "format", "content").join(listed, "path", "left")

    def run(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                spans: _Spans = {}
                for t in r.todo if r.todo is not None else []:
                    spans.setdefault(t["location"], []).append((t["start"], t["end"], t["new"]))
                try:
                    done = (r.path, SPLICERS[r.format](r.content, spans), None)
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError):
                    done = (r.path, None, "CORRUPT_FILE")
                yield pd.DataFrame([done], columns=["path", "content", "error_code"])

    return joined.mapInPandas(run, "path string, content binary, error_code string")


def treated_docx(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """path, content of docx files after their replacements; see treated_files()."""
    return treated_files(files.filter(F.col("format") == "docx"), replacements).select("path", "content")


def docx_metadata(files: DataFrame) -> DataFrame:
    """path, name, value of a docx's properties that a verification wants empty."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(r.content)) as archive:
                    core = archive.read("docProps/core.xml") if "docProps/core.xml" in archive.namelist() else b""
                out += [(r.path, m[1].decode(), m[2].decode()) for m in re.finditer(rb"<(dc:creator|cp:lastModifiedBy|dc:title)(?:\s[^>]*)?>([^<]*)<", core)]
            yield pd.DataFrame(out, columns=["path", "name", "value"])

    return files.filter(F.col("format") == "docx").select("path", "content").mapInPandas(run, "path string, name string, value string")


def batch_zip(documents: DataFrame) -> DataFrame:
    """batch_id, names, notice: what a batch's archive holds; documents with warnings are named in the notice."""
    ready = documents.filter(F.col("status").isin("protected", "protected_with_warnings"))
    return ready.groupBy("batch_id").agg(
        F.array_sort(F.collect_list("name")).alias("names"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "protected_with_warnings", F.col("name")))), "\n").alias("notice"),
    )


def batch_archives(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """batch_id, content: a zip of each batch's finished files, with a notice that names those with warnings.

    documents: doc_id, batch_id, name, status; contents: doc_id, content. Names
    that repeat get a number. A batch's files meet in one task, as they do in
    one archive; the caller's upload limits bound them.
    """
    ready = documents.filter(F.col("status").isin("protected", "protected_with_warnings")).select("doc_id", "batch_id", "name", "status")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, seen = io.BytesIO(), {}
        rows = rows.sort_values(["name", "doc_id"])
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            warned = []
            for r in rows.itertuples(index=False):
                seen[r.name] = seen.get(r.name, 0) + 1
                stem, dot, suffix = r.name.rpartition(".")
                name = r.name if seen[r.name] == 1 else f"{stem or suffix}-{seen[r.name]}{dot}{suffix if stem else ''}"
                archive.writestr(zipfile.ZipInfo(name), bytes(r.content))
                warned += [name] if r.status == "protected_with_warnings" else []
            if warned:
                archive.writestr(zipfile.ZipInfo(NOTICE), "\n".join(warned) + "\n")
        return pd.DataFrame([(rows["batch_id"].iloc[0], out.getvalue())], columns=["batch_id", "content"])

    joined = ready.join(contents.select("doc_id", "content"), "doc_id")
    return joined.groupBy("batch_id").applyInPandas(run, f"batch_id {dict(documents.dtypes)['batch_id']}, content binary")


#: The file of an archive that names documents to be looked at again.
NOTICE = "ADVERTENCIAS.txt"
