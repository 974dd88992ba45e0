"""Findings of paged documents as tables: rules of a page, and values sought on all pages of a document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.names import FIRST_NAMES, SURNAMES, NameFinder
from .groups import map_groups
from .layout import PageReader, Place, Word, abbreviated_names, drop_parts, exact_names, merge_name, merge_reading, repeated_values

PAGE = ["doc_id", "page", "width", "height", "words", "verification_words"]
FINDING = ["doc_id", "page", "entity_code", "text", "score", "boxes"]
PAGE_FINDING = "doc_id {}, page int, entity_code string, text string, score double, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>"


def read_pages(pages: DataFrame, codes: Iterable[str], first_names: frozenset[str] = FIRST_NAMES, surnames: frozenset[str] = SURNAMES) -> DataFrame:
    """Findings of every page. pages: doc_id, page, width, height, words and verification_words (arrays of struct text, x0, y0, x1, y1; both may be null).

    A page is a row and is read alone, so no page waits for another and nothing
    is shuffled.
    """
    wanted, reader = set(codes), PageReader(NameFinder(first_names, surnames))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame(_rows([(r.doc_id, Place(r.page, f)) for r in rows.itertuples(index=False) for f in _page_findings(reader, r, wanted)]), columns=FINDING)

    return pages.select(*PAGE).mapInPandas(run, PAGE_FINDING.format(dict(pages.dtypes)["doc_id"]))


def read_documents(pages: DataFrame, codes: Iterable[str], names: list[str] = (), first_names: frozenset[str] = FIRST_NAMES, surnames: frozenset[str] = SURNAMES) -> DataFrame:
    """Findings of whole paged documents: pages, then values repeated over them, then configured names.

    The document is the unit, as values found on one page are sought on all; a
    document has at most the configured number of pages (500 by default).
    """
    wanted, reader, listed = set(codes), PageReader(NameFinder(first_names, surnames)), list(names)

    def run(rows: list[dict]) -> list[tuple]:
        rows = [SimpleNamespace(**r) for r in rows]
        first = [(r.page, _words(r.words)) for r in rows]
        found = [Place(r.page, f) for r in rows for f in _page_findings(reader, r, wanted)]
        found += repeated_values(first, found)
        readings = [(r.page, r.height, x) for r in rows for x in (_words(r.words), _words(r.verification_words)) if x]
        found += abbreviated_names(readings, found, first_names)
        by_page = {r.page: drop_parts([f for n, f in found if n == r.page]) for r in rows}
        for n, f in exact_names(first, listed) if "NOMBRE" in wanted else ():
            by_page[n] = merge_name(by_page[n], f)
        return _rows([(rows[0].doc_id, Place(n, f)) for n, own in by_page.items() for f in own])

    return map_groups(pages.select(*PAGE), ["doc_id"], ["page"], run, PAGE_FINDING.format(dict(pages.dtypes)["doc_id"]))


def _page_findings(reader: PageReader, page, wanted: set[str]) -> list:
    """Findings of the first reading of a page, and what a second adds."""
    found = reader.read(_words(page.words), page.width, page.height, wanted)
    again = _words(page.verification_words)
    return merge_reading(found, reader.read(again, page.width, page.height, wanted)) if again else found


def _words(rows) -> list[Word]:
    return [Word(w["text"], w["x0"], w["y0"], w["x1"], w["y1"]) for w in (rows if rows is not None else [])]


def _rows(places: list[tuple[object, Place]]) -> list[tuple]:
    boxes = lambda f: [dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True)) for b in f.boxes]
    return [(doc, n, f.code, f.text, f.score, boxes(f)) for doc, (n, f) in places]
