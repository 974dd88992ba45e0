"""Normal forms of text, as expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import MISREAD_AT

#: Look-alikes that are read as the character before the colon; lengths stay.
LOOK_ALIKES = {
    " ": "\u00a0\u2007\u2009\u200a\u202f",
    "@": "\uff20\ufe6b\u24d0",
    ".": "\uff0e\u2024",
    "-": "\u2010\u2011\u2012\u2013\u2014\u2212\uff0d",
}


def canonical(text: Column) -> Column:
    """Text with look-alikes replaced one for one, so offsets stay those of the original."""
    return F.translate(text, "".join(LOOK_ALIKES.values()), "".join(k * len(v) for k, v in LOOK_ALIKES.items()))


def repair_at(text: Column) -> Column:
    """Text of a scan with misread at signs set right."""
    return F.regexp_replace(text, f"(?U){MISREAD_AT}", "@")


@cache
def _accented() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and their bases."""
    found = []
    for n in range(0xC0, sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000:
            continue
        base = [x for x in unicodedata.normalize("NFD", chr(n)) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != chr(n):
            found.append((chr(n), base[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def strip_marks(text: Column) -> Column:
    """Text without accents, in lower case; a text of ASCII alone has none, and the table is dear."""
    bare = F.regexp_replace(F.translate(text, *_accented()), r"\p{Mn}+", "")
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(bare))


#: Characters of ASCII that no normal form holds.
_PARTING = "".join(c for c in map(chr, range(128)) if not re.match("[a-z0-9@]", c))


def norm_soft(text: Column) -> Column:
    """Only a-z, 0-9 and @ of the text without accents, with one space between stretches.

    Patterns are dear by their matches, so most characters are replaced one by one.
    """
    parted = F.translate(strip_marks(text), _PARTING, " " * len(_PARTING))
    return F.btrim(F.regexp_replace(F.regexp_replace(parted, r"[^\x00-\x7f]+", " "), " {2,}", " "))


def norm(text: Column) -> Column:
    """The same without the spaces."""
    return norm_of_soft(norm_soft(text))


_OTHER = re.compile("[^a-z0-9@]+")


def norm_of_soft(soft: Column) -> Column:
    """norm() of a text whose norm_soft() is at hand."""
    return F.replace(soft, F.lit(" "), F.lit(""))


def plain_strip(text: str) -> str:
    """strip_marks() of a Python string."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def plain_norm(text: str) -> str:
    return _OTHER.sub("", plain_strip(text))


def plain_soft(text: str) -> str:
    return _OTHER.sub(" ", plain_strip(text)).strip()


_CANON = str.maketrans({x: k for k, v in LOOK_ALIKES.items() for x in v})


def plain_canonical(text: str) -> str:
    return text.translate(_CANON)
