"""Detection on one Python string: what detect() runs on each text, and what readers of pages run."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from datetime import date as calendar_date

from ..catalog import PRIORITY
from .names import NameFinder
from .normalize import plain_canonical
from .patterns import DETECTORS, OBSCURED_HOST, TRAILING

_COMPILED = [(d, re.compile(d.pattern, re.I if d.ignore_case else 0)) for d in DETECTORS]
_WEIGHTS = (2, 3, 4, 5, 6, 7)
_RANK = {c: i for i, c in enumerate(PRIORITY)}


def valid_rut(value: str) -> bool:
    compact = re.sub("[^0-9kK]", "", value).upper()
    body, check = compact[:-1], compact[-1:]
    if len(compact) < 8 or not body.isdigit() or int(body) >= 50_000_000:
        return False
    total = sum(int(d) * _WEIGHTS[i % 6] for i, d in enumerate(body[::-1]))
    return "0K987654321"[total % 11] == check


def valid_luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdecimal()][::-1]
    return len(digits) >= 13 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def valid_phone(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    if digits.startswith("56") and len(digits) > 9:
        return True
    years = re.fullmatch(r"(?:19|20)\d\d(?:19|20)\d\d", digits)
    return not ("\n" in value.strip() or years or re.fullmatch(r"\s*\d{4}-\d{4}\s*", value))


def valid_plate(value: str) -> bool:
    return not re.sub("[^A-Z0-9]", "", value.upper()).startswith("DE")


def valid_date(value: str) -> bool:
    if m := re.fullmatch(r"\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\s*", value):
        day, month, year = m.groups()
        if len(year) == 3:
            return False
        try:
            return 1900 <= calendar_date(int(year) + 2000 * (len(year) == 2), int(month), int(day)).year <= 2100
        except ValueError:
            return False
    m = re.match(r"\s*(\d{1,2})\s+de\s+", value, re.I)
    return m is None or 1 <= int(m[1]) <= 31


_CHECKS = {"rut": valid_rut, "luhn": valid_luhn, "phone": valid_phone, "plate": valid_plate, "date": valid_date}


#: What else than lower() ignoring case takes for a Latin letter.
_FOLDED = str.maketrans({"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"})


def _lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDED).lower()


def _has(*words: str) -> Callable[[str, str], bool]:
    return lambda text, low: any(w in low for w in words)


def _finds(pattern: str) -> Callable[[str, str], bool]:
    search = re.compile(pattern).search
    return lambda text, low: search(text) is not None


def _all(*tests: Callable[[str, str], bool]) -> Callable[[str, str], bool]:
    return lambda text, low: all(t(text, low) for t in tests)


#: By place in DETECTORS, what a text (and the same in lower case) of a match has: found far faster than the pattern.
_GUARDS = {
    "EMAIL": [_has("@"), _all(_has("@", "(", "[", "arroba"), _finds("(?i)" + OBSCURED_HOST))],
    "WEB_REDES": [_has("@", "://", "www.")],
    "RUT": [_finds(r"\d{3}\s*-?\s*[\dkK]")],
    "IP": [_finds(r"\d\.\d{1,3}\.\d{1,3}\.\d")],
    "TARJETA": [_finds(r"\d{4}[\s-]?\d{4}[\s-]?\d{4}")],
    "CUENTA_BANCARIA": [_all(_has("cuenta", "cta"), _finds(r"\d[\d\s.-]{5,22}\d"))],
    "PASAPORTE": [_has("pasaporte")],
    "FOLIO": [_all(_has("folio", "expediente", "exp.", "ingreso", "rol", "de"), _finds(r"\d[\d.\-/]{2}"))],
    "FECHA_NACIMIENTO": [_has("nac")],
    "TELEFONO": [_finds(r"\d{3}[\s.-]?\d{4}"), _all(_has("fono", "celular"), _finds(r"\d{7}"))],
    "PATENTE": [_finds(r"[A-Z]{2}[.\-\s]?\d\d")],
    "DIRECCION": [_all(_has("av", "calle", "pasaje", "pje", "camino", "ruta", "callej", "diagonal", "alameda", "parcela", "lote", "km"), _finds(r"\d"))],
    "FECHA": [_finds(r"\d[/.-]\d{1,2}[/.-]\d|\d\s+[dD][eE]\s")],
}
_nth = Counter()
_GUARDED = []
for _d, _p in _COMPILED:
    _GUARDED.append((_d, _p, _GUARDS[_d.code][_nth[_d.code]]))
    _nth[_d.code] += 1


class Disjoint:
    """Spans that don't overlap, in order; a further one is compared with its neighbour only."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.spans[at - 1][1] > start

    def add(self, span: tuple[int, int, str]) -> None:
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.spans.insert(at, span)


def detect_spans(text: str, codes: Iterable[str], names: NameFinder | None = None) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, code) of a text, in order; a pattern runs where its guard holds, and time is nearly linear in the spans."""
    wanted, canonical = codes if isinstance(codes, frozenset) else frozenset(codes), plain_canonical(text)
    low = _lowered(canonical)
    found: list[tuple[int, int, str]] = []
    for d, pattern, guard in _GUARDED:
        if d.code not in wanted or not guard(canonical, low):
            continue
        strict = Disjoint()
        if d.fallback:
            for span in (s for s in found if s[2] == d.code):
                strict.add(span)
        for m in pattern.finditer(canonical):
            if d.check and not _CHECKS[d.check](m[d.group]):
                continue
            start = m.start(d.group)
            end = start + len(m[d.group].rstrip(TRAILING))
            if not strict.meets(start, end):
                found.append((start, end, d.code))
    if "NOMBRE" in wanted:
        found += [(s, e, "NOMBRE") for s, e in dict.fromkeys((names or NameFinder()).spans(canonical))]
    if len(found) < 2:
        return found
    taken = Disjoint()
    for s, e, c in sorted(found, key=lambda x: (_RANK.get(x[2], 99), x[0], x[0] - x[1])):
        if not taken.meets(s, e):
            taken.add((s, e, c))
    return taken.spans
