"""Findings that the layout of a page gives away.

A rule turns each word into a letter for what the word can be to it, lines the
words up beside an anchor, cuts them where a gap is too wide, and matches a
regular expression over the letters; page.run() does this for all rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np

from ..catalog import DEFAULT_SCORE, SCORES
from ..functions.names import INSTITUTION, PROSE, NameFinder
from ..functions.normalize import plain_norm, plain_soft, plain_strip
from ..functions.patterns import CAPITALISED
from ..functions.plain import detect_spans

PUNCTUATION = " ,.;:"
#: Titles before a name, connectors in one, and words that are none.
TITLES = frozenset("sr sra srta senor senora don dona ria".split())
CONNECTORS = frozenset("de del la las los y san santa da di van von".split())
OPEN_CONNECTORS = frozenset("de del la las los y".split())
NOT_A_NAME = INSTITUTION | PROSE | TITLES | frozenset(
    "abogado abogada profesional somete comunica rut cedula residencia oferente firma depto oficina piso bodega patente motor chasis modelo marca registros publicista periodista ingeniero "
    "ingeniera licenciado licenciada contacto formacion academica academico concejal concejala".split()
)
ROLES = frozenset("juez jueza notario notaria".split())
ROLE_QUALITIES = frozenset("civil penal laboral titular".split())
VEHICLE = frozenset("patente motor chasis modelo marca interno".split())
STREETS = frozenset("calle avenida avda av pasaje pje camino".split())
UNITS = frozenset("oficina of departamento depto piso casa local block".split())
NO_ADDRESS_LEAD = frozenset("rut monto articulo pagina n".split())
#: Scores of findings by layout.
SCORE_LABEL, SCORE_TITLE, SCORE_ROLE, SCORE_ROW, SCORE_ADDRESS, SCORE_REPEAT, SCORE_CUT, SCORE_FOOT = 0.82, 0.88, 0.85, 0.9, 0.88, 0.9, 0.82, 0.78
#: Fixed value: ids from here on are those of companies.
COMPANY_IDS = 50_000_000
_CAP = re.compile(CAPITALISED)
_LABELLED = re.compile(r"(?<!\d)\d{1,2}(?:\s*\.\s*\d{3}){2}\s*-\s*[\dkK](?!\d)")
_NUMBER_SIGN, _NUMBER, _UNIT_VALUE = re.compile(r"N\.?[°ºo.]", re.I), re.compile(r"\d{1,5}[,.;]?"), re.compile(r"[A-Za-z0-9-]{1,6}[,.;]?")
_NO_TITLE = {"senor": re.compile(r"y dueno\b"), "sr": re.compile(r"(?:a )?(?:ministro|secretario)")}

#: Over the letters of title_letters(): up to six words of a name, fewer where one ends by its punctuation or another word follows; a number after them undoes it.
_TITLED = re.compile(r"[wic]{0,5}[WC]|[wic]{6}|[wic]{0,5}(?![wicWC9])")
_ROLE = re.compile(r"n{2,4}")
#: One word of a line below, ended by a comma or before «y»; or two, the second ended so.
_WRAP_ONE, _WRAP_TWO = re.compile(r"S.|s[yY]"), re.compile(r"[sS]S")
_BELOW = re.compile(r"[ns]{0,2}")
#: From a word with letters to the last with digits.
_RESIDENCE = re.compile(r"[d-]*([ab].*[db]|b)")
_STREET = re.compile(r"A(n{1,5})#9(?=(Uu)?)")


class Word(NamedTuple):
    text: str
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self[1:]

    @property
    def bare(self) -> str:
        return self.text.strip(PUNCTUATION)


class Finding(NamedTuple):
    code: str
    text: str
    boxes: tuple
    score: float


#: Lines that a page keeps.
LINES = 256


class Page:
    """Words of a page with their boxes as arrays, so that a rule looks at all words at once."""

    def __init__(self, words: list[Word], width: float = float("inf"), height: float = float("inf")):
        self.words, self.width, self.height = words, width, height
        self.box = np.array([w.box for w in words], float).reshape(-1, 4)
        self.x0, self.y0, self.x1, self.y1 = self.box.T
        self.h = np.maximum(self.y1 - self.y0, 1)
        self.soft = [plain_soft(w.text) for w in words]
        self.key = [s.replace(" ", "") for s in self.soft]
        self.bare = [w.bare for w in words]
        self._lines: dict[int, np.ndarray] = {}

    def places(self, test: Callable[[str], bool]) -> list[int]:
        """Words whose soft form passes a test."""
        return [i for i, s in enumerate(self.soft) if test(s)]

    def on_line(self, i: int) -> np.ndarray:
        """Which words are on the line of word i: they share 35 % of the lower height, or centres lie within 45 % of the higher."""
        if i in self._lines:
            return self._lines[i]
        shared = np.minimum(self.y1, self.y1[i]) - np.maximum(self.y0, self.y0[i])
        centres = np.abs(self.y0 + self.y1 - self.y0[i] - self.y1[i]) / 2
        line = (shared >= 0.35 * np.minimum(self.h, self.h[i])) | (centres <= 0.45 * np.maximum(self.h, self.h[i]))
        if len(self._lines) < LINES:
            self._lines[i] = line
        return line

    def from_left(self, which: np.ndarray) -> list[int]:
        """The places of a mask's words from left to right."""
        at = np.flatnonzero(which)
        return at[np.argsort(self.x0[at], kind="stable")].tolist()

    def run(self, order: list[int], edge: float, gap: float, letter: Callable[[int], str], pattern: re.Pattern) -> list[int]:
        """The first words of an order whose letters a pattern matches, before a gap to the edge or to the word before."""
        starts, ends = self.x0[order], np.concatenate([[edge], self.x1[order[:-1]]]) if order else np.empty(0)
        wide = np.flatnonzero(starts - ends > gap)
        order = order[: wide[0]] if len(wide) else order
        m = pattern.match("".join(map(letter, order)))
        return order[: m.end()] if m else []

    def named(self, order: Iterable[int]) -> str:
        return " ".join(self.bare[i] for i in order).strip()

    def finding(self, code: str, order: Iterable[int], score: float | None = None, text: str | None = None) -> Finding:
        order = list(order)
        return Finding(code, self.named(order) if text is None else text, tuple(self.words[i].box for i in order), SCORES.get(code, DEFAULT_SCORE) if score is None else score)

    def text(self) -> tuple[str, np.ndarray]:
        """The page's text and, for each character, its word (-1: none): words of a line, three heights apart at most, are parted by a space."""
        # of all words at once, what on_line() says of a word and the one before it
        low, high = np.minimum(self.h[1:], self.h[:-1]), np.maximum(self.h[1:], self.h[:-1])
        shared = np.minimum(self.y1[1:], self.y1[:-1]) - np.maximum(self.y0[1:], self.y0[:-1])
        centres = np.abs(self.y0[:-1] + self.y1[:-1] - self.y0[1:] - self.y1[1:]) / 2
        near = (((shared >= 0.35 * low) | (centres <= 0.45 * high)) & (self.x0[1:] - self.x1[:-1] <= 3 * high)).tolist()
        out, owner = [], []
        for i, w in enumerate(self.words):
            if i:
                out.append(" " if near[i - 1] else "\n")
                owner.append(-1)
            out.append(w.text)
            owner += [i] * len(w.text)
        return "".join(out), np.array(owner, int)


def owners(owner: np.ndarray, start: int, end: int) -> list[int]:
    return [i for i in dict.fromkeys(owner[start:end].tolist()) if i >= 0]


def touching(boxes, others) -> np.ndarray:
    """For each box and each other, whether their insides meet."""
    a, b = np.array(list(boxes), float).reshape(-1, 1, 4), np.array(list(others), float).reshape(1, -1, 4)
    return (a[..., :2] < b[..., 2:]).all(axis=-1) & (b[..., :2] < a[..., 2:]).all(axis=-1)


def all_met(boxes, known) -> bool:
    return bool(touching(boxes, known).any(axis=1).all())


def merge_name(found: list[Finding], new: Finding) -> list[Finding]:
    """found with a name in place of those that it touches."""
    return [f for f in found if f.code != "NOMBRE" or not touching(f.boxes, new.boxes).any()] + [new]


def merge_reading(found: list[Finding], other: list[Finding]) -> list[Finding]:
    """found with those of another reading whose boxes aren't all met by the same category's."""
    out = list(found)
    for f in other:
        if not f.boxes or not all_met(f.boxes, [b for g in out if g.code == f.code for b in g.boxes]):
            out.append(f)
    return out


def drop_parts(found: list[Finding]) -> list[Finding]:
    """found without names of one word that a longer name touches."""
    size = [len(plain_soft(f.text).split()) if f.code == "NOMBRE" and f.boxes else 0 for f in found]
    long_boxes = [b for f, n in zip(found, size, strict=True) if n > 1 for b in f.boxes]
    return [f for f, n in zip(found, size, strict=True) if n != 1 or not touching(f.boxes, long_boxes).any()]


class PageReader:
    """Findings on one page, by text and by layout."""

    def __init__(self, names: NameFinder | None = None):
        self.names = names or NameFinder()
        self._known = self.names.first_names | self.names.surnames

    def read(self, words: list[Word], width: float, height: float, codes: Iterable[str]) -> list[Finding]:
        """All of a page: text first, then ids, names and addresses by layout; names by layout replace, extend or drop others."""
        page, codes = Page(words, width, height), set(codes) - {"FIRMA"}
        found = self.by_text(page, codes)
        if "RUT" in codes:
            found += self.labelled_ids(page, found)
        if "NOMBRE" in codes:
            for rule in (self.after_titles, self.before_roles, self.representatives):
                for new in rule(page, found):
                    found = merge_name(found, new)
            found = self.plausible(page, [self.wrapped(page, f) for f in found])
        if "DIRECCION" in codes:
            found = merge_reading(found, self.residences(page))
            found = merge_reading(found, self.wrapped_streets(page))
        return found

    def by_text(self, page: Page, codes: set[str]) -> list[Finding]:
        text, owner = page.text()
        out = []
        for start, end, code in detect_spans(text, codes, self.names):
            f = page.finding(code, owners(owner, start, end), text=text[start:end])
            if code == "EMAIL" and f.boxes:
                # readers of scans often cut an address's last box short
                x0, y0, x1, y1 = f.boxes[-1]
                f = f._replace(boxes=(*f.boxes[:-1], (x0, y0, min(page.width, x1 + int(max(y1 - y0, 1) * 1.8)), y1)))
            out.append(f)
        return out

    def labelled_ids(self, page: Page, found: list[Finding] = ()) -> list[Finding]:
        """Ids in the two words after the word RUT, whatever their check character."""
        known, out = [b for f in found if f.code == "RUT" for b in f.boxes], []
        for i in page.places("rut".__eq__):
            right = page.on_line(i) & (page.x0 >= page.x0[i]) & (page.x1 > page.x1[i]) & (page.x0 - page.x1[i] <= 6 * page.h[i])
            own = page.from_left(right)[:2]
            m = _LABELLED.search(" ".join(page.words[k].text for k in own))
            if m and int(re.sub(r"\D", "", m[0].rpartition("-")[0])) < COMPANY_IDS and not all_met(page.box[own], known):
                out.append(page.finding("RUT", own, SCORE_LABEL, m[0]))
                known += out[-1].boxes
        return out

    def title_letter(self, page: Page, i: int) -> str:
        """w a word of a name, W one that its punctuation ends, c and C the same of connectors, i an initial read as something else, 9 a number, | what ends a name."""
        key, text = page.key[i], page.words[i].text
        letters = [c for c in text if c.isalpha()]
        if not key or key in NOT_A_NAME:
            return "|"
        if key.isdigit():
            return "9"
        if not any(map(str.isalpha, key)):
            return "i" if len(key) <= 2 else "|"
        if letters and not letters[0].isupper() and key not in CONNECTORS and key not in self._known:
            return "|"
        out = "c" if key in OPEN_CONNECTORS else "w"
        return out.upper() if len(key) > 2 and text[-1:] in ",;:" else out

    def after_titles(self, page: Page, found: list[Finding] = ()) -> list[Finding]:
        """Two to six words to the right of Sr., Sra. and the like."""
        out = []
        for i, key in enumerate(page.key):
            if key not in TITLES:
                continue
            h = page.h[i]
            right = page.on_line(i) & (page.x0 >= page.x1[i] - 0.35 * h) & (page.x0 <= page.x0[i] + max(680, 24 * h))
            right[i] = False
            line = page.from_left(right)
            if key in _NO_TITLE and _NO_TITLE[key].match(plain_soft(" ".join(page.words[k].text for k in line))):
                continue
            letter = lambda k: self.title_letter(page, k)
            own = page.run(line, page.x1[i], 4 * h, letter, _TITLED)
            own = own[: len("".join(map(letter, own)).rstrip("cC"))]
            if len(own) > 1 and page.named(own):
                out.append(page.finding("NOMBRE", own, SCORE_TITLE))
        return out

    def before_roles(self, page: Page, found: list[Finding] = ()) -> list[Finding]:
        """Two to four capitalised words to the left of a judge's or notary's title, with parted letters joined."""
        out = []
        for i in page.places(ROLES.__contains__):
            h = page.h[i]
            line = page.from_left(page.on_line(i) & (page.x1 <= page.x0[i]) & (page.x0[i] < page.x1 + 20 * h))
            # a capital alone and small letters right after it are one word
            parted = [k for a, k in zip(line, line[1:], strict=False) if re.fullmatch("[^\\W\\d_]", page.bare[a]) and page.bare[a].isupper() and page.bare[k][:1].islower() and abs(page.x0[k] - page.x1[a]) <= 0.1 * h]
            pieces: list[list[int]] = []
            for k in line:
                if k in parted:
                    pieces[-1].append(k)
                else:
                    pieces.append([k])
            texts = ["".join(page.bare[k] for k in p) for p in pieces]
            letters = ["n" if _CAP.fullmatch(t) and plain_soft(t) not in NOT_A_NAME | ROLE_QUALITIES else "x" for t in texts]
            breaks = ["|" if page.x0[right].min() - page.x1[left].max() > 2 * h else "" for left, right in zip(pieces, pieces[1:], strict=False)]
            # from the title to the left
            m = _ROLE.match("".join(a + b for a, b in zip(letters[::-1], [*breaks[::-1], ""], strict=True)) if pieces else "")
            if m:
                own = pieces[len(pieces) - m.end() :]
                out.append(page.finding("NOMBRE", [k for p in own for k in p], SCORE_ROLE, " ".join(texts[len(texts) - m.end() :])))
        return out

    def representatives(self, page: Page, found: list[Finding]) -> list[Finding]:
        """Words of the column of representatives, in the band between the ids of one row and the next."""
        column, next_column = page.places("representante".__eq__), page.places("residencia".__eq__)
        if not column or not next_column:
            return []
        left, right = page.x0[column[0]] - 55, page.x0[next_column[0]] - 40
        ids = sorted((np.array(f.boxes)[:, 1].min(), np.array(f.boxes)[:, 3].max()) for f in found if f.code == "RUT" and f.boxes)
        heads = [k for k in page.places("legal".__eq__) if page.x0[k] < right]
        tops = [page.y1[[column[0], *heads]].max(), *(bottom for _, bottom in ids)]
        middle = (page.x0 + page.x1) / 2
        name = np.array([k not in NOT_A_NAME and not re.search(r"\d", k) and any(map(str.isalpha, k)) for k in page.key], bool)
        in_column = name & (left <= middle) & (middle <= right)
        out = []
        for top, (first, _) in zip(tops, ids, strict=False):
            own = np.flatnonzero(in_column & (page.y0 >= top - 4) & (page.y0 <= first + 6))
            if len(own) > 1:
                out.append(page.finding("NOMBRE", own[np.lexsort((page.x0[own], page.y0[own]))].tolist(), SCORE_ROW))
        return out

    def surname_letter(self, page: Page, i: int) -> str:
        """s a word that can be a surname, S one that a comma ends, n a known surname not written so, y and Y «y» (Y if it can be a surname), x another."""
        bare = plain_soft(page.bare[i])
        if page.soft[i] == "y":
            return "y"
        if _CAP.fullmatch(page.bare[i]) and bare not in NOT_A_NAME:
            return "S" if page.words[i].text[-1:] in ",;" else "s"
        return "n" if bare in self.names.surnames and bare not in NOT_A_NAME else "x"

    def wrapped(self, page: Page, f: Finding) -> Finding:
        """A name of low confidence with the surnames that stand on the next line."""
        if f.code != "NOMBRE" or not f.boxes or f.score > 0.7:
            return f
        box = np.array(f.boxes, float)
        left, bottom, right = box[:, 0].min(), box[:, 3].max(), box[:, 2].max()
        h = max((box[:, 3] - box[:, 1]).max(), 1)
        own = (page.box[:, None] == box).all(axis=2).any(axis=1)
        more: list[int] = []
        if own.any():
            at = np.flatnonzero(own)
            last = int(at[np.lexsort((page.x0[at], page.y0[at]))[-1]])
            if page.words[last].text.rstrip()[-1:] in (",", ";", ".", ":") or self._goes_on(page, last, own, h):
                return f
            more = self._ends_below(page, last, bottom, h)
        more = more or self._below(page, left, right, bottom, h, own)
        return f._replace(text=f"{f.text}\n{page.named(more)}", boxes=(*f.boxes, *page.finding("NOMBRE", more).boxes)) if more else f

    def _goes_on(self, page: Page, last: int, own: np.ndarray, h: float) -> bool:
        """Does the sentence go on on the line of a name's last word?"""
        beside = page.on_line(last) & ~own & (page.x0 >= page.x1[last]) & (page.x0 - page.x1[last] <= 2 * h)
        return any(page.soft[k] in PROSE or (page.words[k].text.islower() and page.soft[k] not in CONNECTORS and page.soft[k] not in self._known) for k in np.flatnonzero(beside))

    def _ends_below(self, page: Page, last: int, bottom: float, h: float) -> list[int]:
        """The next one or two words in reading order if they are surnames that end a phrase on the next line."""
        two = list(range(last + 1, min(last + 3, len(page.words))))
        if len(two) < 2 or page.on_line(last)[two[0]]:
            return []
        letters = "".join(self.surname_letter(page, k) for k in two)
        down = page.y0[two] - bottom
        if _WRAP_ONE.match(letters) and 0 <= down[0] <= 0.8 * h:
            return two[:1]
        return two if _WRAP_TWO.match(letters) and 0 <= down.min() <= 1.5 * h and page.on_line(two[0])[two[1]] else []

    def _below(self, page: Page, left: float, right: float, bottom: float, h: float, own: np.ndarray) -> list[int]:
        """Up to two surnames right below a name, indented, or below a heading."""
        has_letter = np.array([any(map(str.isalpha, k)) for k in page.key], bool)
        near = has_letter & ~own & (page.y0 >= bottom) & (page.y0 - bottom <= 0.65 * h) & (np.minimum(right, page.x1) > np.maximum(left, page.x0))
        if not near.any():
            return []
        line = page.from_left(near & (np.abs(page.y0 - page.y0[near].min()) <= 0.35 * h))[:2]
        heights = (page.y1 - page.y0)[page.y1 > page.y0]
        heading = h >= 1.35 * (np.median(heights) if len(heights) else 1) and bottom <= 0.4 * page.height
        if abs(page.x0[line[0]] - left) <= 0.45 * h and not heading:
            return []
        letter = lambda k: "x" if plain_soft(page.bare[k]) in OPEN_CONNECTORS else self.surname_letter(page, k).lower()
        return page.run(line, float("inf"), float("inf"), letter, _BELOW)

    def plausible(self, page: Page, found: list[Finding]) -> list[Finding]:
        """Without names that are a company's tail, hold numbers or vehicle words, or lie in a longer name."""

        def company(f: Finding) -> bool:
            first = np.flatnonzero((page.box == f.boxes[0]).all(axis=1)) if f.boxes else []
            if not len(first):
                return False
            k = int(first[0])
            above = (page.y1 <= page.y0[k] + 3) & (page.y1 <= page.y0[k]) & (page.y0[k] - page.y1 <= 1.5 * page.h[k])
            return any(page.key[a] + page.key[k] == "comercializadora" for a in np.flatnonzero(above))

        def no_name(f: Finding) -> bool:
            tokens = plain_soft(f.text).split()
            return any(map(str.isdigit, tokens)) or not VEHICLE.isdisjoint(tokens) or company(f)

        return drop_parts([f for f in found if f.code != "NOMBRE" or not no_name(f)])

    def residences(self, page: Page) -> list[Finding]:
        """Lines under the word Residencia, from their first word with letters to the last with digits."""
        head = page.places("residencia".__eq__)[:1]
        if not head:
            return []
        left = ((page.x0 + page.x1) / 2 >= page.x0[head[0]] - 50) & (page.y0 > page.y1[head[0]])
        out = []
        while left.any():
            at = np.flatnonzero(left)
            line = left & page.on_line(int(at[np.lexsort((page.x0[at], page.y0[at]))[0]]))
            left &= ~line
            order = page.from_left(line)
            m = _RESIDENCE.match("".join(_letters_and_digits(page.words[k].text) for k in order))
            if m and page.key[order[m.start(1)]] not in NO_ADDRESS_LEAD:
                out.append(page.finding("DIRECCION", order[m.start(1) : m.end(1)], SCORE_ADDRESS))
        return out

    def wrapped_streets(self, page: Page) -> list[Finding]:
        """A street's name at the end of a line whose number stands, after its sign, on the next, with a unit if one follows."""

        def letter(i: int) -> str:
            text, soft = page.words[i].text, page.soft[i].rstrip(".")
            if _NUMBER_SIGN.fullmatch(text):
                return "#"
            if soft in STREETS:
                return "A"
            return "n" if _CAP.fullmatch(page.bare[i]) else "9" if _NUMBER.fullmatch(text) else "x"

        def beside(a: int, b: int) -> bool:
            return bool(page.on_line(a)[b]) and 0 <= page.x0[b] - page.x1[a] <= 3 * page.h[a]

        letters, out = "".join(letter(i) for i in range(len(page.words))), []
        for m in re.finditer(r"A(?=(n{1,5})#9)", letters):
            street, last = m.start(), m.end(1) - 1
            sign, number = last + 1, last + 2
            line = range(street, last + 1)
            together = page.on_line(street)[list(line)].all() and all(beside(k, k + 1) for k in line[:-1])
            down = page.y0[sign] - page.y1[last]
            if not (together and 0 <= down <= 1.8 * page.h[street] and page.x0[sign] < page.x0[last] and beside(sign, number)):
                continue
            end = number + 1
            unit = range(end, end + 2)
            if unit.stop <= len(page.words) and page.soft[end].rstrip(".") in UNITS and _UNIT_VALUE.fullmatch(page.words[end + 1].text) and page.on_line(number)[list(unit)].all() and beside(number, end):
                end = unit.stop
            out.append(page.finding("DIRECCION", range(street, end), SCORE_ADDRESS))
        return out


def _letters_and_digits(text: str) -> str:
    a, d = any(map(str.isalpha, text)), any(map(str.isdigit, text))
    return "b" if a and d else "a" if a else "d" if d else "-"


class Place(NamedTuple):
    """A finding on a page of a document."""

    page: int
    finding: Finding


def exact_names(pages: list[tuple[int, list[Word]]], names: list[str]) -> list[Place]:
    """Configured names as sequences of words over lines and pages, longest first; one finding a page.

    A name of one word must agree in case and accents. Names of one length are
    sought in one pass over the document's tokens.
    """
    tokens = [(t, n, w) for n, words in pages for w in words for t in re.findall(r"\w+", plain_strip(w.text))]
    sought: dict[int, dict[tuple[str, ...], set[str]]] = {}
    for name in names:
        parts = tuple(plain_strip(name).split())
        sought.setdefault(len(parts), {}).setdefault(parts, set()).add(name)
    free, out = np.ones(len(tokens), bool), []
    for size in sorted(filter(None, sought), reverse=True):
        windows = zip(*[[t for t, _, _ in tokens[k:]] for k in range(size)], strict=False)
        for at, window in enumerate(windows):
            as_written = sought[size].get(window)
            own = slice(at, at + size)
            if not as_written or not free[own].all() or (size == 1 and tokens[at][2].text.strip(_QUOTES) not in as_written):
                continue
            free[own] = False
            by_page: dict[int, dict[Word, None]] = {}
            for _, n, w in tokens[own]:
                by_page.setdefault(n, {})[w] = None
            out += [Place(n, Finding("NOMBRE", " ".join(w.text.strip(_QUOTES) for w in ws), tuple(w.box for w in ws), 1.0)) for n, ws in by_page.items()]
    return out


_QUOTES = " ,.;:()“”"


def has_reference(words: list[Word], sequences: list[list[str]]) -> bool:
    """Does a text hold one of the configured sequences of tokens?"""
    text = " ".join(["", *re.findall(r"\w+", plain_strip(" ".join(w.text for w in words))), ""])
    return any(s and f" {' '.join(s)} " in text for s in sequences)


def reread_header(words: list[Word], expected: list[str]) -> list[Word]:
    """The words of a second reading that are a configured header, one after the other; none if it isn't there."""
    tokens = _tokens(words)
    at = next((i for i in range(len(tokens) - len(expected) + 1) if tokens[i : i + len(expected)] == expected), None)
    return words[at : at + len(expected)] if expected and at is not None else []


def reread_paragraphs(readings: list[list[Word]], rules: list[dict], groups: list[list[str]]) -> list[Word]:
    """Of further readings of a gap, the words that are configured sequences, corrected as configured.

    rules: tokens, field, corrections (place: text). A field is taken once, from
    the first reading that has it; of rules that fit at a place the first counts.
    Readings end as soon as all fields of a group are found.
    """
    found: dict[str, list[Word]] = {}
    for words in readings:
        tokens = _tokens(words)
        for start in range(len(tokens)):
            rule = next((r for r in rules if r["tokens"] and tokens[start : start + len(r["tokens"])] == list(r["tokens"])), None)
            if rule and rule["field"] not in found:
                corrected = {int(k): v for k, v in (rule.get("corrections") or {}).items()}
                own = words[start : start + len(rule["tokens"])]
                found[rule["field"]] = [w._replace(text=corrected.get(k, w.text)) for k, w in enumerate(own)]
        if any(set(g) <= found.keys() for g in groups):
            break
    return [w for own in found.values() for w in own]


def _tokens(words: list[Word]) -> list[str]:
    return [plain_strip(w.text).strip(PUNCTUATION) for w in words]


def abbreviated_names(pages: list[tuple[int, float, list[Word]]], found: list[Place], first_names: frozenset[str]) -> list[Place]:
    """Further places of three-part names that two pages hold, where the first name is cut short.

    Either both surnames stand right of three or more letters of the first name,
    or, in the lowest quarter of a page, the last surname stands right of a part
    of the others.
    """
    on: dict[tuple[str, ...], set[int]] = {}
    for n, f in found:
        parts = tuple(plain_soft(f.text).split())
        if f.code == "NOMBRE" and len(parts) == 3 and min(map(len, parts)) > 2 and parts[0] in first_names:
            on.setdefault(parts, set()).add(n)
    known = [parts for parts, at in on.items() if len(at) > 1]
    out = []
    for n, height, words in pages if known else []:
        page, taken = Page(words, height=height), [b for m, f in found if m == n and f.code == "NOMBRE" for b in f.boxes]

        def part(of: str, page=page) -> np.ndarray:
            return np.array([len(k) > 2 and of.startswith(k) for k in page.key], bool)

        def left(i: int, heights: float, page=page) -> np.ndarray:
            gap = page.x0[i] - page.x1
            near = page.on_line(i) & (gap >= 0) & (gap <= heights * page.h[i])
            near[i] = False
            return near

        for first, middle, last in known:
            for i in np.flatnonzero(np.array(page.key) == middle):
                before = np.flatnonzero(left(i, 4) & part(first))
                gap = page.x0 - page.x1[i]
                after = np.flatnonzero(page.on_line(i) & (gap >= 0) & (gap <= 4 * page.h[i]) & (np.array(page.key) == last))
                if len(before) and len(after):
                    own = [before[page.x1[before].argmax()], i, after[page.x0[after].argmin()]]
                    boxes = page.box[own]
                    # the part that was cut off stood to the left
                    boxes[0, 0] = max(0, boxes[0, 0] - 6 * page.h[i])
                    if not all_met(boxes, taken):
                        out.append(Place(n, Finding("NOMBRE", " ".join(words[k].text for k in own), tuple(map(tuple, boxes.tolist())), SCORE_CUT)))
                        taken += out[-1].finding.boxes
            low = (np.array(page.key) == last) & (page.y0 >= 0.75 * height)
            for i in np.flatnonzero(low):
                if (left(i, 10) & (part(first) | part(middle))).any() and not touching([page.box[i]], taken).any():
                    h, (x0, y0, x1, y1) = page.h[i], page.box[i]
                    box = (max(0, x0 - 24 * h), max(0, y0 - h), x1, min(height, y1 + h))
                    out.append(Place(n, Finding("NOMBRE", f"{first} {middle} {last}", (tuple(map(float, box)),), SCORE_FOOT)))
                    taken.append(box)
    return out


def occurrences(needle: str, hay: str) -> Iterator[int]:
    """Starts of a string in another; they may overlap."""
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


def _lowered(text: str) -> str:
    """Lower case of the same length."""
    if text.isascii():
        return text.lower()
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _stands_alone(text: str, start: int, end: int) -> bool:
    return not re.search(r"[^\W_]|[@._+-]", text[max(0, start - 1) : start] + text[end : end + 1])


def _repeats(page: Page, values: dict[str, str], names: list[str]) -> Iterator[tuple[str, str, list[int]]]:
    """Where values (lower case: code) and names (letters and digits alone) stand on a page: code, text, words."""
    text, owner = page.text()
    low = _lowered(text)
    for value, code in values.items():
        for at in occurrences(value, low):
            end = at + len(value)
            if _stands_alone(text, at, end) if code == "NOMBRE" else "\n" not in value:
                yield code, text[at:end], owners(owner, at, end)
    if not names:
        return
    squeezed = [(c, i) for i, x in enumerate(text) for c in (x.lower() if x < "\x80" else plain_strip(x)) if c.isalnum()]
    letters = "".join(c for c, _ in squeezed)
    for name in names:
        for at in occurrences(name, letters):
            start, end = squeezed[at][1], squeezed[at + len(name) - 1][1] + 1
            if _stands_alone(text, start, end):
                yield "NOMBRE", text[start:end], owners(owner, start, end)
        for chain in chains(page, name):
            yield "NOMBRE", "\n".join(page.words[i].text for i in chain), chain


def chains(page: Page, name: str) -> Iterator[list[int]]:
    """Two and more words, each right of or just below the last, whose letters make up a name."""
    letters = [plain_norm(w.text) for w in page.words]
    at: dict[int, list[int]] = {}
    for i, part in enumerate(letters):
        for place in occurrences(part, name) if part else ():
            at.setdefault(place, []).append(i)
    for start in at.get(0, []):
        chain, made = [start], len(letters[start])
        while made < len(name):
            last = chain[-1]
            right, down = page.x0 - page.x1[last], page.y0 - page.y1[last]
            beside = page.on_line(last) & (right >= -page.h[last]) & (right <= 3 * page.h[last])
            below = (down >= 0) & (down <= 0.8 * page.h[last]) & (np.minimum(page.x1, page.x1[last]) > np.maximum(page.x0, page.x0[last]))
            next_ = [i for i in at.get(made, []) if i not in chain and (beside[i] or below[i])]
            if not next_:
                break
            chain.append(min(next_, key=lambda i, last=last: (abs(page.y0[i] - page.y0[last]), page.x0[i])))
            made += len(letters[chain[-1]])
        if made == len(name) and len(chain) > 1:
            yield chain


def repeated_values(pages: list[tuple[int, list[Word]]], found: list[Place]) -> list[Place]:
    """Further places of found values on pages: as they are, without separators, and put together word by word.

    Values of six and more characters are sought; a place counts unless the
    centres of all its words lie in boxes of the page's findings.
    """
    values: dict[str, str] = {}
    for _, f in found:
        text = f.text.strip()
        if len(text) >= 6 and f.code != "FIRMA" and not text.startswith("("):
            values.setdefault(_lowered(text), f.code)
    names = sorted({n for v, c in values.items() if c == "NOMBRE" and len(n := plain_norm(v)) >= 6})
    out = []
    for n, words in pages:
        page = Page(words)
        centre = np.column_stack([page.x0 + page.x1, page.y0 + page.y1]) / 2
        taken = np.array([b for m, f in found if m == n for b in f.boxes], float).reshape(-1, 4)
        for code, value, own in _repeats(page, values, names):
            at = centre[own][:, None]
            if own and not ((taken[:, :2] <= at) & (at <= taken[:, 2:])).all(axis=2).any(axis=1).all():
                out.append(Place(n, page.finding(code, own, SCORE_REPEAT, value)))
                taken = np.concatenate([taken, page.box[own]])
    return out
