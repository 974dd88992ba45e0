"""Pre-tokens of a lower-casing, white-space-dropping byte-level BPE, without encoding whole texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from tokenizers import Tokenizer

#: White space of the tokenizer's own pattern (Unicode White_Space).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of Latin-1 that composing and lower-casing treat one by one.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_ODD = re.compile(f"[^{_SPACE}\x21-\x7e{_LETTERS}]")
_ODD_CHUNK = re.compile(f"[^{_SPACE}]*[^{_SPACE}\x21-\x7e{_LETTERS}][^{_SPACE}]*")
_LOWER = _LETTERS.replace("A-Z", "").replace("\xc0-\xd6\xd8-\xf6\xf8-\xff", "\xdf-\xf6\xf8-\xff")
#: Fixed value: the split pattern of the vocabulary, for these letters: endings, letters, one digit, anything else.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^{_SPACE}{_LOWER}0-9]+")
#: How a vocabulary's file says that it composes, lower-cases and splits as this module does.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: A pre-token longer than this isn't kept in any dictionary.
LONGEST = 64


def splitter(specials: list[str]) -> Callable[[str], list[str]]:
    """A function that cuts a text into pieces that the tokenizer treats one by one.

    Plain pieces are the tokenizer's own pre-tokens, in lower case. A stretch
    without white space that holds any other character, or the string of a
    special token, stays one piece as it is: the tokenizer itself then composes,
    lower-cases and cuts it. In either case the ids of a text are those of its
    pieces, one after the other.
    """
    special = re.compile(f"[^{_SPACE}]*(?:{'|'.join(map(re.escape, specials))})[^{_SPACE}]*") if specials else None

    def split(text: str) -> list[str]:
        whole = None
        if _ODD.search(text):
            whole = _ODD_CHUNK
        if special is not None and "<|" in text and special.search(text):
            whole = re.compile(f"{special.pattern}|{_ODD_CHUNK.pattern}")
        if whole is None:
            return _SPLIT.findall(text.lower())
        out: list[str] = []
        at = 0
        for m in whole.finditer(text):
            out += _SPLIT.findall(text[at : m.start()].lower())
            out.append(m[0])
            at = m.end()
        return out + _SPLIT.findall(text[at:].lower())

    return split


def splits_alike(path: str) -> bool:
    """Does a vocabulary compose, lower-case and split as splitter() does?"""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = lambda name, kind: (said.get(name) or {}).get(kind)
    return said.get("model", {}).get("type") == "BPE" and steps("normalizer", "normalizers") == _NORMALIZER and steps("pre_tokenizer", "pretokenizers") == _PRE_TOKENIZER


class Pieces:
    """Ids of pre-tokens, each computed once while the dictionary has room.

    One a worker process and vocabulary (see pieces()); the dictionary starts
    anew beyond `room` entries, so its memory is bounded. A vocabulary that
    treats texts in another way than splitter() gets whole texts as its pieces,
    which the tokenizer itself then cuts: slower, and as right.
    """

    def __init__(self, path: str, room: int = 1 << 19):
        self.tokenizer = Tokenizer.from_file(path)
        specials = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alike = splits_alike(path)
        self.split = splitter(specials) if self.alike else lambda text: [text] if text else []
        self._known = _Memo(lambda piece: _pack(self.ids(piece)), room)
        self._plain = re.compile(f"[\x21-\x7e{_LOWER}]+")
        self._bytes = _byte_letters()

    def ids(self, piece: str) -> list[int]:
        """The ids of one piece of split(), without begin, end or padding."""
        if self.alike and self._plain.fullmatch(piece) and "<|" not in piece and _SPLIT.fullmatch(piece):
            return [t.id for t in self.tokenizer.model.tokenize("".join(map(self._bytes.__getitem__, piece.encode())))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit numbers."""
        pieces, known = self.split(text), self._known
        if not pieces:
            return b""
        if max(map(len, pieces)) > LONGEST:
            return b"".join(known[p] if len(p) <= LONGEST else _pack(self.ids(p)) for p in pieces)
        return b"".join(map(known.__getitem__, pieces))


def _pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class _Memo(dict):
    def __init__(self, make, room: int):
        super().__init__()
        self._make, self._room = make, room

    def __missing__(self, piece: str):
        value = self._make(piece)
        if len(self) >= self._room:
            self.clear()
        self[piece] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself, or the next free one from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def texts(column) -> Iterator[str]:
    """Texts of an Arrow string column, null as empty, one at a time."""
    for x in column:
        yield x.as_py() or ""
