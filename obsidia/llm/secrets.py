"""Operator 4: secrets by pattern, and by novelty to a dictionary-primed compressor."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, the group that counts, and its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Strings after these words may be secrets, whatever stands between.
_CONTEXT = re.compile(r"""(?:passphrase|passcode|pwd|credentials?|private|bearer|authorization|auth|signature|session|cookie|access|client|key|password|passwd|secret|token)[\w-]{0,24}["']?\s{0,4}(?:[:=]|=>|\bis\b|\x20)\s{0,4}["'`]?""", re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]{16,}")
#: Characters of a candidate that are compressed at once.
WINDOW = 512
#: Code points of the text around a candidate that its compressor has seen.
AROUND = 512
#: A candidate is new if it costs more bytes than this share of its own.
NOVELTY = 0.6
#: Words of code and configuration that a compressor is primed with.
IDENTIFIERS = " ".join(
    f"{a}{b}"
    for a in ("get", "set", "is", "has", "to", "from", "new", "create", "update", "delete", "load", "read", "write", "parse", "open", "init")
    for b in ("User", "Name", "Value", "Config", "Path", "File", "List", "Map", "String", "Token", "Key", "Session", "Request", "Response", "Client", "Server")
) + " import return function class public private static const true false null None self this https://www. http://localhost:8080 application/json charset=utf-8 en-US example.com 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KINDS = ("assign", "access", "hex", "novel")


def marginal_bytes(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> int:
    """Bytes that a candidate adds to a frame whose dictionary holds identifiers and its surroundings."""
    prime = zstandard.ZstdCompressionDict((identifiers + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    maker = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(maker.compress(candidate.encode())) - len(maker.compress(b""))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns in code points: leftmost, non-overlapping by kind, failing matches dropped."""
    out = []
    pattern, group, least = BASE["assign"]
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in pattern.finditer(text) if len(m[group]) >= least]
    pattern, group, least = BASE["access"]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in pattern.finditer(text) if len(m[group]) >= least]
    # runs of hex digits don't overlap, so those of 24 and more are the long matches
    out += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


def _cost(text: str, start: int, end: int, run: int, known: dict[int, int]) -> int:
    """Marginal bytes of a candidate, summed over windows cut at multiples of WINDOW from the start of its run.

    Each window has its own surroundings as dictionary. Whole windows of a run
    are measured once for all candidates that begin in it.
    """
    if end - start <= WINDOW:
        return marginal_bytes(text[start:end], text[max(0, start - AROUND) : start] + text[end : end + AROUND])
    total, at = 0, start
    while at < end:
        stop = min(end, at + WINDOW - (at - run) % WINDOW)
        if stop - at < WINDOW or at not in known:
            cost = marginal_bytes(text[at:stop], text[max(0, at - AROUND) : at] + text[stop : stop + AROUND])
            if stop - at == WINDOW:
                known[at] = cost
        else:
            cost = known[at]
        total, at = total + cost, stop
    return total


def _free_parts(start: int, end: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base spans leave of a candidate: all or nothing up to WINDOW characters, beyond that the parts between them."""
    touched = sorted((s, e) for s, e, _ in taken if s < end and start < e)
    if not touched or end - start <= WINDOW:
        return [] if touched else [(start, end)]
    out = []
    for s, e in [*touched, (end, end)]:
        if s > start:
            out.append((start, s))
        start = max(start, e)
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Strings in a sensitive context that the text around them and common identifiers don't explain.

    A candidate has 16 characters or more, of any length, letters and digits
    both, and follows a sensitive word; it is reported whole if its marginal
    bytes exceed `novelty` of its length, beyond WINDOW characters those of
    consecutive windows. Base spans that it touches go before it; of a candidate
    beyond WINDOW the parts outside them are judged each.
    """
    out: list[tuple[int, int, str]] = []
    at = run = run_end = 0
    known: dict[int, int] = {}
    for context in _CONTEXT.finditer(text):
        begin = context.end()
        if begin < at:
            continue
        if begin >= run_end:
            m = _CANDIDATE.match(text, begin)
            if m is None:
                continue
            run, run_end, known = begin, m.end(), {}
        for start, stop in _free_parts(begin, begin + len(text[begin:run_end].rstrip(".=!")), taken):
            part = text[start:stop]
            if stop - start < 16 or not re.search("[0-9]", part) or not re.search("[A-Za-z]", part):
                continue
            if _cost(text, start, stop, run, known) > novelty * (stop - start):
                out.append((start, stop, "novel"))
                at = stop
    return out


def secret_spans(text: str, novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, by start, then kind as listed."""
    spans = base_spans(text)
    return sorted(spans + novel_spans(text, spans, novelty), key=lambda x: (x[0], _KINDS.index(x[2]), x[1]))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every whole text (null: none).

    One pass without a shuffle; each text is scanned alone, so repeated rows and
    null ids make no difference, and an empty table gives an empty one. A novel
    string follows a sensitive word and at most 24 word characters, and its
    surroundings are the AROUND code points on either side.
    """
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in secret_spans(t.as_py() or "", novelty)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def base_digest(text: str) -> str:
    """Lowercase hex SHA-256 of the listed base spans, for tests."""
    spans = sorted(base_spans(text), key=lambda x: (x[0], _KINDS.index(x[2])))
    return hashlib.sha256(listed(spans).encode()).hexdigest()
