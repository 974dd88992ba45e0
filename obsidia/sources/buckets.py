"""Files behind temporary addresses: fetched and put by tasks, with errors told apart that a retry may mend."""

from __future__ import annotations

import hashlib
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import MAX_FILE

#: Seconds for an answer to a GET and to a PUT, and bytes that are read at once.
GET_SECONDS, PUT_SECONDS, CHUNK = 60, 120, 1 << 20
FETCHED = "id long, content binary, sha256 string, outcome string, error string"
STORED = "id long, outcome string, error string"


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """An address is a credential for one place; it is not followed to another."""

    def redirect_request(self, *args):
        return None


_OPENER = urllib.request.build_opener(_NoRedirect)


def outcome_of(status: int) -> str:
    """done, permanent (the client's fault) or transient."""
    return "done" if 200 <= status < 300 else "permanent" if 400 <= status < 500 else "transient"


def get(url: str, most: int = MAX_FILE) -> tuple[bytes | None, str, str | None]:
    """Content, outcome and error of an address; more bytes than allowed are a permanent error, found while reading."""
    try:
        with _OPENER.open(url, timeout=GET_SECONDS) as answer:
            if answer.status != 200 and not url.startswith("file:"):
                return None, "transient", f"status {answer.status}"
            parts, size = [], 0
            while part := answer.read(CHUNK):
                size += len(part)
                if size > most:
                    return None, "permanent", "TOO_LARGE"
                parts.append(part)
            return b"".join(parts), "done", None
    except urllib.error.HTTPError as e:
        return None, "permanent" if 400 <= e.code < 500 else "transient", f"status {e.code}"
    except (OSError, ValueError) as e:
        return None, "transient", type(e).__name__


def put(url: str, content: bytes, headers: dict[str, str]) -> tuple[str, str | None]:
    """Outcome and error of storing content at an address."""
    try:
        with _OPENER.open(urllib.request.Request(url, content, headers, method="PUT"), timeout=PUT_SECONDS) as answer:
            return outcome_of(answer.status), None if outcome_of(answer.status) == "done" else f"status {answer.status}"
    except urllib.error.HTTPError as e:
        return outcome_of(e.code) if e.code >= 400 else "transient", f"status {e.code}"
    except (OSError, ValueError) as e:
        return "transient", type(e).__name__


def fetched(items: DataFrame, most: int = MAX_FILE) -> DataFrame:
    """id, content, sha256, outcome, error of items (id, source_url); check addresses by jobs.allowed() before.

    Each item is fetched by the task that has it and handed on by itself, so a
    task holds one file at a time. The outcomes are those of jobs.finish().
    """

    def run(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                content, outcome, error = get(r.source_url, most)
                yield pd.DataFrame([(r.id, content, None if content is None else hashlib.sha256(content).hexdigest(), outcome, error)], columns=["id", "content", "sha256", "outcome", "error"])

    return items.select(F.col("id").cast("long"), "source_url").mapInPandas(run, FETCHED)


def stored_at(items: DataFrame) -> DataFrame:
    """id, outcome, error of putting content to target_url with target_headers (a map); an action, so write the result once."""

    def run(batches):
        for rows in batches:
            out = [(r.id, *put(r.target_url, bytes(r.content), dict(r.target_headers or {}))) for r in rows.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["id", "outcome", "error"])

    return items.select(F.col("id").cast("long"), "target_url", "target_headers", "content").mapInPandas(run, STORED)
