"""Review and approval: a document's states as a table of moves, findings under review, and what audit shows of it."""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..catalog import ENTITIES, LEVELS, TREATMENTS
from ..functions.normalize import norm_soft
from .workflow import completed_status, finding_counts, visible

#: States in which findings may be edited, those that wait for a decision, and those that health counts.
EDITABLE = ("review", "verification_failed", "protected_with_warnings")
WAITING = ("submitted", "protecting", "pending_approval")
IN_WORK = ("uploaded", "processing", "submitted", "approved", "protecting")
#: What treatments and levels are called on screen, in the order of their codes.
LABELS = dict(zip(TREATMENTS, ("Tachar", "Anonimizar", "Seudonimizar", "Enmascarar total", "Enmascarar parcial"), strict=True)) | dict(zip(LEVELS, ("Rápido", "Equilibrado", "Exhaustivo"), strict=True))


class Move(NamedTuple):
    """What an action does to a document: from which states, to which, and what it sets (from the action's columns) or clears.

    To: None stands for the end of a protection, which follows from the verification.
    """

    sources: tuple[str, ...]
    to: str | None
    sets: dict[str, str] = {}
    clears: tuple[str, ...] = ()
    treated: bool = False


_DECIDED = {"decision_at": "at", "decision_by": "username", "decision_note": "note"}
MOVES = {
    "process": Move(("uploaded",), "processing"),
    "processed": Move(("processing",), "review"),
    "edit": Move(EDITABLE, "review", {}, ("verified", "protected_at")),
    "approve": Move(EDITABLE, "approved", {"treatment": "treatment"}, treated=True),
    "submit": Move(EDITABLE, "submitted", {"treatment": "treatment", "submitted_at": "at", "submitted_by": "username"}, ("decision_at", "decision_by", "decision_note"), treated=True),
    "protect": Move(("approved", "submitted"), "protecting"),
    "protected": Move(("protecting",), None, {"verified": "verified", "protected_at": "at"}),
    "accept": Move(("pending_approval",), None, {"decision_at": "at", "decision_by": "username"}, ("decision_note",)),
    "reject": Move(("pending_approval",), "rejected", _DECIDED),
    "return": Move(("pending_approval",), "review", _DECIDED, ("verified", "protected_at")),
    "fail": Move(("processing", "protecting"), "failed", {"error": "note"}),
}


def moved(documents: DataFrame, actions: DataFrame) -> DataFrame:
    """documents after one action each, and `refused`: why an action didn't take place.

    actions: doc_id, action, username, at, note, treatment, verified; at most one
    a document, as each state depends on the last. An edit of a document that
    isn't protected yet changes nothing but is no error; one of a protected
    document invalidates its result. The end of a protection waits for approval
    if the document was submitted and not decided. Documents and actions are
    joined once by id.
    """
    given = actions.select(F.col("doc_id"), *[F.col(c).alias(f"_{c}") for c in ("action", "username", "at", "note", "treatment", "verified")])
    joined = documents.join(given, "doc_id", "left")
    action, status = F.col("_action"), F.col("status")
    allowed, target = F.lit(False), F.lit(None).cast("string")
    waits = F.col("submitted_at").isNotNull() & F.col("decision_at").isNull()
    for name, move in MOVES.items():
        fits = (action == name) & status.isin(*move.sources)
        if move.treated:
            fits &= F.coalesce(F.col("_treatment").isin(*TREATMENTS), F.lit(False))
        to = F.lit(move.to)
        if name == "protected":
            to = F.when(waits, "pending_approval").otherwise(completed_status(F.col("_verified")))
        elif name == "accept":
            to = completed_status(F.col("verified"))
        elif name == "edit":
            to = F.when(status == "protected_with_warnings", move.to).otherwise(status)
        allowed, target = allowed | fits, F.when(fits, to).otherwise(target)
    judged = joined.withColumn("_to", target).withColumn("refused", F.when(action.isNotNull() & ~F.coalesce(allowed, F.lit(False)), F.concat_ws(" ", action, F.lit("in"), status)))
    done, was = F.col("_to").isNotNull(), F.col("status")

    def after(column: str) -> Column:
        value = F.col(column)
        for name, move in MOVES.items():
            # an edit clears only what it invalidates
            now = done & (action == name) & ((was == "protected_with_warnings") if name == "edit" else F.lit(True))
            if column in move.clears:
                value = F.when(now, F.lit(None)).otherwise(value)
            elif column in move.sets:
                value = F.when(now, F.col(f"_{move.sets[column]}")).otherwise(value)
        return value

    return judged.select(*[(F.coalesce("_to", "status") if c == "status" else after(c)).alias(c) for c in documents.columns], "refused")


def editable(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status").isin(*EDITABLE))


def reviewed(findings: DataFrame, reviews: DataFrame, documents: DataFrame) -> DataFrame:
    """findings after reviews of documents that may be edited.

    reviews: doc_id, finding_id (null: all of the document), entity_code (null:
    any), status (accepted or rejected), username, at. A finding takes the last
    review that is for it, one by id before one in bulk. A document's reviews
    are joined to its findings as one list.
    """
    valid = reviews.filter(F.col("status").isin("accepted", "rejected")).join(editable(documents).select("doc_id"), "doc_id", "left_semi")
    lists = valid.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("finding_id").isNotNull().alias("own"), "at", "finding_id", "entity_code", "status", "username")).alias("_reviews"))
    joined = findings.join(lists, "doc_id", "left")
    mine = F.filter("_reviews", lambda r: F.when(r["own"], r["finding_id"] == F.col("finding_id")).otherwise(F.coalesce(r["entity_code"] == F.col("entity_code"), F.lit(True))))
    last = joined.withColumn("_last", F.array_max(mine))
    new = {"status": "status", "reviewed_by": "username", "reviewed_at": "at"}
    return last.select(*[F.coalesce(F.col(f"_last.{new[c]}"), F.col(c)).alias(c) if c in new else F.col(c) for c in findings.columns])


def manual_findings(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """New findings that reviewers ask for, or an error_code.

    requests: request_id, doc_id, entity_code, text, page, box array<double>,
    location, start, end. A box lies on a page, offsets in a block; one of the
    two is needed. The id is a digest of the request, so a rerun adds nothing.
    """
    box, place = F.col("box"), F.col("location").isNotNull()
    good_box = (F.size(box) == 4) & (box[2] > box[0]) & (box[3] > box[1])
    good_place = (F.col("start") >= 0) & (F.col("start") < F.col("end"))
    known = editable(documents).select("doc_id", F.lit(True).alias("_editable"))
    error = (
        F.when(F.col("_editable").isNull(), "NOT_EDITABLE")
        .when(~F.coalesce(F.col("entity_code").isin(*ENTITIES), F.lit(False)), "UNKNOWN_ENTITY")
        .when(box.isNotNull() & ~F.coalesce(good_box, F.lit(False)), "BAD_BOX")
        .when(box.isNull() & ~place, "NO_PLACE")
        .when(box.isNull() & ~F.coalesce(good_place, F.lit(False)), "BAD_OFFSETS")
    )
    on_page, in_block = box.isNotNull(), box.isNull()
    return requests.join(known, "doc_id", "left").select(
        F.sha2(F.concat_ws("|", F.lit("manual"), "doc_id", "request_id"), 256).alias("finding_id"), "doc_id", "entity_code",
        F.when(F.coalesce("text", F.lit("")) == "", "(manual)").otherwise(F.col("text")).alias("text"), F.lit(1.0).alias("score"),
        F.when(on_page, F.coalesce("page", F.lit(1))).alias("page"), F.when(on_page, F.array("box")).alias("boxes"),
        F.when(in_block, F.col("location")).alias("location"), F.when(in_block, F.col("start")).alias("start"), F.when(in_block, F.col("end")).alias("end"),
        F.lit("manual").alias("source"), F.lit("accepted").alias("status"), error.alias("error_code"),
    )


def without_manual(findings: DataFrame, deleted: DataFrame, documents: DataFrame) -> DataFrame:
    """findings without the manual ones named in deleted (finding_id), in documents that may be edited; others can't be deleted."""
    gone = findings.filter(F.col("source") == "manual").join(deleted.select("finding_id").distinct(), "finding_id", "left_semi").join(editable(documents).select("doc_id"), "doc_id", "left_semi")
    return findings.join(gone.select("finding_id"), "finding_id", "left_anti").select(*findings.columns)


def replaced_policies(matrix: DataFrame) -> DataFrame:
    """document_type, entity_code, enabled: the rules that take the place of all others; unknown categories are left out.

    matrix: document_type, entity_code, enabled (boolean).
    """
    return matrix.filter(F.col("entity_code").isin(*ENTITIES)).select("document_type", "entity_code", F.coalesce(F.col("enabled").cast("int"), F.lit(0)).alias("enabled"))


def chosen(value: Column, codes: tuple[str, ...]) -> Column:
    """A code from itself or from what it is called on screen, without regard to case and accents; else null."""
    soft = norm_soft(F.coalesce(value, F.lit("")))
    out = F.lit(None).cast("string")
    for code in codes:
        out = F.when((F.lower(F.btrim(value)) == code) | (soft == norm_soft(F.lit(LABELS[code]))), code).otherwise(out)
    return out


def resolved_options(requests: DataFrame, types: DataFrame, effective: DataFrame) -> DataFrame:
    """requests (request_id, document_type, entities, treatment, analysis_level) with valid options, or an error_code.

    types: document_type, active. effective: document_type, entities, which
    stand in where a request names no known category.
    """
    active = types.filter("active = 1").select("document_type", F.lit(True).alias("_active"))
    own = F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda c: c.isin(*ENTITIES))
    joined = requests.join(active, "document_type", "left").join(effective.select("document_type", F.col("entities").alias("_policy")), "document_type", "left")
    out = joined.select(
        "request_id", "document_type", F.when(F.size(own) > 0, own).otherwise(F.col("_policy")).alias("entities"),
        chosen(F.col("treatment"), TREATMENTS).alias("treatment"), chosen(F.col("analysis_level"), LEVELS).alias("analysis_level"), "_active",
    )
    error = F.when(F.col("_active").isNull(), "BAD_TYPE").when(F.col("treatment").isNull(), "BAD_TREATMENT").when(F.col("analysis_level").isNull(), "BAD_LEVEL")
    return out.withColumn("error_code", error).drop("_active")


# lists


def document_findings(findings: DataFrame, doc_id) -> DataFrame:
    return findings.filter(F.col("doc_id") == doc_id).orderBy("page", "location", "start")


def pending(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Documents that wait for a decision, the first submitted first, with their counts of findings."""
    counts = finding_counts(findings)
    rows = documents.filter(F.col("status").isin(*WAITING)).join(counts, "doc_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_findings", "n_accepted")}).orderBy("submitted_at", "doc_id")


def batches(documents: DataFrame, username: str, role: str, limit: int = 100) -> DataFrame:
    """batch_id, started, documents and finished ones of the batches that a user may see, newest first."""
    rows = visible(documents, username, role).filter("batch_id IS NOT NULL").groupBy("batch_id")
    done = F.count_if(F.col("status").isin("protected", "protected_with_warnings"))
    return rows.agg(F.min("created_at").alias("started"), F.count(F.lit(1)).alias("n_documents"), done.alias("n_done")).orderBy(F.col("started").desc_nulls_last(), "batch_id").limit(limit)


def word_search(words: DataFrame, sought: str) -> DataFrame:
    """Words of pages that hold a string, whatever its case."""
    return words.filter(F.contains(F.lower("text"), F.lower(F.lit(sought))))


def health(documents: DataFrame, items: DataFrame) -> DataFrame:
    """area, status, n of documents and queue items that are in work."""
    count = lambda df, area, states: df.filter(F.col("status").isin(*states)).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(area).alias("area"), "status", "n")
    return count(documents, "queue", IN_WORK).unionByName(count(items, "jobs", ("queued", "processing")))


# audit

AUDIT_COLUMNS = ["id", "ts", "username", "ip", "event", "treatment", "analysis_level", "details", "prev_hash", "hash"]


@F.pandas_udf(StringType())
def _shown(details: pd.Series, titles: pd.Series) -> pd.Series:
    """Details as shown: the document's title for its id, files for ids, keys in order."""

    def one(text: str | None, title: str | None) -> str | None:
        try:
            row = json.loads(text)
        except (TypeError, ValueError):
            return text
        if isinstance(row, dict):
            if row.pop("document_id", None) is not None:
                row["documento"] = row.pop("file", None) or title or "Documento eliminado"
            if "ids" in row and "files" in row:
                del row["ids"]
                row["documentos"] = row.pop("files")
        return json.dumps(row, ensure_ascii=False, sort_keys=True)

    return pd.Series([one(a, b) for a, b in zip(details, titles, strict=True)])


def audit_page(log: DataFrame, documents: DataFrame, event: str | None = None, username: str | None = None, limit: int = 500) -> DataFrame:
    """The newest events, of a kind and of users whose name holds a string (% and _ are wildcards), as shown and exported.

    Only the page, 5000 rows at most, is joined to documents (doc_id,
    original_name, analysis_level) and read as JSON.
    """
    rows = log.filter(F.col("event") == event) if event else log
    rows = rows.filter(F.col("username").like(f"%{username}%")) if username else rows
    page = rows.orderBy(F.col("id").desc()).limit(min(limit, 5000))
    field = lambda path: F.coalesce(F.get_json_object("details", f"$.{path}"), F.get_json_object("details", f"$.stats.{path}"), F.lit(""))
    of = page.withColumn("_doc", F.get_json_object("details", "$.document_id")).join(documents.select(F.col("doc_id").cast("string").alias("_doc"), "original_name", F.col("analysis_level").alias("_level")), "_doc", "left")
    level = field("analysis_level")
    shown = of.withColumn("treatment", field("treatment")).withColumn("analysis_level", F.when((level == "") & F.col("_doc").isNotNull(), F.coalesce("_level", F.lit("fast"))).otherwise(level))
    return shown.withColumn("details", _shown(F.col("details"), F.col("original_name"))).select(*AUDIT_COLUMNS)
