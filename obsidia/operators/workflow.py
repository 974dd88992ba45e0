"""Policies, visibility, states, retention, reports and audit, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import entity_table
from ..plans.tables import stored

#: Roles that see all documents; privilege decreases.
SEE_ALL = ("revisor", "aprobador", "auditor", "administrador")
ROLE_PRIORITY = ("administrador", "auditor", "aprobador", "revisor", "operador", "regular")
DONE = ("protected", "protected_with_warnings", "verification_failed", "failed")
NO_HASH = "0" * 64


def policy_matrix(types: DataFrame, policies: DataFrame) -> DataFrame:
    """document_type, ord, code, enabled of every type and category.

    types: document_type. policies: document_type, entity_code, enabled. A
    type's own rule goes before that of '*', which goes before 1. The catalogue
    has 15 rows, so each type is exploded into them and joined twice by equality.
    """
    catalogue = [(r["ord"], r["code"]) for r in entity_table(types.sparkSession).collect()]
    cells = types.select("document_type", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("code")) for i, c in catalogue])).alias("_c")).select("document_type", "_c.ord", "_c.code")
    own = policies.select("document_type", F.col("entity_code").alias("code"), F.col("enabled").alias("_own"))
    any_ = policies.filter("document_type = '*'").select(F.col("entity_code").alias("code"), F.col("enabled").alias("_any"))
    return cells.join(own, ["document_type", "code"], "left").join(F.broadcast(any_), "code", "left").select("document_type", "ord", "code", F.coalesce("_own", "_any", F.lit(1)).alias("enabled"))


def effective_entities(types: DataFrame, policies: DataFrame) -> DataFrame:
    """document_type, entities: enabled categories in catalogue order (15 at most)."""
    on = policy_matrix(types, policies).filter("enabled <> 0").groupBy("document_type").agg(F.array_sort(F.collect_list(F.struct("ord", "code"))).alias("_c"))
    empty = F.array().cast("array<string>")
    return types.select("document_type").join(on, "document_type", "left").select("document_type", F.coalesce(F.transform("_c", lambda x: x["code"]), empty).alias("entities"))


def visible(documents: DataFrame, username: str, role: str) -> DataFrame:
    """Documents that a user may see."""
    return documents if role in SEE_ALL else documents.filter(F.col("uploaded_by") == username)


def listed(documents: DataFrame, findings: DataFrame, username: str, role: str, status: str | None = None, batch_id=None, limit: int = 1000) -> DataFrame:
    """Visible documents that match, newest first, with their counts of findings; at most `limit`."""
    shown = visible(documents, username, role)
    if status:
        shown = shown.filter(F.col("status") == status)
    if batch_id is not None:
        shown = shown.filter(F.col("batch_id") == batch_id)
    page = shown.orderBy(F.col("created_at").desc_nulls_first(), "doc_id").limit(limit)
    return page.join(finding_counts(findings), "doc_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0))).withColumn("n_accepted", F.coalesce("n_accepted", F.lit(0)))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("status").isin("accepted", "edited")).alias("n_accepted"))


def batch_report(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """A row a document: its accepted findings, and whether its verification warns."""
    counts = finding_counts(findings).select("doc_id", "n_accepted")
    warns = ~F.coalesce(F.col("verified"), F.lit(True))
    return documents.join(counts, "doc_id", "left").select(
        "doc_id", "batch_id", "name", "format", "treatment", "status", "pages",
        F.coalesce("n_accepted", F.lit(0)).alias("accepted"), "uploaded_by", "created_at", "protected_at",
        F.when(warns, "sí").otherwise("no").alias("warning"),
    )


def status_counts(rows: DataFrame, group: str, states: list[str]) -> DataFrame:
    """One row a group, one column a state."""
    return rows.groupBy(group).agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def completed_status(verified: Column) -> Column:
    return F.when(verified, "protected").otherwise("protected_with_warnings")


def requeued(documents: DataFrame) -> DataFrame:
    """Documents after a restart: status, and what is to be done again (process, protect, approve; else null)."""
    s, sub, dec = F.col("status"), F.col("submitted_at"), F.col("decision_at")
    undecided = sub.isNotNull() & dec.isNull()
    redo = (
        F.when(s.isin("uploaded", "processing"), "process")
        .when((s == "submitted") | ((s == "protecting") & undecided), "approve")
        .when((s == "approved") | ((s == "protecting") & sub.isNull()), "protect")
    )
    old = (s == "verification_failed") & F.col("verified").isNotNull()
    status = F.when(redo == "process", "uploaded").when(redo == "approve", "submitted").when(redo == "protect", "approved").when(old & undecided, "pending_approval").when(old, completed_status(F.col("verified"))).otherwise(s)
    return documents.withColumn("redo", redo).withColumn("status", status)


def retention(documents: DataFrame, now: Column, days_original: int = 30, days_protected: int = 365) -> DataFrame:
    """doc_id, drop_original, drop_protected of documents that are done; protected_at as ISO text or timestamp."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("protected_at").try_cast("timestamp"))) / 86400
    aged = documents.filter(F.col("status").isin(*DONE)).withColumn("_age", age).filter("_age is not null")
    return aged.select("doc_id", (F.col("_age") > days_original).alias("drop_original"), (F.col("_age") > days_protected).alias("drop_protected"))


def stale(files: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Temporary files (path, modificationTime) older than an hour."""
    return files.filter(F.unix_timestamp(now) - F.unix_timestamp("modificationTime") > seconds)


def overlay(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of changes put over it: non-null columns replace, unknown keys are added."""
    own = [c for c in table.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in own if c in changes.columns])
    joined = table.join(new, keys, "full")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in own]).select(*table.columns)


def role_of(claims: DataFrame, default: str | None = None) -> DataFrame:
    """username, role from rows (username, role): the most privileged known one, else the default."""
    order = F.create_map(*[F.lit(x) for pair in zip(ROLE_PRIORITY, range(len(ROLE_PRIORITY)), strict=True) for x in pair])
    best = claims.groupBy("username").agg(F.min_by("role", order[F.col("role")]).alias("role"))
    return best.select("username", F.coalesce("role", F.lit(default)).alias("role"))


def live_sessions(sessions: DataFrame, users: DataFrame, now: float) -> DataFrame:
    """token, user of every unexpired session of an active user."""
    return sessions.filter(F.col("expires") > now).join(users.filter("active = 1"), sessions["user_id"] == users["id"]).select("token", "username", "role", "expires")


def _digest(prev: Column) -> Column:
    parts = [prev, F.col("ts"), F.col("username"), F.coalesce(F.col("ip"), F.lit("None")), F.col("event"), F.col("details")]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]).cast("binary"), 256)


def audit_breaks(log: DataFrame, chain: list[str] = []) -> DataFrame:  # noqa: B006
    """chain..., ok, broken_at: the first row of each chain whose hash or link is wrong.

    log: id, ts, username, ip, event, details, prev_hash, hash as stored text. A
    row's own digest needs the row alone; its link needs the hash of the row
    before, which comes from the ids' order dealt by range: each range looks
    back in itself, and the first row of a range to the last row of the ranges
    before it. So one chain of any length is checked by many tasks.
    """
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(log.repartitionByRange(n, *chain, "id").withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(*chain, "_range").orderBy("id")
    ends = ranged.groupBy(*chain, "_range").agg(F.max_by("hash", "id").alias("_last"))
    across = Window.partitionBy(*chain).orderBy("_range")
    carried = ends.select(*chain, "_range", F.lag("_last").over(across).alias("_carried"))
    before = F.coalesce(F.lag("hash").over(own), F.col("_carried"), F.lit(NO_HASH))
    seen = ranged.join(carried, [*chain, "_range"]).withColumn("_before", before)
    wrong = ~F.col("prev_hash").eqNullSafe(F.col("_before")) | ~F.col("hash").eqNullSafe(_digest(F.col("_before")))
    first = F.min(F.when(wrong, F.col("id")))
    out = seen.groupBy(*chain) if chain else seen.groupBy()
    return out.agg(first.alias("broken_at")).withColumn("ok", F.col("broken_at").isNull())


def chain_events(events: DataFrame, chain: str = "chain") -> DataFrame:
    """prev_hash and hash of each chain's events in order of id.

    Each hash needs the last, so a chain is sequential by nature: a fold in one
    task over rows that stream through it, not gathered. What a row says is put
    together in Spark; the fold itself hashes one string a row, so a chain's
    rate is that of one task, and chains are spread over all.
    """
    import hashlib

    columns = [chain, "id", "ts", "username", "ip", "event", "details"]
    text = [F.col(c).cast("string").alias(c) for c in columns[2:]]
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns[2:]])
    ordered = events.select(F.col(chain), F.col("id").cast("long").alias("id"), *text, said.alias("_said"))
    schema = ", ".join(f"{c} {kind}" for c, kind in ordered.dtypes if c != "_said") + ", prev_hash string, hash string"

    def run(batches):
        last, prev = None, NO_HASH
        for rows in batches:
            links = []
            for own, line in zip(rows[chain], rows["_said"], strict=True):
                prev = NO_HASH if last is None or own != last else prev
                links.append((prev, hashlib.sha256(f"{prev}|{line}".encode()).hexdigest()))
                last, prev = own, links[-1][1]
            yield rows.drop(columns="_said").assign(prev_hash=[p for p, _ in links], hash=[h for _, h in links])

    return ordered.repartition(chain).sortWithinPartitions(chain, "id").mapInPandas(run, schema)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Are two tables equal as multisets of rows?"""
    rows = lambda df: df.select(F.xxhash64(*sorted(df.columns)).alias("h"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("s")).groupBy("h", "s").count()
    return rows(a).exceptAll(rows(b)).isEmpty() and rows(b).exceptAll(rows(a)).isEmpty()
