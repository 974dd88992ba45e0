"""The queue of bulk jobs: claims, retries and counts, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE_SECONDS = 1800
MAX_ATTEMPTS = 3
MAX_ACTIVE = 100_000


def claimable(now: Column) -> Column:
    return (F.col("status") == "queued") | ((F.col("status") == "processing") & (F.col("lease_until") < now))


def claim(items: DataFrame, now: float, k: int = 1, lease: int = LEASE_SECONDS) -> DataFrame:
    """items after the k lowest claimable ids are claimed; `claimed` tells which. k is a worker's own small number."""
    free = items.filter(claimable(F.lit(now))).select("id").orderBy("id").limit(k).withColumn("claimed", F.lit(True))
    joined = items.join(F.broadcast(free), "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return joined.select(
        *[
            F.when(F.col("claimed"), new).otherwise(F.col(c)).alias(c) if (new := {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "lease_until": F.lit(now + lease)}.get(c)) is not None else F.col(c)
            for c in items.columns
        ],
        "claimed",
    )


def finish(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """items after outcomes (id, outcome, error): done, verification_failed, permanent or transient.

    Attempts beyond the most, and permanent errors, fail; transient errors fail
    at the last attempt and else queue again without a lease. A closed item
    forgets its addresses, which are credentials.
    """
    joined = items.join(outcomes.select("id", "outcome", F.col("error").alias("_error")), "id", "left")
    o, n = F.col("outcome"), F.col("attempts")
    status = (
        F.when(o.isNull() | (F.col("status") != "processing"), F.col("status"))
        .when(n > MAX_ATTEMPTS, "failed")
        .when(o.isin("done", "verification_failed"), o)
        .when((o == "permanent") | (n >= MAX_ATTEMPTS), "failed")
        .otherwise("queued")
    )
    acted = o.isNotNull() & (F.col("status") == "processing")
    out = joined.withColumn("_status", status)
    closed = acted & (F.col("_status") != "queued")
    new = {
        "status": F.col("_status"),
        "lease_until": F.when(acted & (F.col("_status") == "queued"), F.lit(None)).otherwise(F.col("lease_until")),
        "error": F.when(acted & (n > MAX_ATTEMPTS), "Reintentos agotados").when(acted, F.col("_error")).otherwise(F.col("error")),
        "source_url": F.when(closed, F.lit(None)).otherwise(F.col("source_url")),
        "target_url": F.when(closed, F.lit(None)).otherwise(F.col("target_url")),
    }
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in items.columns])


def cancel(items: DataFrame, job_id) -> DataFrame:
    """items with the job's queued ones cancelled."""
    hit = (F.col("job_id") == job_id) & (F.col("status") == "queued")
    return items.select(*[(F.when(hit, F.lit("cancelled" if c == "status" else None)).otherwise(F.col(c)).alias(c) if c in ("status", "source_url", "target_url") else F.col(c)) for c in items.columns])


def job_counts(items: DataFrame) -> DataFrame:
    """job_id, a count for each state, finished (nothing queued or processing)."""
    from ..catalog import ITEM_STATES

    counts = items.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ITEM_STATES])
    return counts.withColumn("finished", (F.col("queued") + F.col("processing")) == 0)


def has_room(items: DataFrame, more: int, most: int = MAX_ACTIVE) -> bool:
    return items.filter(F.col("status").isin("queued", "processing")).limit(most + 1).count() + more <= most


def allowed(items: DataFrame, hosts: list[str], column: str = "source_url") -> DataFrame:
    """items whose address is http(s) on one of the hosts."""
    url = F.col(column)
    return items.filter(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*[h.lower() for h in hosts]))


def queue_page(items: DataFrame, job_id, limit: int = 1000, offset: int = 0) -> DataFrame:
    return items.filter(F.col("job_id") == job_id).orderBy("id").offset(offset).limit(min(limit, 5000))
