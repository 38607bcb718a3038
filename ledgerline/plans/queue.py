"""The review queue: what a person should look at next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import history
from ledgerline.plans import listing, packets

ACTIVE = ["new", "reviewing", "needs_evidence"]
SECTION = ["bill_id", "version_id", "section_id"]
FRESH = ["trigger_types", "unresolved_gaps", "entry_count"]


def sync(queue: DataFrame, built: DataFrame, now) -> DataFrame:
    """The queue after a packet build.

    A new hash adds a `new` item, a known one is refreshed, and active items of
    the same section with another hash become `superseded`. Status and notes of a
    person are kept.
    """
    at = F.lit(now).cast("timestamp")
    incoming = built.select(*packets.PACKET_KEY, F.struct(*FRESH).alias("new"))
    joined = queue.withColumn("old", F.struct(*[c for c in queue.columns if c not in packets.PACKET_KEY])).select(
        *packets.PACKET_KEY, "old"
    ).join(incoming, packets.PACKET_KEY, "full_outer")
    rebuilt = built.select(*SECTION).distinct().withColumn("_rebuilt", F.lit(True))
    rows = joined.join(rebuilt, SECTION, "left")
    fresh, known = F.col("new").isNotNull(), F.col("old").isNotNull()
    replaced = ~fresh & F.coalesce("_rebuilt", F.lit(False)) & F.col("old.status").isin(ACTIVE)
    status = F.when(~known, "new").when(replaced, "superseded").otherwise(F.col("old.status"))
    return rows.select(
        *packets.PACKET_KEY,
        status.alias("status"),
        *[F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in FRESH],
        F.col("old.analyst_notes").alias("analyst_notes"),
        F.coalesce("old.created_at", at).alias("created_at"),
        F.when(fresh | replaced, at).otherwise(F.col("old.updated_at")).alias("updated_at"),
        F.when(fresh, at).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"),
    )


def update(queue: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies the last change per item; returns the queue and the refused changes.

    changes: key, status, analyst_notes, at. A superseded item takes notes but no
    status, and no status outside the list is accepted.
    """
    settable = ["new", "reviewing", "needs_evidence", "completed", "archived"]
    last = history.last_per_key(changes, packets.PACKET_KEY, ["at"]).select(
        *packets.PACKET_KEY,
        F.col("status").alias("_status"), F.col("analyst_notes").alias("_notes"), "at",
    )
    joined = queue.join(last, packets.PACKET_KEY, "left")
    unknown = F.col("_status").isNotNull() & ~F.col("_status").isin(settable)
    closed = F.col("_status").isNotNull() & (F.col("status") == "superseded")
    refused = joined.filter(unknown | closed).select(
        *packets.PACKET_KEY, "_status",
        F.when(unknown, "unknown status").otherwise("superseded items cannot be reopened").alias("reason"),
    )
    apply = F.col("at").isNotNull() & ~F.coalesce(unknown | closed, F.lit(False))
    updated = joined.withColumns(
        {
            "status": F.when(apply, F.coalesce("_status", "status")).otherwise(F.col("status")),
            "analyst_notes": F.when(apply, F.coalesce("_notes", "analyst_notes")).otherwise(F.col("analyst_notes")),
            "updated_at": F.when(apply, F.col("at")).otherwise(F.col("updated_at")),
        }
    ).drop("_status", "_notes", "at")
    return updated, refused


def next_step(queue: DataFrame) -> DataFrame:
    step = (
        F.when(F.col("status") == "superseded", "historical_record")
        .when(F.col("status").isin("completed", "archived"), "none")
        .when(F.size("unresolved_gaps") > 0, "resolve_evidence_gaps")
        .otherwise("review_packet")
    )
    return queue.withColumn("suggested_next_step", step)


def queue_view(queue: DataFrame, bills: DataFrame, versions: DataFrame, sections: DataFrame) -> DataFrame:
    return (
        next_step(queue)
        .join(bills.select("bill_id", "jurisdiction", "session_code", "bill_type", "bill_number", "title"), "bill_id", "left")
        .join(versions.select("version_id", "version_code", "issued_on"), "version_id", "left")
        .join(sections.select("section_id", "section_number", "heading"), "section_id", "left")
    )


def summary(queue: DataFrame) -> DataFrame:
    """Items by status, by trigger and by gap, counted in one pass."""
    facts = F.concat(
        F.array(F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value"))),
        F.transform("trigger_types", lambda t: F.struct(F.lit("trigger").alias("dimension"), t.alias("value"))),
        F.transform("unresolved_gaps", lambda g: F.struct(F.lit("gap").alias("dimension"), g.alias("value"))),
    )
    return (
        queue.select(F.explode(facts).alias("f"))
        .groupBy("f.dimension", "f.value")
        .agg(F.count(F.lit(1)).alias("items"))
    )


def listed(view: DataFrame, status: str | None = None, jurisdiction: str | None = None,
           bill_id: int | None = None, limit: int = 100) -> DataFrame:
    """Newest items first; `active` stands for the three open statuses."""
    rows = view
    if status == "active":
        rows = rows.filter(F.col("status").isin(ACTIVE))
    elif status:
        rows = rows.filter(F.col("status") == status)
    return listing.newest(
        rows, ["updated_at", "section_id", "packet_hash"], limit,
        jurisdiction=jurisdiction.upper() if jurisdiction else None, bill_id=bill_id,
    )
