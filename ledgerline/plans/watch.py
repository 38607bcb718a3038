"""Watch rules and the change events they report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import classify, history

TARGET = ["target_type", "jurisdiction", "congress", "bill_type", "bill_number", "session"]
EVENT_KEY = ["rule_id", "event_type", "event_key"]


def validated(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized valid rules, and the others with what is wrong with them."""
    problem = classify.watch_problem({c: F.col(c) for c in TARGET})
    named = rules.withColumns(
        {
            "jurisdiction": F.upper("jurisdiction"),
            "bill_type": F.lower("bill_type"),
            "problem": problem,
        }
    )
    return named.filter("problem IS NULL").drop("problem"), named.filter("problem IS NOT NULL")


def upsert_rules(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One rule per target; a repeated request re-activates it and sets its flags.

    The session is part of the target for session rules only.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("session", F.when(F.col("target_type") == "session", F.col("session")))

    both = keyed(stored.withColumn("_new", F.lit(False))).unionByName(
        keyed(incoming.withColumn("active", F.lit(True)).withColumn("_new", F.lit(True)))
    )
    at = F.struct("_new", "seq")
    return both.groupBy(*TARGET).agg(
        F.min_by("name", at).alias("name"),
        F.max_by("auto_research", at).alias("auto_research"),
        F.max_by("auto_report", at).alias("auto_report"),
        F.max_by("active", at).alias("active"),
        F.min_by("seq", at).alias("seq"),
    )


def patch_rules(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Sets the flags a patch gives (rule_id, active, auto_research, auto_report, at)."""
    flags = ["active", "auto_research", "auto_report"]
    last = patches.groupBy("rule_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f"_{f}") for f in flags]
    )
    joined = rules.join(last, "rule_id", "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in flags}).drop(*[f"_{f}" for f in flags])


def changes(bills_before: DataFrame, bills_after: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Typed events between two states.

    bills: bill_id, bill_key. children: bill_id, kind, key with kind version,
    action, document or amendment. A bill seen first yields one event of its own
    and none for its children.
    """
    keys = ["bill_id", "kind", "key"]
    known = bills_before.select("bill_id")
    found = bills_after.join(known, "bill_id", "left_anti").select(
        "bill_id", F.lit("bill_discovered").alias("event_type"), F.col("bill_key").alias("event_key")
    )
    fresh = after.select(*keys).distinct()
    old = before.select(*keys)
    added = fresh.join(old, history.same_key(fresh, old, keys), "left_anti").join(known, "bill_id", "left_semi")
    return found.unionByName(
        added.select("bill_id", F.concat(F.lit("new_"), "kind").alias("event_type"), F.col("key").alias("event_key"))
    )


def for_rules(events: DataFrame, rules: DataFrame, bills: DataFrame) -> DataFrame:
    """Events of the bills each active rule covers.

    A bill rule names a bill, a session rule a session, a congress rule all federal
    bills of a congress: three equi-joins rather than one join on alternatives.
    """
    named = events.join(
        bills.select("bill_id", "jurisdiction", "session_code", "congress", "bill_type", "bill_number"), "bill_id"
    )
    live = rules.filter("active")
    shown = ["rule_id", "bill_id", "event_type", "event_key"]
    session = F.coalesce(F.col("session"), F.col("congress").cast("string"))
    by_bill = live.filter("target_type = 'bill'").select(
        "rule_id", "jurisdiction", "bill_type", "bill_number", session.alias("session_code")
    )
    by_session = live.filter("target_type = 'session'").select(
        "rule_id", "jurisdiction", F.col("session").alias("session_code")
    )
    by_congress = live.filter("target_type = 'congress'").select("rule_id", F.lit("US").alias("jurisdiction"), "congress")
    return (
        named.join(by_bill, ["jurisdiction", "session_code", "bill_type", "bill_number"]).select(shown)
        .unionByName(named.join(by_session, ["jurisdiction", "session_code"]).select(shown))
        .unionByName(named.join(by_congress, ["jurisdiction", "congress"]).select(shown))
    )


def unseen(emitted: DataFrame, events: DataFrame) -> DataFrame:
    """Events not emitted before, each once."""
    fresh = events.dropDuplicates(EVENT_KEY)
    return fresh.join(emitted.select(*EVENT_KEY), EVENT_KEY, "left_anti")
