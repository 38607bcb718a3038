"""Merging observations into current rows and append-only history.

Every choice of one row per key is a `min_by` or `max_by` aggregate, which
combines on the map side: a hot key sends one row per task to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import ordered


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on all keys, NULL equal to NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by `order`, NULLs first."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current and incoming rows, the last one of a key wins."""
    return last_per_key(current.unionByName(incoming), keys, order)


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Incoming rows whose key is new, the first one of a key wins."""
    fresh = first_per_key(incoming, keys, order)
    known = existing.select(*keys)
    return fresh.join(known, same_key(fresh, known, keys), "left_anti")


BILL_KEY = ["jurisdiction", "session_code", "bill_type", "bill_number"]


def bill_key() -> Column:
    """Stable text key of a bill."""
    return F.concat_ws(
        ":", F.upper("jurisdiction"), "session_code", F.lower("bill_type"), "bill_number"
    )


def merge_bills(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per bill; incoming title, action and metadata replace the stored ones.

    `metadata` is a map. Session, source address and source system are always
    part of the metadata of an incoming bill.
    """
    new = incoming.withColumn("bill_type", F.lower("bill_type")).withColumn(
        "bill_number", F.col("bill_number").cast("string")
    )
    added = F.create_map(
        F.lit("jurisdiction_session"), F.col("session_code"),
        F.lit("source_url"), F.col("source_url"),
        F.lit("source_system"), F.col("source_system"),
    )
    kept = F.map_filter(
        F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        lambda k, v: ~k.isin("jurisdiction_session", "source_url", "source_system"),
    )
    new = last_per_key(
        new.withColumn("metadata", F.map_concat(kept, added)), BILL_KEY, ["seq"]
    ).select(
        *BILL_KEY,
        F.struct("title", "latest_action", "metadata").alias("new"),
    )
    old = existing.select(*BILL_KEY, F.struct("title", "latest_action", "metadata").alias("old"))
    joined = old.join(new, BILL_KEY, "full_outer")
    from_new = F.col("new").isNotNull()
    return joined.select(
        *BILL_KEY,
        *[
            F.when(from_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
            for c in ("title", "latest_action", "metadata")
        ],
        F.col("old").isNull().alias("created_bill"),
    )


def child_key(kind: str) -> Column:
    """Text key of a bill's version, action, amendment or document, as watches compare them."""
    parts = {
        "version": ["sha256"], "action": ["action_date", "text"],
        "amendment": ["amendment_type", "amendment_number"], "document": ["document_type", "source_url"],
    }
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in parts[kind]])


def with_text_hash(versions: DataFrame, text: str = "text") -> DataFrame:
    body = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    return versions.withColumn(text, body).withColumn("sha256", F.sha2(F.col(text), 256))


def append_versions(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Versions with a text not yet stored under the same bill and code."""
    hashed = with_text_hash(incoming.filter(F.col("text").isNotNull()))
    return insert_if_absent(existing, hashed, ["bill_id", "version_code", "sha256"], order)


def revision_log(
    observations: DataFrame,
    keys: list[str],
    order: list[str],
    distinct_hash: bool = False,
    rows_per_task: int = ordered.ROWS_PER_TASK,
) -> DataFrame:
    """Observations that changed a document.

    By default a return to an earlier text is a revision of its own;
    `distinct_hash` keeps the first observation of each text only.
    """
    if distinct_hash:
        return first_per_key(observations, [*keys, "sha256"], order)
    seen = ordered.previous(
        observations, keys, order, {"previous_sha256": "sha256"}, rows_per_task
    )
    changed = ~F.col("sha256").eqNullSafe(F.col("previous_sha256"))
    return seen.filter(changed)


def revision_listing(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Revisions of each document, the newest first, with their place."""
    return ordered.positions(log, keys, [F.col(c).desc() for c in order], "place")


def current_documents(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Current row of each observed document.

    Title: the last one given. Dates: first and last observation, and the first
    meeting date found. Text: the last one.
    """
    at = F.struct("observed_at", "seq")
    titled = F.when(F.coalesce("title", F.lit("")) != "", at)
    dated = F.when(F.col("meeting_date").isNotNull(), at)
    return observations.groupBy(*keys).agg(
        F.max_by("title", titled).alias("title"),
        F.min_by("meeting_date", dated).alias("meeting_date"),
        F.max_by("sha256", at).alias("sha256"),
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"),
        F.count(F.lit(1)).alias("observations"),
    )


def latest_versions(versions: DataFrame, keys: list[str] = ["bill_id"]) -> DataFrame:  # noqa: B006
    """The newest version of each bill; an undated one is newest, then the higher id."""
    marked = versions.withColumn("_undated", F.col("issued_on").isNull())
    return last_per_key(marked, keys, ["_undated", "issued_on", "version_id"]).drop("_undated")


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Entity nodes from mentions (entity_type, name, external_ids, metadata, seq).

    The first mention names the entity; of ids and metadata under the same name
    the last one counts.
    """
    keyed = mentions.withColumn("normalized_name", T.normalize_name(F.col("name")))
    key = ["entity_type", "normalized_name"]
    nodes = keyed.groupBy(*key).agg(
        F.min_by(T.strip(F.col("name")), "seq").alias("canonical_name"),
        F.count(F.lit(1)).alias("mentions"),
    )

    def merged(column: str) -> DataFrame:
        entries = keyed.select(*key, "seq", F.explode(column).alias("k", "v"))
        last = entries.groupBy(*key, "k").agg(F.max_by("v", "seq").alias("v"))
        return last.groupBy(*key).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column)
        )

    empty = F.create_map().cast("map<string,string>")
    return (
        nodes.join(merged("external_ids"), key, "left")
        .join(merged("metadata"), key, "left")
        .withColumn("external_ids", F.coalesce("external_ids", empty))
        .withColumn("metadata", F.coalesce("metadata", empty))
        .withColumn("entity_id", F.xxhash64(*key))
    )


def backfill_session(bills: DataFrame) -> DataFrame:
    """Fills a missing session code from the metadata, else from the congress number."""
    stored = F.get_json_object("metadata_json", "$.jurisdiction_session")
    return bills.withColumn(
        "session_code",
        F.coalesce(
            F.nullif(F.col("session_code"), F.lit("")),
            F.nullif(stored, F.lit("")),
            F.col("congress").cast("string"),
        ),
    )


def rebuild_partitions(derived: DataFrame, path: str, column: str) -> None:
    """Replaces the partitions of a derived table that `derived` covers, no others."""
    (
        derived.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )
