"""Streams over landed files.

Every job reads files as they land, keeps its position in a checkpoint below the
shared folder and stops when nothing is left (`availableNow`) or runs on. Outputs
of `foreachBatch` go to one folder per batch id that is overwritten, so a batch
that is repeated after a failure leaves no second copy.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline.functions import text as T
from ledgerline.operators import classify, history
from ledgerline.plans import watch
from ledgerline.session import checkpointed, settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def landed(
    spark: SparkSession,
    path: str,
    schema: Ty.StructType,
    file_format: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream; `files_per_batch` bounds one batch."""
    reader = spark.readStream.format(file_format).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


#: State is kept on disk; only what a batch touches is in memory.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> list[dict]:
    """Handles all landed files, batch by batch; the progress of the last batches."""
    with settings(stream.sparkSession, STATE):
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(handle)
            .start()
        )
    query.awaitTermination()
    return [json.loads(progress.json) for progress in query.recentProgress]


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: write_batch(batch, batch_id, path)


def capture(split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: usable rows go to `path`/good, the others with their reason to `path`/quarantine.

    The files of a batch are parsed once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split(checkpointed(batch))
        write_batch(good, batch_id, f"{path}/good")
        write_batch(bad, batch_id, f"{path}/quarantine")

    return handle


# Weekly counts.
def weekly_counts(events: DataFrame, keys: list[str], at: str = "ts", late: str = "14 days") -> DataFrame:
    """Events per Monday-to-Sunday week; use output mode `update`."""
    week = F.window(F.col(at), "7 days", "7 days", "4 days")
    return (
        events.withWatermark(at, late)
        .groupBy(week.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.to_date("w.start").alias("week"), *keys, "events")
    )


def newest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key among the updates of all batches."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return (
        updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")
    )


# Changed documents.
CHANGE = "document_id long, seq long, sha256 string, previous_sha256 string"
LAST = "sha256 string"


def _changed(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Rows whose hash differs from the one before; the last hash is kept as state."""
    last = state.get[0] if state.exists else None
    rows = sorted(
        row for frame in frames for row in zip(frame["at"], frame["seq"], frame["sha256"])
    )
    found = []
    for _, seq, sha in rows:
        if sha != last:
            found.append((key[0], seq, sha, last))
        last = sha
    if rows:
        state.update((last,))
    yield pd.DataFrame(found, columns=["document_id", "seq", "sha256", "previous_sha256"])


def document_changes(observations: DataFrame) -> DataFrame:
    """Changed observations (document_id, seq, at, sha256) of a stream.

    The state of a document is one hash. `at` is a number, so order needs no clock.
    """
    return observations.select("document_id", "seq", "at", "sha256").groupBy("document_id").applyInPandasWithState(
        _changed, CHANGE, LAST, "append", GroupStateTimeout.NoTimeout
    )


# Change events.
def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key over the life of the stream; the state is the keys."""
    return events.dropDuplicates(keys)


class Recent(StatefulProcessor):
    """An event counts if its key was not seen for the time to live before it.

    The state of a key is the time it was last seen. A timer at the end of the
    time to live removes it, so the state holds only keys seen lately.
    """

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        last = held[0] if held else None
        times = np.sort(np.concatenate([frame["seen"].to_numpy() for frame in rows]))
        before = np.r_[times[0] - self.live_ms - 1 if last is None else last, times[:-1]]
        if last is not None:  # what comes after its successors changes nothing
            before = np.maximum(before, last)
        first = times[times - before > self.live_ms]
        newest = int(times[-1]) if last is None else max(last, int(times[-1]))
        if newest != last:
            if last is not None:
                self.handle.deleteTimer(last + self.live_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.live_ms)
        yield self._rows(key, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield self._rows(key, np.zeros(0, np.int64))

    @staticmethod
    def _rows(key: tuple, times: np.ndarray) -> pd.DataFrame:
        named = {f"k{i}": pd.Series([value] * len(times), dtype=object) for i, value in enumerate(key)}
        return pd.DataFrame({**named, "seen": pd.Series(times, dtype="int64")})

    def close(self) -> None:
        pass


def recent(events: DataFrame, keys: list[str], at: str, live: timedelta, late: str = "1 day") -> DataFrame:
    """(keys, at): events whose key was not seen for `live` before them, each once.

    A repeated batch and rows that come late but within `late` change nothing;
    rows that come later than that are dropped. Times are counted in
    milliseconds. The state is one time for each key seen within `live`.
    """
    names = [f"k{i}" for i in range(len(keys))]
    numbered = events.withWatermark(at, late).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(at).alias("moment"), F.unix_millis(at).alias("seen"))
    schema = Ty.StructType([*(Ty.StructField(n, events.schema[k].dataType) for k, n in zip(keys, names)), Ty.StructField("seen", Ty.LongType())])
    found = numbered.groupBy(*names).transformWithStateInPandas(Recent(int(live.total_seconds() * 1000)), schema, "Append", "EventTime")
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.timestamp_millis("seen").alias(at))


def watch_events(events: DataFrame, rules: DataFrame, bills: DataFrame) -> DataFrame:
    """Events of watched bills, each once per rule over the life of the stream.

    events: a stream of bill_id, event_type, event_key. Rules and bills are read
    anew by every batch; the state is the keys that were emitted.
    """
    return once(watch.for_rules(events, rules, bills), ["rule_id", "event_type", "event_key"])


def refresh_changed(
    build: Callable[[DataFrame], DataFrame], store: str, path: str, column: str = "bill_id", buckets: int = 1000
) -> Callable[[DataFrame, int], None]:
    """Batch handler: recomputes derived rows of the buckets whose bills changed.

    Landed rows are stored below `store` by bucket and batch; a repeated batch
    replaces its own. `build` gets all stored rows of the changed buckets, with
    their `bucket`, and returns the derived rows of those buckets; only their
    partitions below `path` are replaced. A changed bucket without rows is
    emptied. Buckets that did not change are neither read nor written.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
        landed = batch.withColumns({"bucket": bucket, "batch_id": F.lit(batch_id)})
        with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            landed.write.mode("overwrite").partitionBy("bucket", "batch_id").parquet(store)
        # At most `buckets` numbers.
        touched = [row["bucket"] for row in landed.select("bucket").distinct().collect()]
        if not touched:
            return
        places = [f"{store}/bucket={number}" for number in touched]
        stored = spark.read.schema(landed.schema).option("basePath", store).parquet(*places)
        rows = checkpointed(build(stored.drop("batch_id")))
        history.rebuild_partitions(rows, path, "bucket")
        left = {row["bucket"] for row in rows.select("bucket").distinct().collect()}
        for number in set(touched) - left:
            rows.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{path}/bucket={number}")

    return handle


def capture_latest(items: DataFrame, stored_actions: DataFrame, as_of) -> DataFrame:
    """Actions of this week named by a bill list and not stored yet.

    items: congress, type, number, title, action_date, action_text, seq.
    """
    monday = T.week_start(F.lit(as_of).cast("date"))
    named = items.withColumn("bill_type", classify.federal_type(F.col("type"))).filter(
        F.col("bill_type").isNotNull()
        & (F.coalesce("number", F.lit("")) != "")
        & (F.coalesce("action_text", F.lit("")) != "")
        & (T.iso_date(F.col("action_date")) >= monday)
    )
    rows = named.select(
        F.concat_ws(":", F.lit("US"), "congress", "bill_type", "number").alias("bill_key"),
        "title", "action_date", F.col("action_text").alias("text"), "seq",
        classify.federal_url(F.col("congress"), F.col("bill_type"), F.col("number")).alias("source_url"),
    )
    return history.insert_if_absent(stored_actions, rows, ["bill_key", "action_date", "text"], ["seq"])


# Running the sources.
def next_cursor(cursors: DataFrame, results: DataFrame) -> DataFrame:
    """Cursors after a run.

    results: source_key, items, total, failed (text or NULL). A failed source keeps
    its place; one that reached the end starts over in the next cycle.
    """
    batch = F.col("batch_size")
    at = F.col("offset") + F.col("items")
    complete = (F.col("items") == 0) | (F.col("items") < batch) | (at >= F.col("total"))
    failed = F.col("failed").isNotNull()
    ran = F.col("items").isNotNull() | failed
    return cursors.join(results, "source_key", "left").select(
        "source_key",
        "batch_size",
        F.when(~ran | failed, F.col("offset")).when(complete, 0).otherwise(at).alias("offset"),
        F.when(ran & ~failed & complete, F.col("cycle") + 1).otherwise(F.col("cycle")).alias("cycle"),
        F.when(~ran, F.col("status")).when(failed, "error").otherwise("idle").alias("status"),
        F.when(ran, F.col("failed")).otherwise(F.col("last_error")).alias("last_error"),
    )


def active_status(cursors: DataFrame, active: DataFrame, include_retired: bool = False) -> DataFrame:
    """Cursors of the sources still followed."""
    return cursors if include_retired else cursors.join(active.select("source_key"), "source_key", "left_semi")


def scan_statistics(records: DataFrame) -> DataFrame:
    """Records per source and batch by what happened to them (column `outcome`)."""
    outcome = F.col("outcome")
    return records.groupBy("source_key", "batch").agg(
        F.count(F.lit(1)).alias("enumerated"),
        F.count_if(outcome != "failed").alias("captured"),
        F.count_if(outcome == "changed").alias("changed"),
        F.count_if(outcome == "failed").alias("failed"),
    )


def scan_audit(rules: DataFrame, events: DataFrame, failures: DataFrame, scan_id: int, now) -> DataFrame:
    """One row per rule and scan: status, number of new events, error.

    A rule without events has completed; a failed rule leaves the others alone.
    """
    counted = events.groupBy("rule_id").agg(F.count(F.lit(1)).alias("new_events"))
    return (
        rules.filter("active").select("rule_id")
        .join(counted, "rule_id", "left")
        .join(failures.select("rule_id", "error"), "rule_id", "left")
        .select(
            "rule_id",
            F.lit(scan_id).alias("scan_id"),
            F.when(F.col("error").isNotNull(), "failed").otherwise("completed").alias("status"),
            F.coalesce("new_events", F.lit(0)).alias("new_events"),
            "error",
            F.lit(now).cast("timestamp").alias("last_scanned_at"),
        )
    )
