from datetime import timedelta

from pyspark.sql import functions as F

from ledgerline.operators import history
from ledgerline.session import shared_path
from ledgerline.sources import bills, pages
from ledgerline.streaming import feeds


def land(spark, df, parts):
    path = shared_path(spark, "landed")
    for i in range(parts):
        df.filter(F.floor(F.col("seq") % 1000 / 100) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_of_several_batches_equals_batch(spark):
    rows = spark.range(300).select(
        (F.col("id") % 5).alias("document_id"), F.col("id").alias("seq"), F.col("id").alias("at"),
        F.sha2((F.col("id") % 7 % 3).cast("string"), 256).alias("sha256"),
    )
    path = land(spark, rows, 3)
    out = shared_path(spark, "out")
    stream = feeds.landed(spark, path, rows.schema, files_per_batch=1)
    feeds.run_batches(feeds.document_changes(stream), feeds.append_to(out), out + "-cp")
    found = spark.read.parquet(out)
    assert found.select("batch_id").distinct().count() == 3
    expected = history.revision_log(rows, ["document_id"], ["at", "seq"]).select("document_id", "seq", "sha256", "previous_sha256")
    got = found.select(*expected.columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_watch_events_are_emitted_once(spark):
    rows = spark.range(300).select(
        (F.col("id") % 4).alias("bill_id"), F.lit("new_action").alias("event_type"),
        (F.col("id") % 10).cast("string").alias("event_key"), F.col("id").alias("seq"),
    )
    path = land(spark, rows, 3)
    rules = spark.createDataFrame(
        [(1, True, "bill", "US", 119, "hr", "0", None), (2, True, "congress", "US", 119, None, None, None), (3, False, "congress", "US", 119, None, None, None)],
        "rule_id long, active boolean, target_type string, jurisdiction string, congress int, bill_type string, bill_number string, session string",
    )
    known = spark.createDataFrame([(i, "US", "119", 119, "hr", str(i)) for i in range(4)],
        "bill_id long, jurisdiction string, session_code string, congress int, bill_type string, bill_number string")
    out = shared_path(spark, "events")
    stream = feeds.landed(spark, path, rows.schema, files_per_batch=1)
    progress = feeds.run_batches(feeds.watch_events(stream, rules, known), feeds.append_to(out), out + "-cp")
    assert len(progress) >= 3
    found = spark.read.parquet(out)
    assert found.count() == found.dropDuplicates(["rule_id", "event_type", "event_key"]).count()
    assert {r["rule_id"]: r["count"] for r in found.groupBy("rule_id").count().collect()} == {1: 5, 2: 10}


def test_weekly_windows_start_on_monday(spark):
    rows = spark.createDataFrame([("2024-01-07 10:00:00", 1), ("2024-01-08 10:00:00", 101)], "t string, seq long").select(
        F.to_timestamp("t").alias("ts"), "seq")
    path = land(spark, rows, 2)
    out = shared_path(spark, "weekly")
    counts = feeds.weekly_counts(feeds.landed(spark, path, rows.schema), [])
    feeds.run_batches(counts, feeds.append_to(out), out + "-cp", mode="update")
    weeks = {str(r["week"]): r["events"] for r in feeds.newest_update(spark.read.parquet(out), ["week"]).collect()}
    assert weeks == {"2024-01-01": 1, "2024-01-08": 1}


def test_pages_and_frontier(spark):
    rows = spark.createDataFrame([
        (1, "https://a.org/", "<title>T</title><h1>Head <b>line</b></h1><script>x</script><p>Text</p><a href='/budget'>The budget</a><a href='https://b.org/budget'>b</a>"),
        (2, "https://a.org/budget", "<p>Two</p><a href='memo'>budget memo</a><a href='/'>budget home</a>"),
        (3, "https://a.org/memo", "<title>Only title</title>"),
    ], "page_id long, url string, html string")
    read = pages.page_texts(rows)
    first = read.filter("page_id = 1").first()
    assert first["title"] == "Head line" and "Text" in first["text"] and "x" not in first["text"].split("\n")
    found = pages.frontier(read, read.filter("page_id = 1").select("url"), ["a.org"], ["budget"], depth=2)
    assert {(r["url"], r["depth"]) for r in found.collect()} == {
        ("https://a.org/", 0), ("https://a.org/budget", 1), ("https://a.org/memo", 2)}


def test_history_index_lists_each_bill_once(spark):
    rows = spark.createDataFrame([(1, "x/HB00009.xml HC00002.XML HB 9 and SB 12 HB00009.xml")], "id long, raw string")
    found = bills.history_index(rows, ["id"]).orderBy("pos").collect()
    assert [(r["bill_type"], r["number"]) for r in found] == [("HB", "9"), ("HCR", "2"), ("SB", "12")]
    assert bills.history_index(rows, ["id"], limit=2).count() == 2


def test_only_changed_buckets_are_rebuilt_and_emptied(spark):
    store, path = shared_path(spark, "store"), shared_path(spark, "buckets")
    asked = []

    def build(rows):
        asked.append({r.bucket for r in rows.select("bucket").distinct().collect()})
        return rows.groupBy("bucket", "bill_id").agg(F.sum("amount").alias("amount")).filter("amount > 0")

    handle = feeds.refresh_changed(build, store, path, buckets=50)
    first = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "bill_id long, amount int")
    handle(first, 0)
    second = spark.createDataFrame([(2, -5), (3, 1)], "bill_id long, amount int")
    for _ in range(2):  # a repeated batch replaces its own rows
        handle(second, 1)
    assert {(r.bill_id, r.amount) for r in spark.read.parquet(path).collect()} == {(1, 5), (3, 6)}
    buckets = {r.bill_id: r.b for r in first.select("bill_id", F.pmod(F.xxhash64("bill_id"), F.lit(50)).alias("b")).collect()}
    assert asked == [set(buckets.values())] + 2 * [{buckets[2], buckets[3]}]


def at(day, hour=0):
    return f"2024-01-{day:02d} {hour:02d}:00:00"


def test_recent_events_have_bounded_state(spark):
    """Repeated batches and late rows emit nothing; keys that are gone leave the state."""
    files = [
        [("a", at(1)), ("b", at(1)), ("a", at(2))],
        [("a", at(3)), ("c", at(4)), ("a", at(3, 1))],
        [("a", at(3)), ("c", at(4)), ("a", at(3, 1))],  # the batch once more
        [("a", at(20)), ("d", at(20))],
        [("b", at(21)), ("c", at(1)), ("a", at(19, 12))],  # c is too late, a late but in order of its key
        [("e", at(30))],
    ]
    path = shared_path(spark, "landed")
    for rows in files:
        spark.createDataFrame(rows, "key string, t string").select("key", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    out = shared_path(spark, "recent")
    stream = feeds.landed(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    progress = feeds.run_batches(feeds.recent(stream, ["key"], "ts", timedelta(days=5)), feeds.append_to(out), out + "-cp")
    found = spark.read.parquet(out).select("key", F.date_format("ts", "d").cast("int").alias("day")).collect()
    assert sorted((r.key, r.day) for r in found) == [("a", 1), ("a", 20), ("b", 1), ("b", 21), ("c", 4), ("d", 20), ("e", 30)]
    assert len({r.batch_id for r in spark.read.parquet(out).collect()}) >= 3
    values = [p["stateOperators"][0]["customMetrics"] for p in progress if p["stateOperators"]]
    assert values
    last = next(p for p in reversed(progress) if p["stateOperators"])
    # Of five keys only the last one is remembered: its time and its timer.
    assert last["stateOperators"][0]["numRowsTotal"] <= 3
