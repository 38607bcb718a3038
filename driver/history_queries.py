"""Merges, revisions and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import corpus
from driver.base import query, table, texts, view
from ledgerline.functions import text as T
from ledgerline.operators import canonical, history, lineage, ordered, sections as S


@query(
    "version_append",
    """
    WITH h AS (SELECT doc_id, source, lang, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256 FROM documents),
    old AS (SELECT DISTINCT source, lang, sha256 FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT source AS bill_id, lang AS version_code, sha256, min(doc_id) AS version_id
    FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      AND (source, lang, sha256) NOT IN (SELECT (source, lang, sha256) FROM old)
    GROUP BY ALL
    """,
)
def version_append(spark, sf_dir):
    """Labelled documents are stored versions, the others arrive."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    named = texts(spark, sf_dir, "documents").select(
        F.col("source").alias("bill_id"), F.col("lang").alias("version_code"),
        F.col("doc_id").alias("version_id"), "text", "doc_id",
    )
    stored = history.with_text_hash(named.join(labelled, "doc_id", "left_semi"))
    arriving = named.join(labelled, "doc_id", "left_anti").drop("doc_id")
    return history.append_versions(stored, arriving, ["version_id"]).drop("text")


@query(
    "latest_version",
    f"SELECT bill_id, version_id, version_code, issued_on FROM ({corpus.LATEST}) AS latest",
)
def latest_version(spark, sf_dir):
    heads = corpus.version_heads(spark, sf_dir).drop("source_url")
    return history.latest_versions(heads)


@query(
    "version_pairs",
    f"""
    SELECT bill_id, version_id, lag(version_id) OVER w AS from_version_id,
      lag(version_code) OVER w AS from_version_code
    FROM ({corpus.VERSION_HEADS}) AS heads
    WINDOW w AS (PARTITION BY bill_id ORDER BY CASE WHEN issued_on IS NULL THEN 1 ELSE 0 END, issued_on, version_id)
    """,
)
def version_pairs(spark, sf_dir):
    pairs = lineage.version_pairs(corpus.version_heads(spark, sf_dir))
    return pairs.select("bill_id", "version_id", "from_version_id", "from_version_code")


OBSERVED = """
SELECT user_id, event_id AS seq, ts AS observed_at, event_type AS title,
  CASE WHEN event_type = 'view' THEN CAST(CAST(ts AS DATE) AS STRING) ELSE NULL END AS meeting_date,
  props AS text
FROM events
"""


def _observations(spark, sf_dir):
    seen = view(spark, sf_dir, OBSERVED)
    return seen.withColumn("sha256", F.sha2("text", 256)).withColumn(
        "title", F.when(F.col("title") != "error", F.col("title"))
    )


@query(
    "revision_log",
    """
    WITH o AS (SELECT user_id, event_id AS seq, ts, sha256(props) AS sha256 FROM events),
    p AS (SELECT *, lag(sha256) OVER (PARTITION BY user_id ORDER BY ts, seq) AS previous_sha256 FROM o)
    SELECT user_id, seq, sha256, previous_sha256 FROM p WHERE sha256 IS DISTINCT FROM previous_sha256
    """,
)
def revision_log(spark, sf_dir):
    log = history.revision_log(_observations(spark, sf_dir), ["user_id"], ["observed_at", "seq"])
    return log.select("user_id", "seq", "sha256", "previous_sha256")


@query(
    "revision_listing",
    """
    WITH o AS (SELECT user_id, event_id AS seq, ts, sha256(props) AS sha256 FROM events),
    p AS (SELECT *, lag(sha256) OVER (PARTITION BY user_id ORDER BY ts, seq) AS previous_sha256 FROM o)
    SELECT user_id, seq, sha256, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS place FROM p WHERE sha256 IS DISTINCT FROM previous_sha256
    """,
)
def revision_listing(spark, sf_dir):
    """Revisions of each document, the newest first."""
    log = history.revision_log(_observations(spark, sf_dir), ["user_id"], ["observed_at", "seq"])
    return history.revision_listing(log, ["user_id"], ["observed_at", "seq"]).select("user_id", "seq", "sha256", "place")


# Nested payloads: rows are named by ids, which are no content; two writers order and space them differently.
PAYLOADS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN
    '{"id":' || CAST(o_orderkey AS STRING) || ',"title":"' || o_orderpriority || '","rate":0.25,"open":true,"bill":{"bill_id":' || CAST(o_custkey AS STRING) || ',"status":"' || o_orderstatus
    || '","order_ids":[1,2],"notes":[]},"items":[{"item_id":7,"qty":' || CAST(o_custkey % 9 AS STRING) || ',"tags":["a",null]},{"qty":2.5,"tags":{}}]}'
  ELSE
    '{ "items": [ {"tags": ["a", null], "qty": ' || CAST(o_custkey % 9 AS STRING) || '}, {"tags": {}, "qty": 2.50, "part_id": {"deep": 1}} ], "open": true, "rate": 0.250, "title": "' || o_orderpriority
    || '", "bill": {"notes": [], "status": "' || o_orderstatus || '"} }' END AS payload FROM orders
"""


@query(
    "content_hashes",
    f"""
    WITH p AS ({PAYLOADS}),
    t AS (SELECT o_orderkey, j.type, j.atom, j.value, replace(replace(substr(j.fullkey, 2), '.', '/'), '[', '/[') AS path FROM p, json_tree(p.payload) AS j),
    l AS (SELECT o_orderkey, path || '=' || CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'VARCHAR' THEN 's:' || (atom ->> '$') WHEN type = 'BOOLEAN' THEN 'b:' || CAST(atom AS VARCHAR)
        WHEN type IN ('OBJECT', 'ARRAY') THEN CAST(value AS VARCHAR) ELSE 'n:' || CAST(CAST(CAST(atom AS VARCHAR) AS DOUBLE) AS VARCHAR) END AS line
      FROM t WHERE NOT regexp_matches(path, '/(id|[^/]*_ids?)(/|$)') AND (type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('[]', '{{}}')))
    SELECT o_orderkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS content_hash FROM l GROUP BY o_orderkey
    """,
)
def content_hashes(spark, sf_dir):
    """Hashes of nested payloads without the ids in them."""
    return canonical.content_hashes(view(spark, sf_dir, PAYLOADS), ["o_orderkey"])


@query(
    "distinct_revisions",
    """
    SELECT user_id, sha256(props) AS sha256, arg_min(event_id, (ts, event_id)) AS seq
    FROM events GROUP BY user_id, props
    """,
)
def distinct_revisions(spark, sf_dir):
    log = history.revision_log(
        _observations(spark, sf_dir), ["user_id"], ["observed_at", "seq"], distinct_hash=True
    )
    return log.select("user_id", "sha256", "seq")


@query(
    "current_documents",
    """
    SELECT user_id, count(*) AS observations,
      arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS title,
      arg_min(CAST(CAST(ts AS DATE) AS STRING), (ts, event_id)) FILTER (event_type = 'view') AS meeting_date,
      sha256(arg_max(props, (ts, event_id))) AS sha256,
      strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM events GROUP BY user_id
    """,
)
def current_documents(spark, sf_dir):
    rows = history.current_documents(_observations(spark, sf_dir), ["user_id"])
    shown = "yyyy-MM-dd HH:mm:ss"
    return rows.select(
        "user_id", "observations", "title", "meeting_date", "sha256",
        F.date_format("first_seen_at", shown).alias("first_seen"),
        F.date_format("last_seen_at", shown).alias("last_seen"),
    )


@query(
    "keyed_upsert",
    """
    SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id,
      arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id, event_type
    """,
)
def keyed_upsert(spark, sf_dir):
    """Purchases and signups are stored, all other events arrive on top."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    stored = F.col("event_type").isin("purchase", "signup")
    merged = history.upsert(
        rows.filter(stored), rows.filter(~stored), ["user_id", "event_type"], ["ts", "event_id"]
    )
    return merged.drop("ts")


@query(
    "insert_if_absent",
    """
    WITH k AS (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS priority, o_orderkey, o_orderstatus FROM orders)
    SELECT o_custkey, priority, min(o_orderkey) AS o_orderkey FROM k n WHERE o_orderstatus <> 'F'
      AND NOT EXISTS (SELECT 1 FROM k e WHERE e.o_orderstatus = 'F' AND e.o_custkey = n.o_custkey
        AND e.priority IS NOT DISTINCT FROM n.priority)
    GROUP BY o_custkey, priority
    """,
)
def insert_if_absent(spark, sf_dir):
    """Finished orders are stored; a missing priority is a key value like any other."""
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
        "o_orderkey",
        "o_orderstatus",
    )
    stored = F.col("o_orderstatus") == "F"
    return history.insert_if_absent(
        rows.filter(stored), rows.filter(~stored).drop("o_orderstatus"),
        ["o_custkey", "priority"], ["o_orderkey"],
    )


@query(
    "bill_merge",
    f"""
    WITH b AS ({corpus.BILLS}), i AS (
      SELECT b.*, o.o_orderkey AS seq, o.o_orderpriority AS new_action FROM b
      JOIN orders o ON o.o_custkey = b.bill_id WHERE o.o_orderstatus = 'P'),
    last AS (SELECT jurisdiction, session_code, bill_type, bill_number, arg_max(new_action, seq) AS a,
      any_value(source_url) AS u FROM i GROUP BY ALL),
    old AS (SELECT * FROM b WHERE jurisdiction = 'TX')
    SELECT coalesce(old.bill_number, last.bill_number) AS bill_number,
      coalesce(last.a, old.latest_action) AS latest_action, old.bill_id IS NULL AS created_bill,
      CASE WHEN last.bill_number IS NOT NULL THEN last.u END AS stored_url
    FROM old FULL JOIN last USING (jurisdiction, session_code, bill_type, bill_number)
    """,
)
def bill_merge(spark, sf_dir):
    """State bills are stored; every pending order brings its bill again."""
    bills = corpus.bills(spark, sf_dir)
    incoming = (
        table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
        .select(F.col("o_custkey").alias("bill_id"), F.col("o_orderkey").alias("seq"),
                F.col("o_orderpriority").alias("new_action"))
        .join(bills, "bill_id")
        .withColumn("latest_action", F.col("new_action"))
        .withColumn("source_system", F.lit("orders"))
        .withColumn("metadata", F.from_json("metadata_json", "map<string,string>"))
    )
    stored = bills.filter("jurisdiction = 'TX'").withColumn(
        "metadata", F.create_map().cast("map<string,string>")
    )
    merged = history.merge_bills(stored, incoming)
    return merged.select(
        "bill_number", "latest_action", "created_bill",
        F.element_at("metadata", "source_url").alias("stored_url"),
    )


@query(
    "entity_merge",
    """
    WITH m AS (SELECT 'person' AS entity_type, 'member ' || CAST(o_orderkey % 97 AS STRING) AS normalized_name,
      o_orderkey AS seq, CASE WHEN o_orderpriority <> '5-LOW' THEN 'B' || CAST(o_orderkey % 97 AS STRING) END AS bioguide,
      substr(o_orderpriority, 3) AS party, CAST(o_orderkey % 7 AS STRING) AS district FROM orders)
    SELECT entity_type, normalized_name, 'Member  ' || substr(normalized_name, 8) AS canonical_name, count(*) AS mentions,
      max(bioguide) AS bioguide, arg_max(party, seq) AS party, arg_max(district, seq) AS district
    FROM m GROUP BY entity_type, normalized_name
    """,
)
def entity_merge(spark, sf_dir):
    from ledgerline.operators import entities

    nodes = history.merge_entities(entities.sponsor_mentions(view(spark, sf_dir, corpus.SPONSORS)))
    return nodes.select(
        "entity_type", "normalized_name", "canonical_name", "mentions",
        F.try_element_at("external_ids", F.lit("bioguide")).alias("bioguide"),
        F.try_element_at("metadata", F.lit("party")).alias("party"),
        F.try_element_at("metadata", F.lit("district")).alias("district"),
    )


SESSIONLESS = """
SELECT o_orderkey AS bill_id, 100 + o_custkey % 20 AS congress,
  CASE WHEN o_orderstatus = 'F' THEN '89R' WHEN o_orderstatus = 'O' THEN '' ELSE NULL END AS session_code,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '{"jurisdiction_session":"' || CAST(o_custkey AS STRING) || '"}'
       ELSE '{}' END AS metadata_json
FROM orders
"""


@query(
    "session_backfill",
    f"""
    SELECT bill_id, coalesce(nullif(session_code, ''), json_extract_string(metadata_json, '$.jurisdiction_session'),
      CAST(congress AS STRING)) AS session_code FROM ({SESSIONLESS}) AS b
    """,
)
def session_backfill(spark, sf_dir):
    return history.backfill_session(view(spark, sf_dir, SESSIONLESS)).select("bill_id", "session_code")


@query(
    "partition_rebuild",
    """
    SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS build, count(*) AS orders
    FROM orders GROUP BY ALL
    """,
)
def partition_rebuild(spark, sf_dir):
    """A derived table is written, then one of its partitions again."""
    from ledgerline.session import shared_path

    path = shared_path(spark, "derived")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    history.rebuild_partitions(rows.withColumn("build", F.lit(1)), path, "o_orderstatus")
    again = rows.filter("o_orderstatus = 'F'").withColumn("build", F.lit(2))
    history.rebuild_partitions(again, path, "o_orderstatus")
    return (
        spark.read.parquet(path).groupBy("o_orderstatus", "build")
        .agg(F.count(F.lit(1)).alias("orders"))
    )


@query(
    "duplicate_sections",
    f"""
    SELECT version_id, section_number, max(ordinal) AS ordinal, arg_max(sha256(section_text), ordinal) AS sha
    FROM ({corpus.LINES}) AS line_texts GROUP BY version_id, section_number
    """,
)
def duplicate_sections(spark, sf_dir):
    rows = corpus.sections(spark, sf_dir).select(
        "version_id", "section_number", "ordinal", F.sha2("section_text", 256).alias("sha")
    )
    return S.latest_duplicates(rows, ["version_id", "section_number"])


@query(
    "round_robin",
    """
    WITH pool AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS place
                  FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS turn,
            min(place) OVER (PARTITION BY source) AS source_rank FROM pool)
    SELECT doc_id, source, row_number() OVER (ORDER BY turn, source_rank) AS shown FROM r QUALIFY shown <= 200
    """,
)
def round_robin(spark, sf_dir):
    from ledgerline.plans import listing

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return listing.round_robin(rows, "source", ["n_chars", "doc_id"], 200).select(
        "doc_id", "source", "shown"
    )
