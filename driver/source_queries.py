"""Landed payloads: JSON, XML, indexes and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import corpus
from driver.base import ORACLES, query, texts, view
from ledgerline.operators import classify
from ledgerline.session import shared_path
from ledgerline.sources import bills, pages
from ledgerline.streaming import feeds

BILL_PAYLOADS = """
SELECT c_custkey, '{"congress":119,"type":"' || CASE WHEN c_nationkey % 5 = 0 THEN 'HR' WHEN c_nationkey % 5 = 1 THEN 's' WHEN c_nationkey % 5 = 2 THEN 'XX' ELSE 'HJRES' END
  || '","number":"' || CASE WHEN c_nationkey = 8 THEN '' ELSE CAST(c_custkey AS STRING) END || '","title":"' || c_mktsegment || '",'
  || '"latestAction":{"actionDate":"2024-01-02","text":"Passed"},"sponsors":[{"fullName":"Rep. ' || c_name || '","bioguideId":"B' || CAST(c_custkey AS STRING) || '","party":"I"}],'
  || '"cosponsors":[{"name":"N ' || c_mktsegment || '"},{"bioguideId":"Z9"},{}],"actions":[{"actionDate":"2024-01-01","text":"Introduced"},{"actionDate":"2024-01-02","text":""}],'
  || '"amendments":[{"type":"HAMDT","number":"' || CAST(c_custkey AS STRING) || '"},{"number":""},{"number":"7"}],'
  || '"textVersions":[{"type":"IH","date":"2024-01-01","formats":[{"type":"PDF","url":"p"},{"type":"Formatted Text","url":"t"},{"type":"Formatted XML","url":"'
  || CASE WHEN c_nationkey % 2 = 0 THEN 'x' ELSE '' END || '"}]},{"name":"Engrossed","formats":[{"type":"Other","url":"o"},{"type":"PDF","url":"q"}]}]'
  || CASE WHEN c_nationkey = 9 THEN '' ELSE '}' END AS payload FROM customer
"""
GOOD = """
SELECT c_custkey, c_nationkey, c_name, c_mktsegment, CAST(c_custkey AS STRING) AS number,
  CASE WHEN c_nationkey % 5 = 0 THEN 'hr' WHEN c_nationkey % 5 = 1 THEN 's' ELSE 'hjres' END AS bill_type
FROM customer WHERE c_nationkey % 5 <> 2 AND c_nationkey NOT IN (8, 9)
"""


def good(spark, sf_dir):
    return bills.parse_json(view(spark, sf_dir, BILL_PAYLOADS))[0]


@query(
    "json_bills",
    f"""SELECT 'US' AS jurisdiction, '119' AS session_code, bill_type, number AS bill_number, c_mktsegment AS title, 'Passed' AS latest_action,
    'https://www.congress.gov/bill/119th-congress/' || CASE bill_type WHEN 'hr' THEN 'house-bill' WHEN 's' THEN 'senate-bill' ELSE 'house-joint-resolution' END
    || '/' || number AS source_url FROM ({GOOD}) AS g""",
)
def json_bills(spark, sf_dir):
    return bills.bill_rows(good(spark, sf_dir))


@query(
    "json_quarantine",
    """SELECT c_custkey, CASE WHEN c_nationkey = 9 THEN 'not valid JSON' WHEN c_nationkey = 8 THEN 'no bill number' ELSE 'bill type not followed' END AS reason
    FROM customer WHERE c_nationkey % 5 = 2 OR c_nationkey IN (8, 9)""",
)
def json_quarantine(spark, sf_dir):
    return bills.parse_json(view(spark, sf_dir, BILL_PAYLOADS))[1].select("c_custkey", "reason")


@query(
    "json_children",
    f"""
    SELECT number, 'sponsor' AS child, 'Rep. ' || c_name AS value, 'B' || number AS detail FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'cosponsor', 'N ' || c_mktsegment, NULL FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'cosponsor', 'Z9', 'Z9' FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'cosponsor', 'Unknown', NULL FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'action', 'Introduced', '2024-01-01' FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'amendment', number, 'hamdt' FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'amendment', '7', 'unknown' FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'version', 'IH', CASE WHEN c_nationkey % 2 = 0 THEN 'Formatted XML' ELSE 'Formatted Text' END FROM ({GOOD}) AS g
    UNION ALL SELECT number, 'version', 'Engrossed', 'PDF' FROM ({GOOD}) AS g
    """,
)
def json_children(spark, sf_dir):
    """Sponsors, actions, amendments and versions of all payloads."""
    return payload_children(good(spark, sf_dir))


def payload_children(rows):
    parts = [
        bills.sponsor_rows(rows).select("number", F.col("role").alias("child"), F.col("full_name").alias("value"), F.col("external_id").alias("detail")),
        bills.action_rows(rows).select("number", F.lit("action"), "text", "action_date"),
        bills.amendment_rows(rows).select("number", F.lit("amendment"), "amendment_number", "amendment_type"),
        bills.version_rows(rows).select("number", F.lit("version"), "version_code", "format"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union


HISTORIES = """
SELECT c_custkey, '<bill><caption>' || CASE WHEN c_nationkey = 3 THEN '' ELSE 'Relating to ' || c_mktsegment END || '</caption><authors>Ann ' || c_mktsegment || ' | Bob</authors>'
  || '<coauthors>Cy</coauthors><sponsors>BOB | Dee</sponsors><cosponsors></cosponsors><subjects><subject>Roads</subject></subjects><actions>'
  || '<action><actionNumber>H001</actionNumber><date>1/5/2025</date><description>Filed</description></action>'
  || '<action><actionNumber>H002</actionNumber><date>02/' || CAST(10 + c_nationkey % 10 AS STRING) || '/2025</date><description> Read first time </description></action>'
  || '<action><date>02/' || CAST(10 + c_nationkey % 10 AS STRING) || '/2025</date><description>Referred</description></action><action><date>3/3/2025</date><description></description></action></actions>'
  || '<billtext><docTypes><bill><versions><version><versionDescription>Introduced</versionDescription><WebHTMLURL>http://capitol.texas.gov/HB' || CAST(c_custkey AS STRING) || 'I.htm</WebHTMLURL></version>'
  || '<version><versionDescription>Enrolled</versionDescription><WebHTMLURL>http://x/e</WebHTMLURL></version></versions></bill>'
  || '<fiscalNote><versions><version><versionDescription>Note</versionDescription><WebPDFURL>http://capitol.texas.gov/n.pdf</WebPDFURL></version></versions></fiscalNote></docTypes></billtext></bill>' AS payload
FROM customer
"""


@query(
    "xml_children",
    """
    WITH c AS (SELECT * FROM customer WHERE c_nationkey <> 3)
    SELECT c_custkey, 'sponsor' AS child, 'Ann ' || c_mktsegment AS value, NULL AS detail FROM c
    UNION ALL SELECT c_custkey, 'sponsor', 'Bob', NULL FROM c UNION ALL SELECT c_custkey, 'cosponsor', 'Cy', NULL FROM c UNION ALL SELECT c_custkey, 'sponsor', 'Dee', NULL FROM c
    UNION ALL SELECT c_custkey, 'action', 'Filed', '2025-01-05' FROM c UNION ALL SELECT c_custkey, 'action', 'Read first time', '2025-02-' || CAST(10 + c_nationkey % 10 AS STRING) FROM c
    UNION ALL SELECT c_custkey, 'action', 'Referred', '2025-02-' || CAST(10 + c_nationkey % 10 AS STRING) FROM c
    UNION ALL SELECT c_custkey, 'latest', 'Referred', '2025-02-' || CAST(10 + c_nationkey % 10 AS STRING) FROM c
    UNION ALL SELECT c_custkey, 'version', 'I', 'https://capitol.texas.gov/HB' || CAST(c_custkey AS STRING) || 'I.htm' FROM c
    UNION ALL SELECT c_custkey, 'version', 'F', 'http://x/e' FROM c UNION ALL SELECT c_custkey, 'fiscal_note', 'pdf', 'https://capitol.texas.gov/n.pdf' FROM c
    """,
)
def xml_children(spark, sf_dir):
    """People, actions, versions and documents of bill histories."""
    return history_children(bills.parse_history(view(spark, sf_dir, HISTORIES), ["c_custkey"]), ["c_custkey"])


def history_children(rows, key):
    actions = bills.history_actions(rows, key)
    none = F.lit(None).cast("string")
    parts = [
        bills.history_sponsors(rows, key).select(*key, F.col("role").alias("child"), F.col("full_name").alias("value"), none.alias("detail")),
        actions.select(*key, F.lit("action"), "text", "action_date"),
        bills.latest_action(actions, key).select(*key, F.lit("latest"), "latest_action", "latest_date"),
        bills.history_versions(rows, key).select(*key, F.lit("version"), "version_code", "source_url"),
        bills.history_documents(rows, key).select(*key, "document_type", "format", "source_url"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union


def land(spark, rows, label, files=4):
    """Payloads (c_custkey, payload) as text files that land one after the other, one payload per line."""
    path = shared_path(spark, label)
    for part in range(files):
        rows.filter(F.col("c_custkey") % files == part).select("payload").coalesce(1).write.mode("append").text(path)
    return path


@query("landed_json_children", ORACLES["json_children"])
def landed_json_children(spark, sf_dir):
    """The children of payloads that were read from landed files."""
    path = land(spark, view(spark, sf_dir, BILL_PAYLOADS), "payloads")
    return payload_children(bills.read_json(spark, path)[0])


@query(
    "landed_json_quarantine",
    f"""
    WITH p AS (SELECT p.*, c_nationkey FROM ({BILL_PAYLOADS}) AS p JOIN customer USING (c_custkey))
    SELECT CASE WHEN c_nationkey = 9 THEN 'not valid JSON' WHEN c_nationkey = 8 THEN 'no bill number' ELSE 'bill type not followed' END AS reason,
      CASE WHEN c_nationkey NOT IN (8, 9) THEN CAST(c_custkey AS STRING) END AS number, CASE WHEN c_nationkey = 9 THEN sha256(payload) END AS record_sha256,
      CAST(c_custkey % 4 AS BIGINT) AS batch_id
    FROM p WHERE c_nationkey % 5 = 2 OR c_nationkey IN (8, 9)
    """,
)
def landed_json_quarantine(spark, sf_dir):
    """Lines set aside by a stream that takes one landed file a batch."""
    path = land(spark, view(spark, sf_dir, BILL_PAYLOADS), "payloads")
    out = shared_path(spark, "captured")
    stream = bills.landed_json(spark, path, stream=True, files_per_batch=1)
    feeds.run_batches(stream, feeds.capture(bills.split_corrupt, out), f"{out}-checkpoint")
    bad = spark.read.parquet(f"{out}/quarantine")
    corrupt = F.col("_corrupt_record").isNotNull()
    return bad.select(
        "reason", F.when(~corrupt, F.nullif("number", F.lit(""))).alias("number"),
        F.when(corrupt, F.sha2("_corrupt_record", 256)).alias("record_sha256"), F.col("batch_id").cast("long").alias("batch_id"),
    )


#: Of one nation the histories lack a closing tag.
LANDED_HISTORIES = f"""
SELECT h.c_custkey, CASE WHEN c_nationkey = 4 THEN replace(payload, '</caption>', '') ELSE payload END AS payload
FROM ({HISTORIES}) AS h JOIN customer ON customer.c_custkey = h.c_custkey
"""


@query(
    "landed_history_children",
    "SELECT child, value, detail FROM (" + ORACLES["xml_children"].replace("c_nationkey <> 3", "c_nationkey NOT IN (3, 4)") + ") AS x",
)
def landed_history_children(spark, sf_dir):
    """The children of histories that were read from landed XML files; an address names its history."""
    path = land(spark, view(spark, sf_dir, LANDED_HISTORIES), "histories")
    rows = bills.read_history(spark, path)[0]
    key = F.regexp_extract(F.col("billtext.docTypes.bill.versions.version")[0]["WebHTMLURL"], r"HB(\d+)I", 1).alias("c_custkey")
    return history_children(rows.select(key, "*"), ["c_custkey"]).drop("c_custkey")


@query(
    "landed_history_quarantine",
    f"""
    SELECT CASE WHEN c_nationkey = 4 THEN 'not valid XML' ELSE 'no caption' END AS reason, count(*) AS records, CAST(customer.c_custkey % 4 AS BIGINT) AS batch_id
    FROM ({LANDED_HISTORIES}) AS h JOIN customer ON customer.c_custkey = h.c_custkey WHERE c_nationkey IN (3, 4) GROUP BY ALL
    """,
)
def landed_history_quarantine(spark, sf_dir):
    """Records set aside by a stream over XML files, one file a batch."""
    path = land(spark, view(spark, sf_dir, LANDED_HISTORIES), "histories")
    out = shared_path(spark, "captured")
    stream = bills.landed_histories(spark, path, stream=True, files_per_batch=1)
    feeds.run_batches(stream, feeds.capture(bills.split_histories, out), f"{out}-checkpoint")
    bad = spark.read.parquet(f"{out}/quarantine")
    return bad.groupBy("reason", F.col("batch_id").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("records"))


INDEXES = """
SELECT o_custkey AS index_id, o_orderkey, 'bills/HB' || lpad(CAST(o_orderkey % 300 AS STRING), 5, '0') || '.xml and SJR ' || CAST(o_orderkey % 7 + 1 AS STRING) || ', HB '
  || CAST(o_orderkey % 300 AS STRING) AS raw FROM orders
"""


@query(
    "history_index",
    f"""SELECT o_orderkey, 0 AS pos, 'HB' AS bill_type, CAST(o_orderkey % 300 AS STRING) AS number FROM ({INDEXES}) AS i
    UNION ALL SELECT o_orderkey, 1, 'SJR', CAST(o_orderkey % 7 + 1 AS STRING) FROM ({INDEXES}) AS i""",
)
def history_index(spark, sf_dir):
    return bills.history_index(view(spark, sf_dir, INDEXES), ["o_orderkey"])


@query(
    "federal_types",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'hr' WHEN o_orderstatus = 'P' THEN 'sconres' END AS bill_type,
      CASE WHEN o_orderstatus = 'F' THEN 'https://www.congress.gov/bill/119th-congress/house-bill/' || CAST(o_orderkey AS STRING)
        WHEN o_orderstatus = 'P' THEN 'https://www.congress.gov/bill/119th-congress/senate-concurrent-resolution/' || CAST(o_orderkey AS STRING) END AS url FROM orders
    """,
)
def federal_types(spark, sf_dir):
    raw = F.when(F.col("o_orderstatus") == "F", "Hr").when(F.col("o_orderstatus") == "P", "SCONRES").otherwise("AMDT")
    rows = view(spark, sf_dir, "SELECT o_orderkey, o_orderstatus FROM orders ").withColumn("bill_type", classify.federal_type(raw))
    return rows.select(
        "o_orderkey", "bill_type", classify.federal_url(F.lit(119), F.col("bill_type"), F.col("o_orderkey")).alias("url")
    )


@query("page_text")
def page_text(spark, sf_dir):
    """Title, visible text and number of links of every page."""
    rows = pages.page_texts(texts(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "title", "text", F.size("links").alias("links"))


@query(
    "page_links",
    r"""
    SELECT page_id, len(l) AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="') AS l FROM pages) AS p
    """,
)
def page_links(spark, sf_dir):
    rows = pages.page_texts(texts(spark, sf_dir, "pages"))
    return rows.select("page_id", F.size("links").cast("long").alias("links"))


@query("link_frontier")
def link_frontier(spark, sf_dir):
    """Addresses within two links of the pages, on the given hosts."""
    rows = pages.page_texts(texts(spark, sf_dir, "pages"))
    roots = rows.select("url")
    return pages.frontier(rows, roots, ["example.com", "example.org"], ["the", "an"], depth=2)


# The given pages under addresses that links reach: each page also links to two others, of which one lies on a host that is not followed.
LINKED_PAGES = """
SELECT page_id, 'https://' || CASE WHEN page_id % 5 = 4 THEN 'other.org' ELSE 'a.example.com' END || '/the/' || CAST(page_id AS STRING) AS url,
  html || '<a href="/the/' || CAST((page_id * 7 + 3) % (SELECT count(*) FROM pages) AS STRING) || '">next</a><a href="https://a.example.com/the/'
  || CAST((page_id * 11 + 5) % (SELECT count(*) FROM pages) AS STRING) || '">far</a>' AS html
FROM pages
"""


@query(
    "link_walk",
    f"""
    WITH RECURSIVE p AS MATERIALIZED ({LINKED_PAGES}),
    l AS MATERIALIZED (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM p),
    e AS MATERIALIZED (SELECT DISTINCT url, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^https://[^/]+') || href ELSE href END AS target FROM l),
    f AS MATERIALIZED (SELECT * FROM e WHERE regexp_matches(target, '^https://([^/]*[.])?example[.]com/') AND contains(target, '/the/')),
    walk(url, depth) AS (
      SELECT url, 0 FROM p WHERE page_id % 5 = 0
      UNION SELECT target, depth + 1 FROM walk JOIN f USING (url) WHERE depth < 2),
    w AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
    SELECT w.url, w.depth, page_id FROM w LEFT JOIN p USING (url)
    """,
)
def link_walk(spark, sf_dir):
    """Addresses within two links of a fifth of the pages; a link is followed on one host and below one path."""
    rows = pages.page_texts(view(spark, sf_dir, LINKED_PAGES))
    roots = rows.filter("page_id % 5 = 0").select("url")
    return pages.frontier(rows, roots, ["example.com"], ["/the/"], depth=2)


@query(
    "page_hosts",
    r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host,
    regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '(^|\.)example\.com$') AS allowed FROM pages""",
)
def page_hosts(spark, sf_dir):
    rows = view(spark, sf_dir, "SELECT page_id, url FROM pages ")
    return rows.select("page_id", pages.host(F.col("url")).alias("host"), pages.allowed(F.col("url"), ["example.com"]).alias("allowed"))


@query(
    "scope_metadata",
    f"""SELECT bill_id, lower(json_extract_string(metadata_json, '$.subjects[0]')) || ' standards commerce ' || json_extract_string(metadata_json, '$.summary') AS scope_text
    FROM ({corpus.BILLS}) AS b""",
)
def scope_metadata(spark, sf_dir):
    from ledgerline.operators import scope

    return corpus.bills(spark, sf_dir).select("bill_id", scope.scope_text(F.col("metadata_json")).alias("scope_text"))
