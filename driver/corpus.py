"""Bills, versions, sections and the rest, derived from the star-schema tables.

The given prose holds no legislative wording, so a corpus is written out of the
order tables: a customer is a bill, each order a version of it and each line item
a section. The statements below are plain SQL that Spark and the checking engine
both run; they only shape input and hold none of the operators under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver.base import view

BILLS = """
SELECT c_custkey AS bill_id,
  CASE WHEN c_nationkey % 3 = 0 THEN 'US' ELSE 'TX' END AS jurisdiction,
  CASE WHEN c_nationkey % 3 = 0 THEN '119' ELSE '89R' END AS session_code,
  CASE WHEN c_nationkey % 3 = 0 THEN 'hr' ELSE 'hb' END AS bill_type,
  CAST(c_custkey AS STRING) AS bill_number,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Relating to housing and real property tax rates'
       WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Relating to highway transportation grants'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Relating to school district reimbursement'
       WHEN c_mktsegment = 'MACHINERY' THEN 'Relating to labor and industry fees'
       ELSE 'Relating to general matters' END AS title,
  CASE WHEN c_acctbal < 0 THEN 'Referred to the Committee on Finance'
       ELSE 'Passed the House' END AS latest_action,
  'https://bills.example/' || CAST(c_custkey AS STRING) AS source_url,
  '{"subjects":["' || lower(c_mktsegment) || '","standards"],"policyArea":{"name":"commerce"},'
    || '"summary":"standard equipment ' || lower(c_mktsegment) || '"}' AS metadata_json
FROM customer
"""

VERSION_HEADS = """
SELECT o_orderkey AS version_id, o_custkey AS bill_id, 'V' || o_orderstatus AS version_code,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS issued_on,
  'https://texts.example/' || CAST(o_orderkey AS STRING) AS source_url
FROM orders
"""

SECTION_TEXT = """
'SECTION ' || CAST(l_linenumber AS STRING) || '. ' || p_name || chr(10)
|| 'The department shall award a grant of $' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)
|| ' to an eligible recipient in the District of ' || r_name || '. '
|| CASE WHEN l_returnflag = 'A' THEN 'Notwithstanding any other provision, such sums as may be necessary are appropriated from the general revenue fund. '
        WHEN l_returnflag = 'N' THEN 'No private right of action arises under section 12(a), title 5 or section 40. '
        ELSE 'This requirement covers an existing agreement with producers and small businesses. ' END
|| CASE WHEN l_linestatus = 'F' THEN 'A fee is set at $' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' million by the agency. '
        ELSE 'Revenue loss and administrative cost fall on manufacturers. ' END
|| 'Supplier' || CAST(s_suppkey AS STRING) || ' Holdings Company reports each ' || p_name || ' delivered. '
|| CASE WHEN p_type = 'ECONOMY' THEN 'Cheap durable fittings receive yearly inspection while records remain open for public review and audit.'
        WHEN p_type = 'LARGE' THEN 'Heavy freight moved by rail needs permits, weighing stations, escorts and night curfews along rural corridors.'
        WHEN p_type = 'MEDIUM' THEN 'Hospital clinics store medical devices, vaccines and patient charts inside locked rooms with staff present.'
        WHEN p_type = 'PROMO' THEN 'Advertising campaigns during election season disclose sponsors, budgets, audiences and broadcast schedules online.'
        WHEN p_type = 'SMALL' THEN 'Village libraries lend tools, seeds and books, hosting evening lessons for children and retired neighbors.'
        ELSE 'Laboratories calibrate meters, scales and gauges, publishing tolerances, methods and traceable reference samples.' END
"""

LINES = f"""
SELECT o_custkey AS bill_id, l_orderkey AS version_id, CAST(l_linenumber AS STRING) AS section_number,
  p_name AS heading,
  CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS ordinal,
  {SECTION_TEXT} AS section_text
FROM lineitem
JOIN orders ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey
"""

SECTIONS = f"""
SELECT bill_id, version_id, version_id * 100 + ordinal AS section_id, section_number, heading,
  ordinal, section_text
FROM ({LINES}) AS line_texts
"""

# As LINES and SECTIONS, for reading: rows are numbered before their texts are written out, so that no text is sorted or sent.
READ_LINES = f"""
SELECT o_custkey AS bill_id, l_orderkey AS version_id, CAST(l_linenumber AS STRING) AS section_number,
  p_name AS heading, CAST(place - 1 AS INT) AS ordinal,
  {SECTION_TEXT} AS section_text
FROM (SELECT o_custkey, l_orderkey, l_linenumber, p_name, l_extendedprice, r_name, l_returnflag, l_linestatus, l_quantity, s_suppkey, p_type,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS place
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey) AS numbered
"""

READ_SECTIONS = f"""
SELECT bill_id, version_id, version_id * 100 + ordinal AS section_id, section_number, heading,
  ordinal, section_text
FROM ({READ_LINES}) AS line_texts
"""

LATEST = f"""
SELECT version_id, bill_id, version_code, issued_on, source_url FROM (
  SELECT *, row_number() OVER (PARTITION BY bill_id
    ORDER BY CASE WHEN issued_on IS NULL THEN 0 ELSE 1 END, issued_on DESC, version_id DESC) AS rn
  FROM ({VERSION_HEADS}) AS heads) AS ranked WHERE rn = 1
"""

DOCUMENTS = """
SELECT o_orderkey AS document_id, o_custkey AS bill_id,
  CASE WHEN o_orderstatus = 'F' THEN 'fiscal_note' ELSE 'bill_analysis' END AS document_type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'Statement ' || o_orderpriority END AS description,
  'https://docs.example/' || CAST(o_orderkey AS STRING) AS source_url,
  CASE WHEN o_orderstatus = 'F' THEN 'Fiscal implication: the technology cost is $'
         || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' and '
         || CASE WHEN o_orderpriority = '2-HIGH' THEN '$' || CAST(o_custkey % 90 AS STRING) || ' million later. '
                 ELSE 'no revenue loss follows. ' END
       WHEN o_orderstatus = 'P' THEN 'The analysis covers a general revenue appropriation and staff. '
       ELSE 'The analysis covers a required assessment and administrative cost. ' END AS text
FROM orders
"""

SPONSORS = """
SELECT o_custkey AS bill_id, o_orderkey AS seq,
  'Member  ' || CAST(o_orderkey % 97 AS STRING) AS full_name,
  CASE WHEN o_orderstatus = 'F' THEN 'sponsor' ELSE 'cosponsor' END AS role,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'B' || CAST(o_orderkey % 97 AS STRING) END AS external_id,
  substr(o_orderpriority, 3) AS party, 'TX' AS state, CAST(o_orderkey % 7 AS STRING) AS district
FROM orders
"""

AMENDMENTS = """
SELECT o_orderkey AS amendment_id, o_custkey AS bill_id,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS amendment_date,
  CASE WHEN o_orderstatus = 'F' THEN 'Strikes the grant to an eligible recipient and the fee set for the agency'
       WHEN o_orderstatus = 'P' THEN 'Adds hospital clinics, vaccines and locked rooms for patient charts'
       ELSE 'Requires permits and weighing stations for heavy freight on rural corridors' END AS search_text
FROM orders
"""

ACTIONS = """
SELECT event_id AS action_id, user_id AS bill_id, CAST(CAST(ts AS DATE) AS STRING) AS action_date,
  CASE WHEN event_type = 'signup' THEN 'Introduced in the House and filed'
       WHEN event_type = 'view' THEN 'Referred to the Committee on Finance'
       WHEN event_type = 'click' THEN 'Reported by the committee'
       WHEN event_type = 'purchase' THEN 'Passed the House by a vote of ' || CAST(CAST(floor(value) AS BIGINT) AS STRING)
       ELSE 'Cosponsors added' END AS text
FROM events
"""

RELATIONSHIPS = """
SELECT l_orderkey * 100000000 + l_suppkey AS relationship_id, min(o_custkey) AS source_entity_id,
  1000000000 + l_suppkey AS target_entity_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'fec' WHEN l_suppkey % 3 = 1 THEN 'lda' ELSE 'manual' END AS source_system,
  CASE WHEN l_suppkey % 3 = 0 THEN 'fec_reported_receipt' WHEN l_suppkey % 3 = 1 THEN 'lda_registered_to_lobby_for'
       ELSE 'affiliated_with' END AS relation_type,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'https://filings.example/' || CAST(l_suppkey AS STRING) END AS source_url,
  min(CAST(CAST(l_shipdate AS DATE) AS STRING)) AS observed_on
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
GROUP BY l_orderkey, l_suppkey
"""

ENTITY_LINKS = """
SELECT c_nationkey AS bill_id, c_custkey AS entity_id FROM customer
"""

# entity_id, entity_type, canonical_name, normalized_name, lda_client_id, bioguide, alias
ENTITIES = """
SELECT CAST(c_custkey AS BIGINT) AS entity_id,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'person' ELSE 'organization' END AS entity_type,
  'Org ' || CAST(c_custkey AS STRING) AS canonical_name, 'org ' || CAST(c_custkey AS STRING) AS normalized_name,
  'L' || CAST(c_custkey AS STRING) AS lda_client_id,
  CASE WHEN c_nationkey = 7 THEN 'N' || CAST(c_custkey % 50 AS STRING) ELSE NULL END AS bioguide,
  'Trade  Name ' || CAST(c_custkey % 400 AS STRING) AS alias
FROM customer
UNION ALL
SELECT CAST(1000000000 + s_suppkey AS BIGINT),
  CASE WHEN s_nationkey % 2 = 0 THEN 'committee' ELSE 'lobbying_registrant' END,
  'Org ' || CAST(s_suppkey * 3 AS STRING), 'org ' || CAST(s_suppkey * 3 AS STRING),
  'L' || CAST(s_suppkey * 7 AS STRING),
  CASE WHEN s_nationkey = 7 THEN 'N' || CAST(s_suppkey % 50 AS STRING) ELSE NULL END,
  CASE WHEN s_suppkey % 2 = 0 THEN 'trade name ' || CAST(s_suppkey * 5 AS STRING) ELSE 'ORG ' || CAST(s_suppkey * 11 AS STRING) END
FROM supplier
"""


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BILLS)


def version_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VERSION_HEADS)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, READ_SECTIONS)


def _latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LATEST).select(F.col("version_id").alias("l_orderkey"))


def _with_texts(spark: SparkSession, sf_dir: str, heads: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "section_text")))
    texts = (
        view(spark, sf_dir, READ_LINES, orders)
        .groupBy("version_id")
        .agg(F.array_join(F.transform(ordered, lambda s: s["section_text"]), "\n\n").alias("text"))
    )
    return heads.join(texts, "version_id", "left")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with their whole text: the section texts in order."""
    return _with_texts(spark, sf_dir, version_heads(spark, sf_dir))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each bill with its whole text; lines of other versions are not written out."""
    orders = _latest_orders(spark, sf_dir)
    heads = version_heads(spark, sf_dir).join(orders.withColumnRenamed("l_orderkey", "version_id"), "version_id", "left_semi")
    return _with_texts(spark, sf_dir, heads, orders)


def latest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the latest versions; lines of other versions are not written out."""
    return view(spark, sf_dir, READ_SECTIONS, _latest_orders(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = view(spark, sf_dir, ENTITIES)
    ids = F.map_filter(
        F.create_map(
            F.lit("lda_client_id"), F.col("lda_client_id"), F.lit("bioguide"), F.col("bioguide")
        ),
        lambda k, v: v.isNotNull(),
    )
    return flat.select(
        "entity_id", "entity_type", "canonical_name", "normalized_name",
        ids.alias("external_ids"), F.array("alias").alias("aliases"),
    )


VERSION_TEXTS_ORACLE = f"""
SELECT h.*, t.text FROM ({VERSION_HEADS}) AS h LEFT JOIN (
  SELECT version_id, string_agg(section_text, chr(10) || chr(10) ORDER BY ordinal, section_text) AS text
  FROM ({LINES}) AS line_texts GROUP BY version_id) AS t USING (version_id)
"""
