"""Local records: agendas, signals, facts and weekly activity."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from driver import corpus
from driver.base import ORACLES, query, stored, table, texts, view
from driver.sqltext import distinct_in_order, quoted
from ledgerline.functions import rules as R
from ledgerline.functions import text as T
from ledgerline.operators import classify, entities, facts, sections as S
from ledgerline.plans import civic, weekly
from ledgerline.session import checkpointed
from ledgerline.sources import catalog


def re2(pattern: str) -> str:
    """The pattern with flags the checking engine knows."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if not flags:
        return quoted(pattern)
    kept = flags.group(1).replace("U", "").replace("d", "")
    return quoted((f"(?{kept})" if kept else "") + pattern[flags.end():])


CIVIC_LINES = """
SELECT l_orderkey AS document_id,
  row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line_no,
  CASE WHEN l_linenumber = 1 THEN 'C. Consent Agenda'
    WHEN l_linenumber = 2 THEN 'C' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '. Approve the contract with Supplier'
      || CAST(l_suppkey AS STRING) || ' Holdings Group for $' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' million of ' || p_name || ' parts'
    WHEN l_linenumber = 3 THEN 'Phone 972-555-0100'
    WHEN l_linenumber = 4 THEN 'Background on the ' || p_name || ' for members of the council'
    WHEN l_linenumber = 5 THEN 'D. Public Hearings'
    WHEN l_linenumber = 6 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || '. Consider a zoning change for the ' || p_name
      || ' site near the ' || p_brand || ' road, $' || CAST(l_suppkey AS STRING) || '.25 due'
    ELSE 'Adopt a resolution on the ' || p_name || ' budget and a policy for ' || p_brand || ' dealers' END AS line
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

LINE_TEXT = CIVIC_LINES[CIVIC_LINES.index("CASE"):CIVIC_LINES.index(" AS line\n")]
# As CIVIC_LINES, for reading: lines are numbered before they are written out, so that no line is sorted or sent.
READ_LINES = f"""
SELECT document_id, line_no, {LINE_TEXT} AS line
FROM (SELECT l_orderkey AS document_id, l_linenumber, l_quantity, l_suppkey, p_name, p_brand,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line_no
  FROM lineitem JOIN part ON p_partkey = l_partkey) AS numbered
"""

CIVIC_HEADS = """
SELECT o_orderkey AS document_id,
  CASE WHEN o_custkey % 5 = 0 THEN 'sachse_council_agendas' WHEN o_custkey % 5 = 1 THEN 'wylie_city_council'
    WHEN o_custkey % 5 = 2 THEN 'gisd_board' WHEN o_custkey % 5 = 3 THEN 'dallas_budget' ELSE 'collin_commissioners' END AS source_key,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Council minutes' WHEN o_orderpriority = '2-HIGH' THEN 'Council agenda'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'Zoning notice for the northern corridor' WHEN o_orderpriority = '5-LOW' THEN 'Budget workshop'
    ELSE 'Meeting record' END AS title,
  'https://records.example/' || CAST(o_orderkey AS STRING) AS source_url,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS meeting_date, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS crawl_depth
FROM orders
"""
KEY = ["document_id"]


def agendas(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return (
        view(spark, sf_dir, READ_LINES)
        .groupBy("document_id")
        .agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
    )


def items(spark, sf_dir):
    return S.agenda_items(agendas(spark, sf_dir), KEY)


def stored_items(texts):
    """Agenda items, written once; their hashes are not asked for again and would be most of what is written and sent."""
    return checkpointed(S.agenda_items(texts, KEY).drop("evidence_hash"))


def documents(spark, sf_dir):
    heads = view(spark, sf_dir, CIVIC_HEADS)
    return (
        heads.join(agendas(spark, sf_dir), "document_id", "left")
        .withColumn("document_type", classify.document_type(F.col("title"), F.col("source_url")))
        .withColumn("attributes", F.lit(None).cast("map<string,string>"))
    )


LABEL = f"""CASE WHEN regexp_matches(coalesce(item_number, ''), '^(?:[A-Za-z]|[IVXLCDMivxlcdm]+)$')
  AND regexp_matches(heading, {re2(R.AGENDA_SECTION)}) THEN heading END"""
ITEMS_SQL = f"""
SELECT document_id, row_number() OVER w AS ordinal, item_number, heading, item_text, label,
  last_value(label IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS agenda_section
FROM (SELECT *, {LABEL} AS label FROM (
  SELECT document_id, seg, item_text, CASE WHEN regexp_matches(head, {re2(R.AGENDA_ITEM)}) THEN regexp_extract(head, {re2(R.AGENDA_ITEM)}, 1)
      WHEN regexp_matches(head, {re2(R.AGENDA_NUMBERED_ACTION)}) THEN regexp_extract(head, {re2(R.AGENDA_NUMBERED_ACTION)}, 1) END AS item_number,
    CASE WHEN regexp_matches(head, {re2(R.AGENDA_ITEM)}) THEN regexp_extract(head, {re2(R.AGENDA_ITEM)}, 2)
      WHEN regexp_matches(head, {re2(R.AGENDA_NUMBERED_ACTION)}) THEN regexp_extract(head, {re2(R.AGENDA_NUMBERED_ACTION)}, 2) ELSE head END AS heading
  FROM (SELECT document_id, seg, arg_min(line, line_no) AS head, bool_or(opens) AS item,
      string_agg(line, chr(10) ORDER BY line_no) AS item_text
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id, seg ORDER BY line_no) AS n FROM (
      SELECT *, sum(CASE WHEN contact OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_no) AS seg FROM (
        SELECT *, regexp_matches(line, {re2(R.CONTACT_LINE)}) AS contact, NOT contact AND (regexp_matches(line, {re2(R.AGENDA_ITEM)})
          OR regexp_matches(line, {re2(R.AGENDA_NUMBERED_ACTION)}) OR regexp_matches(line, {re2(R.AGENDA_ACTION)})) AS opens
        FROM ({CIVIC_LINES}) AS l) AS a) AS b) AS c WHERE seg > 0 GROUP BY ALL HAVING item) AS d) AS e) AS f
WHERE label IS NOT NULL OR length(replace(item_text, chr(10), ' ')) >= 20
WINDOW w AS (PARTITION BY document_id ORDER BY seg)
"""


@query("agenda_items", f"SELECT document_id, ordinal, item_number, heading, item_text, agenda_section FROM ({ITEMS_SQL}) AS i")
def agenda_items(spark, sf_dir):
    return items(spark, sf_dir).drop("evidence_hash")


@query(
    "section_recovery",
    f"""SELECT document_id, ordinal, coalesce(label, agenda_section) AS recovered_section, label IS NOT NULL AS is_header
    FROM ({ITEMS_SQL}) AS i""",
)
def section_recovery(spark, sf_dir):
    """Sections are dropped from stored items and found again in the raw text."""
    agenda = checkpointed(agendas(spark, sf_dir))
    rows = stored_items(agenda).withColumn("agenda_section", F.lit(None).cast("string"))
    rows = S.recover_sections(rows, agenda, KEY)
    return rows.select("document_id", "ordinal", "recovered_section", "is_header")


TEXTS_SQL = f"SELECT document_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ({CIVIC_LINES}) AS l GROUP BY document_id"


def signal_sql(category: str, patterns: list[str]) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(text, {quoted('(?i)' + p)}) THEN regexp_extract(text, {quoted('(?i)' + p)})" for p in patterns
    )
    return f"SELECT document_id, text, '{category}' AS category, CASE {cases} END AS matched_term FROM ({TEXTS_SQL}) AS t"


SIGNALS_SQL = f"""
SELECT f.document_id, category, matched_term, min(i.ordinal) AS item_ordinal,
  any_value(trim(regexp_replace(substr(text, greatest(strpos(text, matched_term) - 501, 0) + 1,
    strpos(text, matched_term) - 1 + length(matched_term) + 500 - greatest(strpos(text, matched_term) - 501, 0)), '\\s+', ' ', 'g'))) AS evidence
FROM ({' UNION ALL '.join(signal_sql(c, p) for c, p in R.CIVIC_SIGNALS.items())}) AS f
LEFT JOIN ({ITEMS_SQL}) AS i ON i.document_id = f.document_id AND contains(lower(i.item_text), lower(matched_term))
WHERE matched_term IS NOT NULL GROUP BY f.document_id, category, matched_term
"""


@query("civic_signals", SIGNALS_SQL)
def civic_signals(spark, sf_dir):
    return civic.signal_findings(agendas(spark, sf_dir), items(spark, sf_dir), KEY)


CIVIC_MONEY = r"(?i)\$\s?\d[\d,]*(?:\.\d{1,2})?(?:\s?(?:million|billion|thousand|M|B|K))?"


@query(
    "civic_money",
    f"""
    SELECT document_id, 'explicit_money_mentions' AS category, len(hits) AS mention_count,
      array_to_string({distinct_in_order('hits')}, '; ') AS evidence, array_to_string(hits, '; ') AS first_values
    FROM (SELECT document_id, list_transform(regexp_extract_all(text, {quoted(CIVIC_MONEY)}), lambda h: regexp_replace(h, '[,\\s]+$', '')) AS hits
      FROM ({TEXTS_SQL}) AS t) AS x WHERE len(hits) > 0
    """,
)
def civic_money(spark, sf_dir):
    return civic.money_findings(agendas(spark, sf_dir), KEY)


@query(
    "civic_organizations",
    f"""
    SELECT o.document_id, name, min(i.ordinal) AS item_ordinal FROM (
      SELECT DISTINCT document_id, regexp_replace(unnest(regexp_extract_all(text, {quoted(R.CIVIC_ORGANIZATION_PATTERN)}, 1)), '\\s+', ' ', 'g') AS name
      FROM ({TEXTS_SQL}) AS t) AS o
    LEFT JOIN ({ITEMS_SQL}) AS i ON i.document_id = o.document_id AND contains(lower(i.item_text), lower(name))
    WHERE length(name) >= 5 GROUP BY o.document_id, name
    """,
)
def civic_organizations(spark, sf_dir):
    found = entities.civic_mentions(agendas(spark, sf_dir), KEY)
    linked = civic.organization_links(found, items(spark, sf_dir), KEY)
    return linked.select("document_id", "name", "item_ordinal")


@stored
def record_view(spark, sf_dir):
    agenda = checkpointed(agendas(spark, sf_dir))
    rows = stored_items(agenda)
    found = civic.signal_findings(agenda, rows, KEY)
    named = civic.organization_links(entities.civic_mentions(agenda, KEY), rows, KEY)
    heads = view(spark, sf_dir, CIVIC_HEADS).select("document_id", "source_key", "title")
    revisions = agenda.select(
        "document_id", F.col("document_id").alias("revision_id"), F.sha2("text", 256).alias("sha256"), F.lit("2024-01-01").alias("observed_at"),
        F.when(F.col("document_id") % 3 == 0, civic.ANALYZER_VERSION).otherwise("1").alias("analyzer_version"),
    )
    features = view(spark, sf_dir, FEATURES).withColumn("attributes", facts.attributes(F.col("attributes_json")))
    known = facts.facts(features, ["feature_id"]).withColumnRenamed("feature_id", "document_id")
    return checkpointed(civic.analysis_view(heads, rows, found, named, revisions, known))


@query("civic_view")
def civic_view(spark, sf_dir):
    """Everything known about a record in one row."""
    return record_view(spark, sf_dir)


FACTS_SQL = """
SELECT p_partkey AS document_id, unnest([
  {'field': 'ProjectName', 'value': p_name}, {'field': 'Status', 'value': p_type}, {'field': 'council_note', 'value': p_brand},
  {'field': 'PZDate', 'value': CAST(1700000000000 + p_partkey * 86400000 AS STRING)},
  {'field': 'CouncilDate', 'value': CASE WHEN p_size > 25 THEN '2024-02-1' || CAST(p_size % 10 AS STRING) ELSE 'pending' END}]) AS u FROM part
"""


def civic_view_sql() -> str:
    organizations = ORACLES["civic_organizations"]
    return f"""
    WITH t AS ({TEXTS_SQL}), h AS (SELECT document_id, source_key FROM ({CIVIC_HEADS}) AS x)
    SELECT document_id, 'item' AS part, ordinal AS place, heading AS name, item_text AS value FROM ({ITEMS_SQL}) AS i JOIN h USING (document_id)
    UNION ALL SELECT document_id, 'finding', item_ordinal, category || ':' || matched_term, evidence FROM ({SIGNALS_SQL}) AS s JOIN h USING (document_id)
    UNION ALL SELECT document_id, 'organization', item_ordinal, name, NULL FROM ({organizations}) AS o JOIN h USING (document_id)
    UNION ALL SELECT document_id, 'revision', NULL, sha256(text), CASE WHEN document_id % 3 = 0 THEN 'true' ELSE 'false' END FROM t JOIN h USING (document_id)
    UNION ALL SELECT document_id, 'fact', NULL, u.field, u.value FROM ({FACTS_SQL}) AS f JOIN h USING (document_id)
    """


@query("civic_view_rows", civic_view_sql())
def civic_view_rows(spark, sf_dir):
    """The view taken apart again: what each record's row holds, one row per entry."""
    rows = record_view(spark, sf_dir)
    none = F.lit(None)
    held = lambda column: rows.select("document_id", F.explode(column).alias("e"))
    parts = [
        held("agenda_items").select("document_id", F.lit("item").alias("part"), F.col("e.ordinal").cast("long").alias("place"), F.col("e.heading").alias("name"), F.col("e.item_text").alias("value")),
        held("findings").select("document_id", F.lit("finding"), F.col("e.item_ordinal").cast("long"), F.concat_ws(":", "e.category", "e.matched_term"), "e.evidence"),
        held("organizations").select("document_id", F.lit("organization"), F.col("e.item_ordinal").cast("long"), "e.name", none.cast("string")),
        rows.filter("revision IS NOT NULL").select("document_id", F.lit("revision"), none.cast("long"), "revision.sha256", F.col("analysis_ready").cast("string")),
        held("structured_facts").select("document_id", F.lit("fact"), none.cast("long"), "e.field", "e.value"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union


REVISIONS = """
SELECT conv_id AS document_id, conv_id * 1000 + turn AS revision_id, turn AS observed_at, role AS source_key, text FROM conversations
"""


@query("revision_change")
def revision_change(spark, sf_dir):
    """The last two turns of a conversation stand for two revisions of a record."""
    rows = view(spark, sf_dir, REVISIONS).withColumn("sha256", F.sha2("text", 256))
    return civic.revision_changes(rows)


@query(
    "revision_pairs",
    f"""
    WITH r AS (SELECT *, sha256(text) AS sha, row_number() OVER w AS place, lead(revision_id) OVER w AS before, lead(sha256(text)) OVER w AS before_sha
      FROM ({REVISIONS}) AS x WINDOW w AS (PARTITION BY document_id ORDER BY observed_at DESC, revision_id DESC))
    SELECT document_id, revision_id, sha AS new_sha, before AS previous_revision_id, before_sha AS old_sha
    FROM r WHERE place = 1 AND before IS NOT NULL AND sha <> before_sha
    """,
)
def revision_pairs(spark, sf_dir):
    """Which revisions are compared, without the diff itself."""
    return civic.revision_pairs(view(spark, sf_dir, REVISIONS).withColumn("sha256", F.sha2("text", 256)))


PENDING = """
SELECT event_id AS revision_id, user_id AS document_id, event_type AS source_key, ts AS observed_at,
  CASE WHEN value < 10 THEN '2' WHEN value < 20 THEN '1' ELSE '' END AS analyzer_version FROM events
"""


@query(
    "pending_revisions",
    f"""
    WITH r AS ({PENDING}), n AS (SELECT document_id, source_key, max(observed_at) AS observed_at,
      arg_max(revision_id, (observed_at, revision_id)) AS revision_id FROM r GROUP BY ALL),
    t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY observed_at DESC, document_id DESC) <= 50)
    SELECT document_id, source_key, revision_id FROM t WHERE revision_id NOT IN (SELECT revision_id FROM r WHERE analyzer_version = '2')
    """,
)
def pending_revisions(spark, sf_dir):
    """The 50 newest documents of each source, without those already analyzed."""
    rows = view(spark, sf_dir, PENDING)
    todo = civic.pending_revisions(
        rows, rows.select("revision_id", "analyzer_version"), per_source=50
    )
    return todo.select("document_id", "source_key", "revision_id")


# Facts of map features, written out of the part and event tables.
FEATURES = """
SELECT p_partkey AS feature_id, 'https://maps.example/layer' AS source_url,
  '{"ProjectName":"' || p_name || '","Status":"' || p_type || '","OBJECTID":"' || CAST(p_partkey AS STRING)
  || '","council_note":"' || p_brand || '","Shape_Area":"9","Empty":"","Lost":"null","PZDate":"'
  || CAST(1700000000000 + CAST(p_partkey AS BIGINT) * 86400000 AS STRING) || '","CouncilDate":"'
  || CASE WHEN p_size > 25 THEN '2024-02-1' || CAST(p_size % 10 AS STRING) ELSE 'pending' END || '"}' AS attributes_json
FROM part
"""


@query(
    "structured_facts",
    """
    WITH f AS (SELECT p_partkey AS feature_id, unnest([
        {'field': 'ProjectName', 'label': 'Project Name', 'value': p_name}, {'field': 'Status', 'label': 'Status', 'value': p_type},
        {'field': 'council_note', 'label': 'council note', 'value': p_brand},
        {'field': 'PZDate', 'label': 'P Z Date', 'value': CAST(1700000000000 + p_partkey * 86400000 AS STRING)},
        {'field': 'CouncilDate', 'label': 'Council Date', 'value': CASE WHEN p_size > 25 THEN '2024-02-1' || CAST(p_size % 10 AS STRING) ELSE 'pending' END}]) AS u
      FROM part)
    SELECT feature_id, u.field AS field, u.label AS label, u.value AS value FROM f
    """,
)
def structured_facts(spark, sf_dir):
    rows = view(spark, sf_dir, FEATURES).withColumn("attributes", facts.attributes(F.col("attributes_json")))
    return facts.facts(rows, ["feature_id"])


@query(
    "feature_documents",
    """
    SELECT CAST(p_partkey AS STRING) AS external_id, p_name AS title, 'web_record' AS document_type,
      'Project Name: ' || p_name || chr(10) || 'Status: ' || p_type || chr(10) || 'P Z Date: ' || CAST(1700000000000 + p_partkey * 86400000 AS STRING)
      || chr(10) || 'Council Date: ' || CASE WHEN p_size > 25 THEN '2024-02-1' || CAST(p_size % 10 AS STRING) ELSE 'pending' END
      || chr(10) || 'council note: ' || p_brand AS text,
      'Status: ' || p_type AS synopsis,
      CAST(greatest(CAST(make_timestamp((1700000000 + p_partkey * 86400) * 1000000) AS DATE),
        CASE WHEN p_size > 25 THEN CAST('2024-02-1' || CAST(p_size % 10 AS STRING) AS DATE) END) AS STRING) AS event_day
    FROM part
    """,
)
def feature_documents(spark, sf_dir):
    rows = facts.feature_documents(view(spark, sf_dir, FEATURES))
    return rows.select(
        "external_id", "title", "document_type", "text",
        facts.synopsis(F.col("attributes")).alias("synopsis"),
        facts.event_date(F.col("attributes"))["day"].cast("string").alias("event_day"),
    )


# Weekly activity.
def topic_sql(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({text}, {quoted('(?i)(?:' + '|'.join(p) + ')')}) THEN '{topic}'" for topic, p in R.TOPICS.items()
    ) + " ELSE 'other_legislation' END"


def status_sql(text: str) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{status}'" for words, status in R.ACTION_STATUS
    ) + " ELSE 'legislative action' END"


LEGISLATIVE_SQL = f"""
WITH a AS (SELECT *, CAST(date_trunc('week', CAST(action_date AS DATE)) AS DATE) AS week FROM ({corpus.ACTIONS}) AS x
    WHERE NOT regexp_matches(text, {re2(R.ROUTINE_BILL_ACTION)})),
  w AS (SELECT week, bill_id, count(*) AS action_count, arg_max(text, (action_date, action_id)) AS text,
    arg_max(action_id, (action_date, action_id)) AS action_id, max(action_date) AS d FROM a GROUP BY ALL)
SELECT CAST(week AS STRING) AS week, CASE WHEN jurisdiction = 'TX' THEN 'texas' ELSE 'federal' END AS group_id, bill_id,
  {topic_sql("title || ' ' || latest_action")} AS category, upper(bill_type) || ' ' || bill_number || ': ' || title AS title,
  d AS date, {status_sql('text')} AS status, text AS synopsis, action_count
FROM w JOIN ({corpus.BILLS}) AS b USING (bill_id)
"""


@query("weekly_bills", LEGISLATIVE_SQL)
def weekly_bills(spark, sf_dir):
    rows = weekly.legislative_items(view(spark, sf_dir, corpus.ACTIONS), corpus.bills(spark, sf_dir))
    return rows.drop("action_id").withColumn("week", F.col("week").cast("string"))


@query(
    "weekly_bills_top",
    f"""
    SELECT week, group_id, bill_id, date FROM (SELECT l.*, m.action_id FROM ({LEGISLATIVE_SQL}) AS l JOIN (
      SELECT CAST(CAST(date_trunc('week', CAST(action_date AS DATE)) AS DATE) AS STRING) AS week, bill_id, arg_max(action_id, (action_date, action_id)) AS action_id
      FROM ({corpus.ACTIONS}) AS x WHERE NOT regexp_matches(text, {re2(R.ROUTINE_BILL_ACTION)}) GROUP BY ALL) AS m USING (week, bill_id)) AS t
    QUALIFY row_number() OVER (PARTITION BY week, group_id ORDER BY date DESC, action_id DESC) <= 10
    """,
)
def weekly_bills_top(spark, sf_dir):
    """The ten bills of each week and legislature with the newest action."""
    rows = weekly.legislative_items(
        view(spark, sf_dir, corpus.ACTIONS), corpus.bills(spark, sf_dir), limit=10
    )
    return rows.select(F.col("week").cast("string").alias("week"), "group_id", "bill_id", "date")


@query(
    "weekly_rollup",
    f"""
    SELECT week, group_id, category, items, latest, label, row_number() OVER (PARTITION BY week, group_id ORDER BY items DESC, label) AS place
    FROM (SELECT week, group_id, category, count(*) AS items, max(date) AS latest,
      CASE category {' '.join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in R.CATEGORY_LABELS.items())} END AS label
      FROM ({LEGISLATIVE_SQL}) AS l GROUP BY ALL) AS c
    """,
)
def weekly_rollup(spark, sf_dir):
    rows = weekly.legislative_items(view(spark, sf_dir, corpus.ACTIONS), corpus.bills(spark, sf_dir))
    return weekly.rollup(rows).withColumn("week", F.col("week").cast("string"))


@query(
    "weekly_places",
    f"""
    SELECT week, group_id, category, title, date,
      row_number() OVER (PARTITION BY week, group_id, category ORDER BY date DESC, title DESC) AS place
    FROM ({LEGISLATIVE_SQL}) AS l
    """,
)
def weekly_places(spark, sf_dir):
    rows = weekly.legislative_items(view(spark, sf_dir, corpus.ACTIONS), corpus.bills(spark, sf_dir))
    placed = weekly.places(rows, ["week", "group_id"])
    return placed.select(
        F.col("week").cast("string").alias("week"), "group_id", "category", "title", "date",
        F.col("place").cast("int").alias("place"),
    )


def words_sql(text: str) -> str:
    stripped = f"regexp_replace({text}, {re2(T.ITEM_PREFIX)}, '')"
    return f"array_to_string(regexp_extract_all(lower({stripped}), '\\w+'), ' ')"


def routine_sql(text: str) -> str:
    subject = words_sql(text)
    return f"""((regexp_matches({subject}, {re2(R.ROUTINE_AGENDA)}) OR regexp_matches({subject}, {re2(R.ROUTINE_MINUTES)}))
      AND NOT regexp_matches({subject}, {re2(R.SUBSTANTIVE_HINT)}))"""


def category_sql(found: str, text: str | None) -> str:
    parts = []
    for c in R.CIVIC_PRIORITY:
        own = f" OR regexp_matches({text}, {quoted('(?i)(?:' + '|'.join(R.CIVIC_SIGNALS[c]) + ')')})" if text else ""
        parts.append(f"WHEN list_contains({found}, '{c}'){own} THEN '{c}'")
    parts += [f"WHEN document_type = '{k}' THEN '{v}'" for k, v in R.CIVIC_TYPE_FALLBACK.items()]
    return "CASE " + " ".join(parts) + " ELSE 'other_civic' END"


TYPE_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(title || ' ' || source_url), '{t}') THEN '{label}'" for t, label in R.DOCUMENT_TYPES
) + " ELSE 'web_record' END"
GROUP_SQL = """CASE WHEN starts_with(source_key, 'sachse_') THEN 'sachse' WHEN starts_with(source_key, 'wylie_city_') THEN 'wylie'
  WHEN starts_with(source_key, 'gisd_') THEN 'gisd' WHEN starts_with(source_key, 'dallas_') THEN 'dallas_county' ELSE 'collin_county' END"""


def status_of(found: str, otherwise: str) -> str:
    return f"""CASE WHEN list_contains({found}, 'vote_action') THEN CASE WHEN document_type = 'minutes' THEN 'official action recorded' ELSE 'proposed action' END
      WHEN list_contains({found}, 'public_hearing') THEN 'public hearing' ELSE {otherwise} END"""


def compact_sql(text: str, size: int) -> str:
    flat = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {size} THEN {flat} ELSE rtrim(substr({flat}, 1, {size - 1})) || '…' END"


CIVIC_SQL = f"""
WITH d AS (SELECT h.*, t.text, {TYPE_SQL} AS document_type, {GROUP_SQL} AS group_id FROM ({CIVIC_HEADS}) AS h
    LEFT JOIN ({TEXTS_SQL}) AS t USING (document_id) WHERE crawl_depth <> 0),
  i AS ({ITEMS_SQL}), f AS ({SIGNALS_SQL}),
  per_item AS (SELECT document_id, item_ordinal, list(DISTINCT category) AS found, count(*) AS n FROM f WHERE item_ordinal IS NOT NULL GROUP BY ALL),
  per_doc AS (SELECT document_id, list(DISTINCT category) AS found, count(*) AS n FROM f GROUP BY ALL),
  a AS (SELECT d.*, i.ordinal, i.heading AS item_title, i.item_text, i.label, i.agenda_section, coalesce(p.found, []) AS found, coalesce(p.n, 0) AS n
    FROM i JOIN d USING (document_id) LEFT JOIN per_item p ON p.document_id = i.document_id AND p.item_ordinal = i.ordinal),
  ac AS (SELECT *, {category_sql('found', 'item_text')} AS category FROM a WHERE label IS NULL),
  w AS (SELECT d.*, coalesce(p.found, []) AS found, coalesce(p.n, 0) AS n, {category_sql("coalesce(p.found, [])", None)} AS category
    FROM d LEFT JOIN per_doc p USING (document_id) WHERE document_id NOT IN (SELECT document_id FROM i))
SELECT group_id, document_id, ordinal AS item_ordinal, source_key, category, item_title AS title, agenda_section, meeting_date AS date,
  {status_of('found', "'agenda item'")} AS status, {compact_sql('item_text', 500)} AS synopsis, n AS evidence_count
FROM ac WHERE NOT {routine_sql('item_title')}
  AND NOT (category = 'other_civic' AND (length({words_sql('item_text')}) < 35
    OR NOT (regexp_matches(item_title, {re2(R.AGENDA_ACTION)}) OR regexp_matches(item_title, {re2(R.SUBSTANTIVE_HINT)}))))
UNION ALL
SELECT group_id, document_id, NULL, source_key, category, title, NULL, meeting_date,
  {status_of('found', "replace(document_type, '_', ' ')")},
  coalesce(nullif({compact_sql("coalesce((SELECT any_value(evidence) FROM f WHERE f.document_id = w.document_id AND f.category = w.category), text, '')", 500)}, ''),
    'Official source record captured for this week.'), n
FROM w WHERE category NOT IN ('other_civic', 'vote_action', 'public_hearing') AND NOT {routine_sql('title')}
  AND NOT (document_type IN ('agenda', 'minutes', 'meeting_packet') AND length({words_sql('title')}) < 45)
"""


@stored
def week_items(spark, sf_dir):
    """The record and item tables are written first, as they are stored in use."""
    docs = checkpointed(documents(spark, sf_dir))
    texts_only = docs.select("document_id", "text").filter("text IS NOT NULL")
    rows = stored_items(texts_only)
    found = civic.signal_findings(texts_only, rows, KEY)
    known = S.recover_sections(rows, texts_only, KEY)
    return checkpointed(weekly.civic_items(docs, checkpointed(known), checkpointed(found)))


@query("weekly_civic", CIVIC_SQL)
def weekly_civic(spark, sf_dir):
    """Items of all weeks before overlaps are merged."""
    return week_items(spark, sf_dir).drop("week", "institution")


TITLED = """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Item ' || CAST(p_size AS STRING) || '. Consider and take action on the ' || p_name || ' ' || p_type
    WHEN p_size % 3 = 1 THEN 'AGENDA' ELSE p_size || '.2a) Approval of ' || p_name END AS title,
  CASE WHEN p_size % 2 = 0 THEN 'Discuss adoption of the ' || p_type || ', ' || p_brand ELSE '7: ' || p_type || ' (' || p_name || ')' END AS synopsis FROM part
"""
HEAD_WORDS = r"""array_to_string(regexp_extract_all(lower(regexp_replace({0}, '(?i)^\s*(?:item\s+)?(?:\d+(?:\.\d+)*[a-z]?|[a-z])\s*[.): -]+', '')), '\w+'), ' ')"""
LEADING = r"""regexp_replace({0}, '^(?:(?:consider|discuss)(?: and (?:take )?action on)?|approval of|approve|adoption of|adopt|authorization of|authorize)\s+(?:the\s+)?', '')"""


@query(
    "issue_keys",
    f"""
    WITH t AS (SELECT p_partkey, {HEAD_WORDS.format('title')} AS t, {HEAD_WORDS.format('synopsis')} AS s FROM ({TITLED}) AS x),
    c AS (SELECT p_partkey, CASE WHEN length(t) < 25 OR t IN ('agenda', 'minutes', 'meeting packet', 'discussion and possible action') THEN s ELSE t END AS k FROM t)
    SELECT p_partkey, {LEADING.format(LEADING.format('k'))} AS issue FROM c
    """,
)
def issue_keys(spark, sf_dir):
    """The words by which items of one meeting are compared."""
    return view(spark, sf_dir, TITLED).select("p_partkey", T.issue_key(F.col("title"), F.col("synopsis")).alias("issue"))


@query("overlap_merge")
def overlap_merge(spark, sf_dir):
    """Items of all weeks with overlapping ones merged, alike wordings included."""
    return weekly.merged_items(week_items(spark, sf_dir))


@query(
    "weekly_sections",
    f"SELECT group_id, date, agenda_section, count(*) AS items FROM ({CIVIC_SQL}) AS c GROUP BY ALL",
)
def weekly_sections(spark, sf_dir):
    return weekly.by_section(week_items(spark, sf_dir))


@query(
    "source_coverage",
    f"""
    WITH g AS (SELECT * FROM (VALUES {', '.join(f"('{r[0]}')" for r in catalog.GROUPS)}) AS t(group_id)),
    r AS (SELECT {GROUP_SQL} AS group_id, count(*) AS record_count, max(meeting_date) AS latest FROM ({CIVIC_HEADS}) AS h GROUP BY 1),
    c AS (SELECT {GROUP_SQL} AS group_id, sum(CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END) AS error_count,
      count(*) FILTER (o_orderstatus = 'F') AS sources_in_error FROM ({CIVIC_HEADS}) AS h JOIN orders ON o_orderkey = document_id GROUP BY 1)
    SELECT group_id, coalesce(record_count, 0) AS record_count, latest AS latest_dated_record,
      coalesce(error_count, 0) AS error_count, coalesce(sources_in_error, 0) AS sources_in_error
    FROM g LEFT JOIN r USING (group_id) LEFT JOIN c USING (group_id)
    """,
)
def source_coverage(spark, sf_dir):
    """Records and errors per group; every order stands for one scan of its source."""
    heads = view(spark, sf_dir, CIVIC_HEADS).withColumn("group_id", catalog.group_of(F.col("source_key")))
    records = heads.select("group_id", F.col("meeting_date").alias("seen_at"), F.col("meeting_date").alias("dated"))
    failed = F.col("o_orderstatus") == "F"
    cursors = heads.join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), "o_orderstatus"), "document_id"
    ).select(
        "group_id", "source_key", F.when(failed, "error").otherwise("idle").alias("status"),
        F.when(failed, '{"error_count":2,"failed_count":1}').otherwise("{}").alias("last_result"),
    )
    groups = catalog.groups(spark).select("group_id")
    return weekly.coverage(groups, records, cursors).drop("last_captured_at")


@query(
    "source_groups",
    f"SELECT source_key, {GROUP_SQL} AS group_id, count(*) AS documents FROM ({CIVIC_HEADS}) AS h GROUP BY ALL",
)
def source_groups(spark, sf_dir):
    rows = view(spark, sf_dir, CIVIC_HEADS).withColumn("group_id", catalog.group_of(F.col("source_key")))
    return rows.groupBy("source_key", "group_id").agg(F.count(F.lit(1)).alias("documents"))


# Scalar functions on whole tables.
@query(
    "document_text_measures",
    r"""
    SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\s+')) END AS words,
      CASE WHEN length(flat) <= 380 THEN flat ELSE rtrim(substr(flat, 1, 379)) || '…' END AS compacted,
      sha256(text) AS sha256
    FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t,
      regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS flat FROM documents) AS x
    """,
)
def document_text_measures(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents")
    body = F.col("text")
    return rows.select(
        "doc_id", T.word_count(body).alias("words"), T.compact(body).alias("compacted"), F.sha2("text", 256).alias("sha256")
    )


DATED = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE
  WHEN o_orderpriority = '1-URGENT' THEN 'held 20' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3, 2) || '-02-30, moved to 3/4/2021'
  WHEN o_orderpriority = '2-HIGH' THEN 'on ' || CAST(o_custkey % 12 + 1 AS STRING) || '/' || CAST(o_custkey % 28 + 1 AS STRING) || '/2024 at noon'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'Adopted March ' || CAST(o_custkey % 28 + 1 AS STRING) || ', 2023'
  WHEN o_orderpriority = '5-LOW' THEN 'on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE 'undated' END AS t
FROM orders
"""


@query(
    "dates_in_text",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '2021-03-04'
      WHEN o_orderpriority = '2-HIGH' THEN strftime(make_date(2024, CAST(o_custkey % 12 + 1 AS INT), CAST(o_custkey % 28 + 1 AS INT)), '%Y-%m-%d')
      WHEN o_orderpriority = '3-MEDIUM' THEN strftime(make_date(2023, 3, CAST(o_custkey % 28 + 1 AS INT)), '%Y-%m-%d')
      WHEN o_orderpriority = '5-LOW' AND o_orderdate >= DATE '2000-01-01' THEN strftime(o_orderdate, '%Y-%m-%d') END AS found,
      strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week,
      CAST(o_orderdate AS DATE) BETWEEN DATE '1998-06-15' - 45 AND DATE '1998-06-15' + 30 AS in_scan
    FROM orders
    """,
)
def dates_in_text(spark, sf_dir):
    rows = view(spark, sf_dir, DATED)
    as_of = F.lit("1998-06-15").cast("date")
    return rows.select(
        "o_orderkey",
        T.date_in_text(F.col("t")).cast("string").alias("found"),
        T.week_start(F.col("day")).cast("string").alias("week"),
        T.within(F.col("day"), as_of, 45, 30).alias("in_scan"),
    )


SESSIONS = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(80 + o_custkey % 10 AS STRING)
  WHEN o_orderstatus = 'P' THEN ' ' || CAST(80 + o_custkey % 10 AS STRING) || 's' || CAST(1 + o_custkey % 3 AS STRING)
  WHEN o_orderpriority = '1-URGENT' THEN 'first' WHEN o_orderpriority = '2-HIGH' THEN CAST(80 + o_custkey % 10 AS STRING) || 'r'
  ELSE CAST(80 + o_custkey % 10 AS STRING) || CAST(1 + o_custkey % 3 AS STRING) END AS session
FROM orders
"""


@query(
    "session_codes",
    """
    WITH x AS (SELECT o_orderkey, CAST(80 + o_custkey % 10 AS STRING) AS y, CAST(1 + o_custkey % 3 AS STRING) AS n,
      CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') THEN 'r'
        WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'e' ELSE 's' END AS k FROM orders)
    SELECT o_orderkey, CASE k WHEN 'r' THEN y || 'R' WHEN 's' THEN y || n END AS code, CASE WHEN k <> 'e' THEN CAST(y AS INT) END AS number,
      CASE k WHEN 'r' THEN y || 'R' WHEN 's' THEN y || 'S' || n END AS label, k = 'e' AS invalid FROM x
    """,
)
def session_codes(spark, sf_dir):
    parts = view(spark, sf_dir, SESSIONS).select("o_orderkey", classify.session_parts(F.col("session")).alias("p"))
    return parts.select("o_orderkey", "p.code", "p.number", "p.label", F.col("p.error").isNotNull().alias("invalid"))
