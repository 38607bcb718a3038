"""Packets, queue, report, external filings, listings and watches."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import corpus
from driver.base import query, stored, table, view
from driver.graph_queries import ATTRIBUTED, CHANGES, CORRELATED, SCOPED, attributed, scope_bills
from driver.scan_queries import (
    FISCAL_BILLS, FISCAL_DOCUMENTS, FISCAL_HASHED, LATEST_SECTIONS, LINKS_SQL, COMPARED, _fiscal, fiscal_sql, findings_sql, numbered_findings_sql,
)

from driver.sqltext import quoted
from ledgerline.functions import rules as R
from ledgerline.operators import correlation, entities, external, history, lineage, metrics, ordered, scan, scope, sections as S
from ledgerline.plans import listing, packets, provenance, queue, report, watch
from ledgerline.session import checkpointed, shared_path
from ledgerline.sources import tables

# A filing for each supplier named in bill texts: one matched record, one relationship.
CORRELATED_SUPPLIERS = """
SELECT 'supplier' || CAST(s_suppkey AS STRING) || ' holdings company' AS normalized_name, 1000000000 + s_suppkey AS matched_id,
  s_name AS matched_name, 'exact_name' AS match_basis, 'Same name as ' || s_name AS evidence, 0.95 AS confidence FROM supplier
"""
FILED_SUPPLIERS = """
SELECT 1000000000 + s_suppkey AS entity_id, 'Supplier' || CAST(s_suppkey AS STRING) || ' Holdings Company' AS canonical_name FROM supplier
"""
SUPPLIER_FILINGS = """
SELECT 1000000000 + s_suppkey AS entity_id, s_suppkey * 100 + s_nationkey AS relationship_id, 'lda_registered_to_lobby_for' AS relation_type,
  'lda' AS source_system, CASE WHEN s_nationkey % 2 = 0 THEN 'https://filings.example/' || CAST(s_suppkey AS STRING) END AS source_url,
  '2024-01-01' AS observed_on FROM supplier
"""


def numbered_sections(sections, column):
    """One row per version and section number: of sections that share a number the last one counts."""
    return S.latest_duplicates(sections.select("version_id", "section_number", "ordinal", column), ["version_id", "section_number"])


@stored
def evidence(spark, sf_dir):
    """The stored tables a packet is built from."""
    sections = checkpointed(corpus.latest_sections(spark, sf_dir))
    heads = corpus.version_heads(spark, sf_dir)
    pairs = lineage.version_pairs(heads)
    every = corpus.sections(spark, sf_dir)
    changes = lineage.section_changes(every, pairs).filter("event_type <> 'unchanged'").drop("old_sha", "new_sha")
    found = scan.section_findings(sections, ["section_id"])
    outliers = scope.scope_outliers(sections, scope_bills(spark, sf_dir))
    linked = entities.links(entities.section_mentions(sections, ["bill_id", "section_id"]))
    documents = view(spark, sf_dir, corpus.DOCUMENTS)
    return {
        "sections": sections,
        "heads": heads,
        "findings": checkpointed(found),
        "outliers": checkpointed(outliers),
        "events": checkpointed(changes),
        "links": checkpointed(linked),
        "attributions": checkpointed(attributed(spark, sf_dir)),
        "documents": documents,
        "fiscal": checkpointed(_fiscal(spark, sf_dir)),
    }


def noteworthy(e):
    return packets.noteworthy_sections(e["sections"], e["findings"], e["outliers"], e["events"], e["links"])


def named_correlations(spark, sf_dir, e):
    """Organizations of bill texts matched to the suppliers' filings by their names."""
    none = F.lit(None)
    named = e["links"].select("entity_type", "normalized_name").distinct().select(
        F.xxhash64("entity_type", "normalized_name").alias("entity_id"), "entity_type", F.col("normalized_name").alias("canonical_name"), "normalized_name",
        none.cast("map<string,string>").alias("external_ids"), none.cast("array<string>").alias("aliases"),
    )
    filed = view(spark, sf_dir, FILED_SUPPLIERS).select(
        "entity_id", F.lit("organization").alias("entity_type"), "canonical_name", F.lower("canonical_name").alias("normalized_name"),
        none.cast("map<string,string>").alias("external_ids"), none.cast("array<string>").alias("aliases"),
    )
    pairs = correlation.entity_matches(named, filed)
    left = named.select(F.col("entity_id").alias("left_id"), "normalized_name")
    right = filed.select(F.col("entity_id").alias("right_id"), F.col("canonical_name").alias("matched_name"))
    return pairs.join(left, "left_id").join(right, "right_id").select(
        "normalized_name", F.col("right_id").alias("matched_id"), "matched_name", "match_basis", "evidence", "confidence"
    )


@stored
def packet_entries_of(spark, sf_dir):
    """The numbered entries of all packets, written once."""
    e = evidence(spark, sf_dir)
    chosen = checkpointed(noteworthy(e))
    places = checkpointed(ordered.positions(
        lineage.version_order(e["heads"]), ["bill_id"], ["sort_day", "version_id"], "place"
    ))
    later = e["events"].filter("event_type IN ('introduced', 'modified') AND from_version_id IS NOT NULL")
    held = numbered_sections(corpus.sections(spark, sf_dir), "section_id").select(F.col("section_id").alias("event_id"), "version_id", "section_number")
    dated = held.join(later.select("version_id", "section_number"), ["version_id", "section_number"]).join(places.select("version_id", "place"), "version_id")
    attributions = e["attributions"].join(dated.drop("version_id"), "event_id").drop("event_id")
    amendments = view(spark, sf_dir, corpus.AMENDMENTS).select(
        "amendment_id", F.lit("hamdt").alias("amendment_type"), F.col("amendment_id").cast("string").alias("amendment_number"), F.lit(None).cast("string").alias("source_url")
    )
    correlations = checkpointed(named_correlations(spark, sf_dir, e))
    filings = view(spark, sf_dir, SUPPLIER_FILINGS)
    texts = numbered_sections(corpus.sections(spark, sf_dir), "section_text")
    return checkpointed(packets.numbered(
        [
            packets.section_entries(chosen, e["heads"]),
            packets.finding_entries(chosen, e["findings"], e["heads"]),
            packets.scope_entries(chosen, e["outliers"], e["heads"]),
            packets.amendment_entries(chosen, attributions, amendments),
            packets.entity_entries(chosen, e["links"], e["heads"]),
            packets.correlation_entries(chosen, e["links"], correlations),
            packets.relationship_entries(chosen, e["links"], correlations, filings),
            packets.fiscal_entries(chosen, e["fiscal"], e["documents"]),
        ],
        [packets.lineage_entries(chosen, e["events"], places, texts)],
    ))


def packet_headers_of(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return packets.headers(packet_entries_of(spark, sf_dir), packets.heads(e["sections"], e["heads"], corpus.bills(spark, sf_dir)))


STEPS = """
WITH o AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT c_nationkey AS run_id, c_custkey AS entity_id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'fec' ELSE 'lda' END AS source_system,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN c_acctbal > 5000 THEN CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END ELSE 'skipped' END
    ELSE CASE WHEN f > 0 THEN 'completed' ELSE 'no_match' END END AS status
FROM customer LEFT JOIN o ON c = c_custkey WHERE c_mktsegment <> 'BUILDING'
"""


LATER = f"SELECT * FROM ({CHANGES}) AS c WHERE event_type IN ('introduced', 'modified') AND from_version_id IS NOT NULL"
NOTEWORTHY = f"""
SELECT s.* FROM ({LATEST_SECTIONS}) AS s WHERE section_id IN (SELECT section_id FROM ({findings_sql(LATEST_SECTIONS)}) AS f)
  OR section_id IN (SELECT section_id FROM ({SCOPED}) AS o) OR section_id IN (SELECT section_id FROM ({LINKS_SQL}) AS l)
  OR (version_id, section_number) IN (SELECT (version_id, section_number) FROM ({LATER}) AS x)
"""


@query("noteworthy_sections", f"SELECT bill_id, section_id FROM ({NOTEWORTHY}) AS n")
def noteworthy_sections(spark, sf_dir):
    return noteworthy(evidence(spark, sf_dir)).select("bill_id", "section_id")


PLACES = f"""SELECT version_id, version_code, row_number() OVER (PARTITION BY bill_id
  ORDER BY CASE WHEN issued_on IS NULL THEN 1 ELSE 0 END, issued_on, version_id) AS place FROM ({corpus.VERSION_HEADS}) AS h"""
EVENT_AMENDMENTS = f"""
SELECT x.bill_id, s.section_number, place, x.amendment_id, x.confidence, x.basis FROM ({ATTRIBUTED}) AS x
JOIN (SELECT arg_max(section_id, ordinal) AS section_id, section_number, version_id FROM ({corpus.SECTIONS}) AS ss GROUP BY section_number, version_id) AS s ON s.section_id = x.event_id
JOIN ({CHANGES}) AS c ON c.version_id = s.version_id AND c.section_number = s.section_number AND event_type IN ('introduced', 'modified') AND from_version_id IS NOT NULL
JOIN ({PLACES}) AS p ON p.version_id = s.version_id
"""
FISCAL_ALL = f"""
SELECT bill_id, category, confidence FROM (SELECT bill_id, category, confidence FROM (
  {fiscal_sql(f'{FISCAL_BILLS} UNION ALL {FISCAL_DOCUMENTS}')}) AS own
  UNION ALL SELECT bill_id, category, confidence FROM ({COMPARED}) AS cmp) AS x
"""
COUNTS = f"""
WITH n AS MATERIALIZED ({NOTEWORTHY})
SELECT section_id, 'S' AS prefix, count(*) AS entries FROM n GROUP BY 1
UNION ALL SELECT section_id, 'D', count(*) FROM ({findings_sql(LATEST_SECTIONS)}) AS f GROUP BY 1
UNION ALL SELECT section_id, 'Q', count(*) FROM ({SCOPED}) AS f GROUP BY 1
UNION ALL SELECT n.section_id, 'L', count(*) FROM n JOIN ({CHANGES}) AS c USING (bill_id, section_number) WHERE event_type <> 'unchanged' GROUP BY 1
UNION ALL SELECT n.section_id, 'A', count(*) FROM n JOIN ({EVENT_AMENDMENTS}) AS a USING (bill_id, section_number) GROUP BY 1
UNION ALL SELECT section_id, 'E', count(*) FROM ({LINKS_SQL}) AS l GROUP BY 1
UNION ALL SELECT section_id, 'C', count(*) FROM ({LINKS_SQL}) AS l JOIN ({CORRELATED_SUPPLIERS}) AS c USING (normalized_name) GROUP BY 1
UNION ALL SELECT section_id, 'X', count(*) FROM ({LINKS_SQL}) AS l JOIN ({CORRELATED_SUPPLIERS}) AS c USING (normalized_name)
  JOIN ({SUPPLIER_FILINGS}) AS r ON r.entity_id = c.matched_id GROUP BY 1
UNION ALL SELECT n.section_id, 'F', any_value(least(20, k)) FROM n
  JOIN (SELECT bill_id, count(*) AS k FROM ({FISCAL_ALL}) AS fa GROUP BY 1) AS f USING (bill_id) GROUP BY 1
"""


@query("packet_numbering", f"SELECT section_id, prefix, entries, prefix || CAST(entries AS STRING) AS last_id FROM ({COUNTS}) AS c")
def packet_numbering(spark, sf_dir):
    """Entries per section and kind, with the last evidence id given out."""
    entries = packet_entries_of(spark, sf_dir)
    return entries.groupBy("section_id", "prefix").agg(
        F.count(F.lit(1)).alias("entries"), F.max_by("evidence_id", "place").alias("last_id")
    )


LINKED_SUPPLIERS = f"SELECT l.*, c.matched_id, 'Supplier' || regexp_extract(c.normalized_name, '\\d+') || ' Holdings Company' AS matched_name FROM ({LINKS_SQL}) AS l JOIN ({CORRELATED_SUPPLIERS}) AS c USING (normalized_name)"
PACKET_ROWS = f"""
WITH n AS MATERIALIZED ({NOTEWORTHY}), texts AS (SELECT version_id, section_number, arg_max(section_text, ordinal) AS section_text FROM ({corpus.SECTIONS}) AS s GROUP BY ALL),
links AS MATERIALIZED ({LINKED_SUPPLIERS}),
fiscal AS (SELECT * FROM ({FISCAL_HASHED}) AS h QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY confidence DESC, evidence_hash) <= 20),
rows AS (
  SELECT section_id, 'S' AS prefix, 'section_text' AS kind, section_text AS evidence, 0.0::DOUBLE AS o1, '' AS o2, '' AS o3 FROM n
  UNION ALL SELECT section_id, 'D', 'deterministic_finding', evidence, -severity, printf('%05d', rule_no) || printf('%09d', hit_no), '' FROM ({numbered_findings_sql(LATEST_SECTIONS)}) AS f
  UNION ALL SELECT section_id, 'Q', 'scope_finding', 'Divergent terms: ' || divergent_terms || '.', 0, category, '' FROM ({SCOPED}) AS q
  UNION ALL SELECT n.section_id, 'L', 'provision_lineage', t.section_text, place, event_type, '' FROM n JOIN ({CHANGES}) AS c USING (bill_id, section_number)
    JOIN ({PLACES}) AS p ON p.version_id = c.version_id
    LEFT JOIN texts t ON t.section_number = c.section_number AND t.version_id = CASE WHEN event_type = 'removed' THEN from_version_id ELSE c.version_id END
    WHERE event_type <> 'unchanged'
  UNION ALL SELECT n.section_id, 'A', 'candidate_amendment', basis, place, printf('%020d', round((1 - confidence) * 1e9)::BIGINT), printf('%020d', amendment_id) FROM n JOIN ({EVENT_AMENDMENTS}) AS a USING (bill_id, section_number)
  UNION ALL SELECT section_id, 'E', link_type, evidence, 0, link_type || '|' || normalized_name, evidence FROM ({LINKS_SQL}) AS l
  UNION ALL SELECT section_id, 'C', 'external_correlation', 'Canonical names normalize to the same value: ' || normalized_name || '.', 0, 'exact_name|' || normalized_name || '|' || matched_name, '' FROM links
  UNION ALL SELECT section_id, 'X', 'external_relationship', relation_type, 0, normalized_name || '|' || source_system || '|' || relation_type || '|' || observed_on,
    coalesce(r.source_url, '') || '|' || printf('%020d', relationship_id) FROM (SELECT DISTINCT section_id, normalized_name, matched_id FROM links) AS l JOIN ({SUPPLIER_FILINGS}) AS r ON r.entity_id = l.matched_id
  UNION ALL SELECT n.section_id, 'F', 'bill_level_fiscal_context', evidence, -confidence, evidence_hash, '' FROM n JOIN fiscal USING (bill_id)
)
SELECT section_id, prefix || CAST(row_number() OVER (PARTITION BY section_id, prefix ORDER BY o1, o2, o3) AS STRING) AS evidence_id, kind, sha256(coalesce(evidence, '')) AS content FROM rows
"""


@query("packet_entries", PACKET_ROWS)
def packet_entries(spark, sf_dir):
    """Every entry of every packet with its evidence id and a hash of its evidence."""
    rows = packet_entries_of(spark, sf_dir)
    return rows.select("section_id", "evidence_id", "kind", F.sha2(F.coalesce("evidence", F.lit("")), 256).alias("content"))


@query("packet_headers")
def packet_headers(spark, sf_dir):
    """Hash, triggers, coverage and gaps of every packet."""
    return packet_headers_of(spark, sf_dir)


COVERED = f"""
SELECT section_id, sum(entries) AS entry_count, bool_or(prefix = 'Q') AS has_scope_analysis, bool_or(prefix = 'L') AS has_lineage,
  bool_or(prefix = 'E') AS has_entity_context, bool_or(prefix IN ('C', 'X')) AS has_external_context, bool_or(prefix = 'F') AS has_fiscal_context
FROM ({COUNTS}) AS c GROUP BY section_id
"""


@query("packet_coverage", COVERED)
def packet_coverage(spark, sf_dir):
    rows = packet_headers_of(spark, sf_dir)
    return rows.select(
        "section_id", "entry_count", "has_scope_analysis", "has_lineage", "has_entity_context",
        "has_external_context", "has_fiscal_context",
    )


TRIGGERS = f"""
WITH n AS MATERIALIZED ({NOTEWORTHY}), links AS MATERIALIZED ({LINKED_SUPPLIERS}),
fiscal AS (SELECT * FROM ({FISCAL_HASHED}) AS h QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY confidence DESC, evidence_hash) <= 20)
SELECT section_id, 'trigger' AS part, category AS name FROM ({SCOPED}) AS q
UNION SELECT n.section_id, 'trigger', 'lineage_' || event_type FROM n JOIN ({CHANGES}) AS c USING (bill_id, section_number) WHERE event_type <> 'unchanged'
UNION SELECT n.section_id, unnest(['trigger', 'gap']), unnest(['candidate_amendment', 'candidate_amendment_source_url']) FROM n JOIN ({EVENT_AMENDMENTS}) AS a USING (bill_id, section_number)
UNION SELECT section_id, 'trigger', link_type FROM ({LINKS_SQL}) AS l
UNION SELECT section_id, 'trigger', 'external_correlation' FROM links
UNION SELECT section_id, 'trigger', 'external_relationship' FROM links JOIN ({SUPPLIER_FILINGS}) AS r ON r.entity_id = matched_id
UNION SELECT section_id, 'gap', 'external_relationship_source_url' FROM links JOIN ({SUPPLIER_FILINGS}) AS r ON r.entity_id = matched_id WHERE r.source_url IS NULL
UNION SELECT n.section_id, 'trigger', 'fiscal_' || category FROM n JOIN fiscal USING (bill_id)
UNION SELECT n.section_id, 'gap', 'fiscal_context_source_url' FROM n JOIN fiscal USING (bill_id) WHERE document_id IS NULL
UNION SELECT section_id, 'trigger', 'bill_text_' || kind FROM ({findings_sql(LATEST_SECTIONS)}) AS f
"""


@query("packet_triggers", TRIGGERS)
def packet_triggers(spark, sf_dir):
    """What makes each packet worth reading, and what it lacks."""
    rows = packet_headers_of(spark, sf_dir)
    return rows.select("section_id", F.lit("trigger").alias("part"), F.explode("trigger_types").alias("name")).union(
        rows.select("section_id", F.lit("gap"), F.explode("unresolved_gaps"))
    )


def _case(column: str, names: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items()) + f" ELSE {otherwise} END"


RULE_TITLES = {**{r.kind: r.label for r in [*R.SECTION_RULES, R.MONEY_RULE, R.REFERENCE_RULE]}, **report.TITLES}
STATEMENTS = {**{r.kind: r.label for r in [*R.FISCAL_RULES, R.FISCAL_AMOUNT]}}
SIGNAL_NAME = "replace(regexp_extract(evidence, {0}, 1), '_', ' ')"
COMPARED_STATEMENT = f"""CASE category
  WHEN 'analysis_scope_gap' THEN 'Bill text contains ' || {SIGNAL_NAME.format(quoted('^Bill signal: ([a-z_]+);'))}
    || ' language that is not explicitly mentioned in this bill analysis.'
  WHEN 'fiscal_note_amount_exceeds_bill_text' THEN 'Fiscal note contains a larger explicit monetary amount than the bill text.'
  ELSE 'Fiscal note describes ' || {SIGNAL_NAME.format(quoted('; signal: ([a-z_]+)[.]$'))} || ' that is not explicit in the bill-text signal set.' END"""
FISCAL_STATED = f"""
SELECT bill_id, document_id, category, {_case('category', STATEMENTS, "''")} AS statement, confidence, evidence
FROM ({fiscal_sql(f'{FISCAL_BILLS} UNION ALL {FISCAL_DOCUMENTS}')}) AS own
UNION ALL SELECT bill_id, document_id, category, {COMPARED_STATEMENT}, confidence, evidence FROM ({COMPARED}) AS cmp
"""
REPORTED = f"""
WITH sec AS ({LATEST_SECTIONS}), h AS (SELECT version_id, source_url FROM ({corpus.VERSION_HEADS}) AS v), links AS ({LINKS_SQL})
SELECT f.bill_id, 'rule' AS branch, kind AS category, {_case('kind', RULE_TITLES, "''")} AS title, section_number AS section,
  round(severity, 2) AS confidence, evidence, source_url
  FROM ({findings_sql(LATEST_SECTIONS)}) AS f JOIN (SELECT section_id, section_number FROM sec) AS s USING (section_id) JOIN h USING (version_id)
UNION ALL SELECT l.bill_id, 'entity', link_type, {_case('link_type', report.LINK_TITLES, 'link_type')}, section_number, round(confidence, 2), evidence, source_url
  FROM links AS l JOIN (SELECT section_id, section_number, version_id FROM sec) AS s USING (section_id) JOIN h USING (version_id)
  WHERE link_type IN ({', '.join(map(quoted, report.LINK_TITLES))})
UNION ALL SELECT l.bill_id, 'correlation', 'external_correlation', 'External evidence correlation', NULL, 0.95, l.evidence, NULL
  FROM links AS l JOIN ({CORRELATED_SUPPLIERS}) AS c USING (normalized_name)
UNION ALL SELECT f.bill_id, 'fiscal', category, statement, NULL, round(confidence, 2), evidence, d.source_url
  FROM ({FISCAL_STATED}) AS f LEFT JOIN (SELECT document_id, source_url FROM ({corpus.DOCUMENTS}) AS dd) AS d USING (document_id)
UNION ALL SELECT bill_id, 'lineage', 'provision_lineage', 'Provision changed after initial bill text', section_number,
  CASE WHEN event_type = 'introduced' THEN 0.90 ELSE 0.78 END, 'Section ' || section_number || ' was ' || event_type || '.', source_url
  FROM ({LATER}) AS x JOIN h USING (version_id)
UNION ALL SELECT o.bill_id, 'scope', category, 'Provision scope mismatch review', section_number, round(confidence, 2),
  'Divergent terms: ' || divergent_terms || '. Anchor similarity: ' || coalesce(CAST(anchor_similarity AS VARCHAR), 'n/a')
    || '; peer similarity: ' || CAST(peer_similarity AS VARCHAR) || '.', source_url
  FROM ({SCOPED}) AS o JOIN (SELECT section_id, section_number, version_id FROM sec) AS s USING (section_id) JOIN h USING (version_id)
"""


@query("report_findings", REPORTED)
def report_findings(spark, sf_dir):
    """All findings of all bills in one list."""
    return _report_findings(spark, sf_dir, evidence(spark, sf_dir))


def _report_findings(spark, sf_dir, e):
    where = e["sections"].select("section_id", "section_number", "version_id", "bill_id").join(
        e["heads"].select("version_id", "source_url"), "version_id"
    )
    matched = named_correlations(spark, sf_dir, e).select("normalized_name", "confidence")
    correlated = e["links"].join(matched, "normalized_name").select("bill_id", matched["confidence"], "evidence")
    fiscal = e["fiscal"].join(e["documents"].select("document_id", "source_url"), "document_id", "left")
    events = e["events"].join(e["heads"].select("version_id", "source_url"), "version_id")
    return report.report_findings(
        e["findings"].join(where, "section_id"),
        e["links"].drop("bill_id").join(where, "section_id"),
        correlated, fiscal, events,
        e["outliers"].drop("bill_id").join(where, "section_id"),
    )


@query(
    "report_counts",
    f"""
    SELECT bill_id, branch, category, count(*) AS findings FROM (
      SELECT bill_id, 'rule' AS branch, kind AS category FROM ({findings_sql(LATEST_SECTIONS)}) AS f
      UNION ALL SELECT bill_id, 'entity', link_type FROM ({LINKS_SQL}) AS l
      UNION ALL SELECT bill_id, 'correlation', 'external_correlation' FROM ({LINKS_SQL}) AS l JOIN ({CORRELATED_SUPPLIERS}) AS c USING (normalized_name)
      UNION ALL SELECT bill_id, 'fiscal', category FROM ({FISCAL_ALL}) AS fa
      UNION ALL SELECT bill_id, 'lineage', 'provision_lineage' FROM ({LATER}) AS x
      UNION ALL SELECT bill_id, 'scope', category FROM ({SCOPED}) AS s) AS u GROUP BY ALL
    """,
)
def report_counts(spark, sf_dir):
    rows = _report_findings(spark, sf_dir, evidence(spark, sf_dir))
    return rows.groupBy("bill_id", "branch", "category").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "report_parts",
    f"""
    SELECT bill_id, 'fiscal_analysis' AS part, category AS name, count(*) AS n FROM ({FISCAL_ALL}) AS f GROUP BY ALL
    UNION ALL SELECT bill_id, 'lineage', 'event_count', count(*) FROM ({CHANGES}) AS c WHERE event_type <> 'unchanged' GROUP BY ALL
    UNION ALL SELECT bill_id, 'lineage', 'later_change_count', count(*) FROM ({LATER}) AS x GROUP BY ALL
    UNION ALL SELECT bill_id, 'scope_analysis', 'finding_count', count(*) FROM ({SCOPED}) AS s GROUP BY ALL
    UNION ALL SELECT bill_id, 'supporting_documents', document_type, count(*) FROM ({corpus.DOCUMENTS}) AS d GROUP BY ALL
    UNION ALL SELECT bill_id, 'evidence_packets', 'packet_count', count(*) FROM ({NOTEWORTHY}) AS n GROUP BY ALL
    UNION ALL SELECT run_id, 'research', status, count(*) FROM ({STEPS}) AS r GROUP BY ALL
    """,
)
def report_parts(spark, sf_dir):
    """The counted parts of every report."""
    e = evidence(spark, sf_dir)
    steps = research(spark, sf_dir).select(F.col("run_id").alias("bill_id"), "status")
    return report.report_parts(e["fiscal"], e["events"], e["outliers"], e["documents"], packet_headers_of(spark, sf_dir), steps)


@query("reports")
def reports(spark, sf_dir):
    """One JSON document per bill: identity, metrics, counts per category and packets."""
    e = evidence(spark, sf_dir)
    bills = corpus.bills(spark, sf_dir)
    found = _report_findings(spark, sf_dir, e)
    measured = metrics.bill_metrics(
        bills, e["heads"], e["sections"], e["findings"].join(e["sections"].select("section_id", "bill_id"), "section_id"),
        view(spark, sf_dir, corpus.SPONSORS), view(spark, sf_dir, corpus.AMENDMENTS), e["links"],
    )
    packed = packet_headers_of(spark, sf_dir)
    latest = view(spark, sf_dir, corpus.LATEST)
    rows = report.report_headers(bills, latest, measured, found, packed, e["documents"])
    return tables.as_json(rows, ["bill_id"], "report")


# The queue: packets of two points in time, written out of the orders.
BUILT = """
SELECT c_custkey AS bill_id, c_custkey * 10 AS version_id, c_custkey * 100 AS section_id, 'h' || c_mktsegment AS packet_hash,
  CASE WHEN c_acctbal < 0 THEN 'fiscal_mandate' ELSE 'scope_outlier' END AS trig, CASE WHEN c_nationkey % 4 = 0 THEN 'section_source_url' ELSE '' END AS gap,
  c_nationkey AS entry_count FROM customer
"""
STORED = """
SELECT c_custkey AS bill_id, c_custkey * 10 AS version_id, c_custkey * 100 AS section_id,
  CASE WHEN c_nationkey % 2 = 0 THEN 'h' || c_mktsegment ELSE 'old' END AS packet_hash,
  CASE WHEN c_nationkey % 5 = 0 THEN 'reviewing' WHEN c_nationkey % 5 = 1 THEN 'completed' WHEN c_nationkey % 5 = 2 THEN 'archived' ELSE 'new' END AS status,
  'scope_outlier' AS trig, '' AS gap, 1 AS entry_count, c_name AS analyst_notes FROM customer WHERE c_mktsegment <> 'FURNITURE'
"""


def _arrays(df):
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array(c))
    return df.withColumn("trigger_types", listed("trig")).withColumn("unresolved_gaps", listed("gap")).drop("trig", "gap")


def synced(spark, sf_dir):
    before = F.lit("2024-01-01").cast("timestamp")
    stored = _arrays(view(spark, sf_dir, STORED)).withColumns(
        {"created_at": before, "updated_at": before, "last_seen_at": before}
    )
    return queue.sync(stored, _arrays(view(spark, sf_dir, BUILT)), "2024-02-01")


SYNCED = f"""
SELECT coalesce(b.bill_id, q.bill_id) AS bill_id, coalesce(b.packet_hash, q.packet_hash) AS packet_hash,
  CASE WHEN q.bill_id IS NULL THEN 'new' WHEN b.bill_id IS NULL AND status IN ('new', 'reviewing', 'needs_evidence') THEN 'superseded' ELSE status END AS status,
  coalesce(b.trig, q.trig) AS trig, coalesce(b.gap, q.gap) AS gap, analyst_notes,
  CASE WHEN q.bill_id IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created,
  CASE WHEN b.bill_id IS NOT NULL OR status IN ('new', 'reviewing', 'needs_evidence') THEN '2024-02-01' ELSE '2024-01-01' END AS updated
FROM ({BUILT}) AS b FULL JOIN ({STORED}) AS q ON b.bill_id = q.bill_id AND b.packet_hash = q.packet_hash
"""


@query("queue_sync", SYNCED)
def queue_sync(spark, sf_dir):
    rows = synced(spark, sf_dir)
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return rows.select(
        "bill_id", "packet_hash", "status", first("trigger_types").alias("trig"), first("unresolved_gaps").alias("gap"),
        "analyst_notes", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query(
    "queue_summary",
    f"""
    SELECT dimension, value, count(*) AS items FROM (SELECT 'status' AS dimension, status AS value FROM ({SYNCED}) AS s
      UNION ALL SELECT 'trigger', trig FROM ({SYNCED}) AS s UNION ALL SELECT 'gap', gap FROM ({SYNCED}) AS s WHERE gap <> '') AS x GROUP BY ALL
    """,
)
def queue_summary(spark, sf_dir):
    return queue.summary(synced(spark, sf_dir))


STEP = """CASE WHEN status = 'superseded' THEN 'historical_record' WHEN status IN ('completed', 'archived') THEN 'none'
  WHEN gap <> '' THEN 'resolve_evidence_gaps' ELSE 'review_packet' END"""


@query(
    "queue_view",
    f"""SELECT s.bill_id, packet_hash, status, {STEP} AS suggested_next_step, jurisdiction, title
    FROM ({SYNCED}) AS s JOIN ({corpus.BILLS}) AS b USING (bill_id)""",
)
def queue_view(spark, sf_dir):
    rows = queue.queue_view(
        synced(spark, sf_dir), corpus.bills(spark, sf_dir), corpus.version_heads(spark, sf_dir), corpus.sections(spark, sf_dir)
    )
    return rows.select("bill_id", "packet_hash", "status", "suggested_next_step", "jurisdiction", "title")


@query(
    "queue_listing",
    f"""SELECT s.bill_id, packet_hash, status FROM ({SYNCED}) AS s JOIN ({corpus.BILLS}) AS b USING (bill_id)
    WHERE status IN ('new', 'reviewing', 'needs_evidence') AND jurisdiction = 'TX' ORDER BY updated DESC, s.bill_id DESC, packet_hash DESC LIMIT 100""",
)
def queue_listing(spark, sf_dir):
    rows = queue.queue_view(
        synced(spark, sf_dir), corpus.bills(spark, sf_dir), corpus.version_heads(spark, sf_dir), corpus.sections(spark, sf_dir)
    )
    return queue.listed(rows, status="active", jurisdiction="tx").select("bill_id", "packet_hash", "status")


CHANGED = f"""
SELECT bill_id, version_id, section_id, packet_hash, CASE WHEN bill_id % 4 = 0 THEN 'completed' WHEN bill_id % 4 = 1 THEN 'superseded'
  WHEN bill_id % 4 = 2 THEN NULL ELSE 'reviewing' END AS status, 'seen' AS analyst_notes, '2024-03-01' AS at
FROM (SELECT bill_id, version_id, section_id, packet_hash FROM ({STORED}) AS q) AS k
"""


@query(
    "queue_update",
    f"""
    SELECT s.bill_id, s.packet_hash,
      CASE WHEN ok THEN coalesce(c.status, s.status) ELSE s.status END AS status,
      CASE WHEN ok THEN c.analyst_notes ELSE s.analyst_notes END AS analyst_notes, c.bill_id IS NOT NULL AND NOT ok AS refused
    FROM (SELECT s.*, c.bill_id AS cb, NOT (coalesce(c.status, '') = 'superseded' OR (c.status IS NOT NULL AND s.status = 'superseded')) AND c.bill_id IS NOT NULL AS ok
      FROM ({SYNCED}) AS s LEFT JOIN ({CHANGED}) AS c USING (bill_id, packet_hash)) AS s LEFT JOIN ({CHANGED}) AS c USING (bill_id, packet_hash)
    """,
)
def queue_update(spark, sf_dir):
    updated, refused = queue.update(synced(spark, sf_dir), view(spark, sf_dir, CHANGED))
    flag = refused.select(*packets.PACKET_KEY, F.lit(True).alias("refused"))
    return updated.join(flag, packets.PACKET_KEY, "left").select(
        "bill_id", "packet_hash", "status", "analyst_notes", F.coalesce("refused", F.lit(False)).alias("refused")
    )


PACKETS = "SELECT o_custkey AS bill_id, o_custkey * 7 + o_orderkey % 3 AS section_id, o_orderkey AS packet_id, o_orderpriority AS packet_hash, 0 AS version_id FROM orders"


@query(
    "latest_packets",
    f"SELECT bill_id, section_id, max(packet_id) AS packet_id, arg_max(packet_hash, packet_id) AS packet_hash FROM ({PACKETS}) AS p GROUP BY ALL",
)
def latest_packets(spark, sf_dir):
    return packets.latest_packets(view(spark, sf_dir, PACKETS)).drop("version_id")


@query(
    "new_packets",
    f"""SELECT bill_id, section_id, packet_hash, packet_id FROM ({PACKETS}) AS p WHERE packet_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
      AND (bill_id, section_id, packet_hash) NOT IN (SELECT (o_custkey, o_custkey * 7 + o_orderkey % 3, o_orderpriority) FROM orders WHERE o_orderstatus <> 'O')""",
)
def new_packets(spark, sf_dir):
    rows = view(spark, sf_dir, PACKETS).join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("packet_id"), "o_orderstatus"), "packet_id"
    )
    is_open = F.col("o_orderstatus") == "O"
    fresh = packets.new_packets(rows.filter(~is_open), rows.filter(is_open))
    return fresh.select("bill_id", "section_id", "packet_hash", "packet_id")


# External filings.
RECEIPTS = """
SELECT 'C' || CAST(o_custkey % 20 AS STRING) AS committee_id, o_orderkey AS seq,
  '{' || CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE '"sub_id":"R' || CAST(o_orderkey % 9000 AS STRING) || '",' END
  || '"contributor_name":"' || c_name || '","entity_type_desc":"' || CASE WHEN c_nationkey % 2 = 0 THEN 'Individual' ELSE 'Corporation' END
  || '","contribution_receipt_date":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '","contribution_receipt_amount":'
  || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '}' AS raw_json
FROM orders JOIN customer ON c_custkey = o_custkey
"""
RECEIPT_ROWS = """
SELECT 'C' || CAST(o_custkey % 20 AS STRING) AS committee_id, o_orderkey AS seq,
  CASE WHEN o_orderpriority = '1-URGENT' THEN substr(sha256('C' || CAST(o_custkey % 20 AS STRING) || ':' || c_name || ':' || CAST(CAST(o_orderdate AS DATE) AS STRING)
      || ':' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.0:' || CAST(o_orderkey AS STRING)), 1, 24) ELSE 'R' || CAST(o_orderkey % 9000 AS STRING) END AS record_id,
  CASE WHEN c_nationkey % 2 = 0 THEN 'person' ELSE 'organization' END AS contributor_type, lower(c_name) AS contributor_name,
  floor(o_totalprice) AS amount, CAST(CAST(o_orderdate AS DATE) AS STRING) AS observed_on
FROM orders JOIN customer ON c_custkey = o_custkey
"""


@query(
    "receipts",
    f"""
    SELECT contributor_type, contributor_name, committee_id, count(*) AS record_count, sum(amount) AS amount, arg_min(observed_on, seq) AS observed_on
    FROM (SELECT contributor_type, contributor_name, committee_id, record_id, min(seq) AS seq, arg_min(observed_on, seq) AS observed_on, max(amount) AS amount
      FROM ({RECEIPT_ROWS}) AS r GROUP BY ALL) AS x GROUP BY ALL
    """,
)
def receipts(spark, sf_dir):
    """Contributors and committees with the receipts on record."""
    return external.receipt_relationships(external.receipts(view(spark, sf_dir, RECEIPTS))).drop("evidence")


@query(
    "external_records",
    """
    SELECT 'fec' AS source_system, CASE WHEN o_orderstatus = 'F' THEN 'receipt' ELSE 'filing' END AS record_type, CAST(o_custkey AS STRING) AS external_id,
      arg_max(o_orderpriority, o_orderkey) AS raw_json,
      arg_max(CAST(CAST(o_orderdate AS DATE) AS STRING), o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS observed_on
    FROM orders GROUP BY ALL
    """,
)
def external_records(spark, sf_dir):
    rows = view(spark, sf_dir, """
        SELECT 'fec' AS source_system, CASE WHEN o_orderstatus = 'F' THEN 'receipt' ELSE 'filing' END AS record_type,
          CAST(o_custkey AS STRING) AS external_id, o_orderpriority AS raw_json, o_orderkey AS seq, '' AS source_url,
          CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS observed_on FROM orders """)
    return external.store_records(rows).drop("source_url")


FILINGS = """
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN upper(c_name) ELSE 'someone else' END AS asked_client,
  '{"filing_uuid":"U' || CAST(o_orderkey AS STRING) || '","filing_year":' || CAST(1990 + o_custkey % 30 AS STRING)
  || ',"client":{"id":"' || CAST(c_custkey AS STRING) || '","name":"' || c_name || '"},"registrant":{"id":"9","name":"Firm  ' || c_mktsegment || '"},'
  || CASE WHEN o_orderpriority = '1-URGENT' THEN '"income":0,"expenses":' ELSE '"income":' END || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
  || ',"dt_posted":"2024-05-05","lobbying_activities":[{"description":"' || o_orderpriority || '"},{"specific_issues":"roads"},{"description":""}]}' AS raw_json
FROM orders JOIN customer ON c_custkey = o_custkey
"""


@query(
    "lobbying_filings",
    """
    SELECT 'U' || CAST(o_orderkey AS STRING) AS filing_uuid, lower(c_name) AS client_name, 'firm ' || lower(c_mktsegment) AS registrant_name,
      floor(o_totalprice) AS amount, o_orderpriority || '; roads' AS issues, 1990 + o_custkey % 30 AS filing_year
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
    """,
)
def lobbying_filings(spark, sf_dir):
    """Filings whose client is exactly the one asked for."""
    raw = view(spark, sf_dir, FILINGS)
    rows = external.filings(raw).join(raw.select("seq", "asked_client"), "seq")
    return external.exact_client(rows).select(
        "filing_uuid", "client_name", "registrant_name", "amount", F.array_join("issues", "; ").alias("issues"), "filing_year"
    )


CANDIDATES = """
SELECT o_custkey AS person_id, 'P' || CAST(o_custkey AS STRING) AS candidate_id,
  '{"name":"X","committees":[{"committee_id":"C' || CAST(o_orderkey % 50 AS STRING) || '","name":"Friends  of ' || CAST(o_orderkey % 50 AS STRING)
  || '","designation":"P"},{"name":"no id"}]}' AS raw_json FROM orders
"""


@query(
    "candidate_committees",
    """SELECT DISTINCT o_custkey AS person_id, 'C' || CAST(o_orderkey % 50 AS STRING) AS committee_id,
    'friends of ' || CAST(o_orderkey % 50 AS STRING) AS committee_name, 'P' AS designation FROM orders""",
)
def candidate_committees(spark, sf_dir):
    rows = external.candidate_committees(view(spark, sf_dir, CANDIDATES))
    return rows.select("person_id", "committee_id", "committee_name", "designation")


LINKED = """
SELECT c_nationkey AS run_id, c_nationkey AS bill_id, c_custkey AS entity_id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'person' ELSE 'organization' END AS entity_type,
  lower(c_name) AS normalized_name, CASE WHEN c_acctbal > 5000 THEN 'P' || CAST(c_custkey AS STRING) END AS fec_candidate_id, c_mktsegment <> 'BUILDING' AS named FROM customer
"""
def research(spark, sf_dir):
    raw = view(spark, sf_dir, FILINGS)
    filed = external.exact_client(external.filings(raw).join(raw.select("seq", "asked_client"), "seq"))
    known = external.candidate_committees(view(spark, sf_dir, CANDIDATES))
    return external.research_steps(view(spark, sf_dir, LINKED), filed, known)


@query("research_steps", STEPS)
def research_steps(spark, sf_dir):
    return research(spark, sf_dir).select("run_id", "entity_id", "source_system", "status")


@query(
    "research_runs",
    f"""
    SELECT run_id, count(*) AS steps, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
      CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, any_value(title) AS title
    FROM ({STEPS}) AS s JOIN ({corpus.BILLS}) AS b ON b.bill_id = run_id GROUP BY run_id
    """,
)
def research_runs(spark, sf_dir):
    bills = corpus.bills(spark, sf_dir)
    correlations = view(spark, sf_dir, corpus.ENTITY_LINKS)
    runs = external.research_packets(external.run_status(research(spark, sf_dir)), bills, correlations)
    return runs.select("run_id", "steps", "skipped", "failed", "status", "title")


@query(
    "research_failures",
    f"""
    SELECT run_id, count(*) AS steps, CASE WHEN run_id % 4 = 1 THEN 'failed' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
    FROM ({STEPS}) AS s GROUP BY run_id
    """,
)
def research_failures(spark, sf_dir):
    """Runs of which some broke off."""
    steps = research(spark, sf_dir)
    errors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), F.when(F.col("n_nationkey") % 4 == 1, "source did not answer").alias("error"))
    return external.run_status(steps, errors).select("run_id", "steps", "status")


@query(
    "research_ordered",
    f"SELECT run_id, entity_id, source_system, status, row_number() OVER (PARTITION BY run_id ORDER BY entity_id, source_system) AS place FROM ({STEPS}) AS s",
)
def research_ordered(spark, sf_dir):
    """The steps of each run in order."""
    return external.numbered_steps(research(spark, sf_dir)).select("run_id", "entity_id", "source_system", "status", "place")


@query(
    "research_correlations",
    f"SELECT run_id, left_id, right_id, match_basis, confidence FROM (SELECT DISTINCT run_id FROM ({STEPS}) AS s) AS r JOIN ({CORRELATED}) AS c ON c.bill_id = r.run_id",
)
def research_correlations(spark, sf_dir):
    """What the entities of each researched bill correlate with."""
    found = correlation.correlate(view(spark, sf_dir, corpus.ENTITY_LINKS), corpus.entities(spark, sf_dir), view(spark, sf_dir, corpus.RELATIONSHIPS))
    return external.packet_correlations(research(spark, sf_dir), found).select("run_id", "left_id", "right_id", "match_basis", "confidence")


@query("receipt_records", f"SELECT DISTINCT contributor_type, contributor_name, committee_id, record_id FROM ({RECEIPT_ROWS}) AS r")
def receipt_records(spark, sf_dir):
    """The record ids behind each receipt relationship."""
    return external.receipt_records(external.receipts(view(spark, sf_dir, RECEIPTS)))


# Provenance.
PROVEN = "jurisdiction, session_code, bill_type, bill_number"


@query(
    "event_provenance",
    f"""
    SELECT c.bill_id, c.version_id, c.section_number, c.event_type, {PROVEN}, v.version_code, v.issued_on, v.source_url,
      o.version_code AS from_version_code, o.issued_on AS from_issued_on, o.source_url AS from_source_url
    FROM ({CHANGES}) AS c JOIN ({corpus.VERSION_HEADS}) AS v ON v.version_id = c.version_id LEFT JOIN ({corpus.VERSION_HEADS}) AS o ON o.version_id = c.from_version_id
    JOIN ({corpus.BILLS}) AS b ON b.bill_id = c.bill_id WHERE event_type <> 'unchanged'
    """,
)
def event_provenance(spark, sf_dir):
    """Provision events with their bill and both versions."""
    heads = corpus.version_heads(spark, sf_dir)
    changes = lineage.section_changes(corpus.sections(spark, sf_dir), lineage.version_pairs(heads)).filter("event_type <> 'unchanged'")
    rows = provenance.of_events(changes.drop("old_sha", "new_sha"), heads, corpus.bills(spark, sf_dir))
    return rows.drop("title", "from_version_id")


@query(
    "correlation_provenance",
    f"""
    WITH c AS ({CORRELATED}), e AS ({corpus.ENTITIES}), r AS ({corpus.RELATIONSHIPS}),
    ends AS (SELECT source_entity_id AS entity_id, r.* FROM r UNION ALL SELECT target_entity_id, r.* FROM r WHERE target_entity_id <> source_entity_id)
    SELECT c.bill_id, left_id, right_id, match_basis, a.canonical_name AS left_name, z.canonical_name AS right_name, z.entity_type AS right_type,
      relationship_id, source_system, relation_type, ends.source_url, observed_on, bill_number
    FROM c JOIN e a ON a.entity_id = left_id JOIN e z ON z.entity_id = right_id JOIN ends ON ends.entity_id = right_id JOIN ({corpus.BILLS}) AS b ON b.bill_id = c.bill_id
    """,
)
def correlation_provenance(spark, sf_dir):
    """Correlations with both entities and each relationship of the matched one."""
    entities_, relations = corpus.entities(spark, sf_dir), view(spark, sf_dir, corpus.RELATIONSHIPS)
    found = correlation.correlate(view(spark, sf_dir, corpus.ENTITY_LINKS), entities_, relations)
    rows = provenance.of_correlations(found, entities_, relations, corpus.bills(spark, sf_dir))
    return rows.select(
        "bill_id", "left_id", "right_id", "match_basis", "left_name", "right_name", "right_type", "relationship_id",
        "source_system", "relation_type", "source_url", "observed_on", "bill_number",
    )


@query(
    "scope_provenance",
    f"""
    SELECT o.bill_id, o.section_id, o.category, s.section_number, s.heading, v.version_code, v.source_url, b.bill_number
    FROM ({SCOPED}) AS o JOIN ({LATEST_SECTIONS}) AS s USING (section_id) JOIN ({corpus.VERSION_HEADS}) AS v ON v.version_id = s.version_id
    JOIN ({corpus.BILLS}) AS b ON b.bill_id = o.bill_id
    """,
)
def scope_provenance(spark, sf_dir):
    """Scope outliers with their section, version and bill."""
    sections = checkpointed(corpus.latest_sections(spark, sf_dir))
    found = scope.scope_outliers(sections, scope_bills(spark, sf_dir))
    rows = provenance.of_outliers(found, sections, corpus.version_heads(spark, sf_dir), corpus.bills(spark, sf_dir))
    return rows.select("bill_id", "section_id", "category", "section_number", "heading", "version_code", "source_url", "bill_number")


@query(
    "amendment_provenance",
    f"""
    SELECT x.bill_id, event_id, x.amendment_id, basis, section_number, event_type, amendment_date, search_text AS amendment_text
    FROM ({ATTRIBUTED}) AS x JOIN (SELECT section_id, section_number, version_id FROM ({corpus.SECTIONS}) AS s) AS s ON s.section_id = event_id
    JOIN ({CHANGES}) AS c USING (version_id, section_number) JOIN ({corpus.AMENDMENTS}) AS a ON a.amendment_id = x.amendment_id
    """,
)
def amendment_provenance(spark, sf_dir):
    """Candidate amendments with the event they may explain and their own text."""
    heads = corpus.version_heads(spark, sf_dir)
    sections = corpus.sections(spark, sf_dir)
    changes = lineage.section_changes(sections, lineage.version_pairs(heads)).select("version_id", "section_number", "event_type")
    events = sections.select(F.col("section_id").alias("event_id"), "version_id", "section_number").join(changes, ["version_id", "section_number"])
    amendments = view(spark, sf_dir, corpus.AMENDMENTS)
    rows = provenance.of_attributions(attributed(spark, sf_dir), events, amendments)
    return rows.select("bill_id", "event_id", "amendment_id", "basis", "section_number", "event_type", "amendment_date", "amendment_text")


# Listings.
@query("newest_records", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_records(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return listing.newest(rows, ["ts", "event_id"], 100, event_type="view").select("event_id", "user_id")


@query(
    "page",
    """SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, CASE WHEN 250 < (SELECT count(*) FROM orders) THEN 250 END AS next_offset
    FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 200""",
)
def page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return listing.page(rows, ["o_orderdate", "o_orderkey"], 200, 50).drop("o_orderdate")


@query(
    "page_deep",
    """
    WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n, count(*) OVER () AS total FROM orders),
    p AS (SELECT 'offset' AS way, o_orderkey, total, CASE WHEN total // 4 * 3 + 80 < total THEN total // 4 * 3 + 80 END AS next_offset FROM o WHERE n > total // 4 * 3 AND n <= total // 4 * 3 + 80)
    SELECT * FROM p
    UNION ALL SELECT 'cursor', o_orderkey, total, NULL FROM o WHERE n > total // 4 * 3 + 80 AND n <= total // 4 * 3 + 160
    """,
)
def page_deep(spark, sf_dir):
    """A page three quarters down the orders, and the page after its last row."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey")
    kept = listing.Pages(rows, ["o_orderpriority", "o_orderdate", "o_orderkey"])
    first = kept.page(kept.total // 4 * 3, 80)
    # One row: the cursor a reader holds.
    last = first.orderBy(F.desc("o_orderpriority"), F.desc("o_orderdate"), F.desc("o_orderkey")).first()
    after = kept.after((last["o_orderpriority"], last["o_orderdate"], last["o_orderkey"]), 80)
    shown = ["o_orderkey", "total", "next_offset"]
    return first.select(F.lit("offset").alias("way"), *shown).unionByName(
        after.select(F.lit("cursor").alias("way"), "o_orderkey", F.lit(kept.total).cast("long").alias("total"), F.lit(None).cast("int").alias("next_offset"))
    )


@query("record_lookup", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 77")
def record_lookup(spark, sf_dir):
    return listing.by_id(table(spark, sf_dir, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_orderpriority")


@query(
    "timeline",
    f"""
    SELECT bill_id, entry, label, detail, row_number() OVER (PARTITION BY bill_id, entry ORDER BY a, b, c) AS place FROM (
      SELECT bill_id, 'action' AS entry, action_date AS label, text AS detail, -(CAST(action_date AS DATE) - DATE '1970-01-01') AS a, '' AS b, -action_id AS c FROM ({corpus.ACTIONS}) AS x
      UNION ALL SELECT bill_id, 'sponsor', full_name, role, 0, role || '|' || full_name, seq FROM ({corpus.SPONSORS}) AS s
      UNION ALL SELECT bill_id, 'amendment', amendment_date, search_text, 0, '', -amendment_id FROM ({corpus.AMENDMENTS}) AS m) AS t
    """,
)
def timeline(spark, sf_dir):
    return listing.timeline(
        view(spark, sf_dir, corpus.ACTIONS), view(spark, sf_dir, corpus.SPONSORS), view(spark, sf_dir, corpus.AMENDMENTS)
    )


# Watches.
BEFORE = "o_orderdate < DATE '2000-01-01'"
KEYED = """
SELECT o_custkey AS bill_id, o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'version' WHEN o_orderstatus = 'O' THEN 'action' ELSE 'amendment' END AS kind,
  o_orderpriority || '|' || CAST(o_orderkey % 5 AS STRING) AS key FROM orders
"""


@query(
    "snapshot_diff",
    f"""
    SELECT bill_id, 'new_' || kind AS event_type, key AS event_key FROM ({KEYED}) AS k GROUP BY ALL
    HAVING count(*) FILTER ({BEFORE}) = 0 AND bill_id IN (SELECT o_custkey FROM orders WHERE {BEFORE})
    UNION ALL SELECT o_custkey, 'bill_discovered', 'TX:89R:hb:' || CAST(o_custkey AS STRING) FROM orders GROUP BY o_custkey HAVING count(*) FILTER ({BEFORE}) = 0
    """,
)
def snapshot_diff(spark, sf_dir):
    """What each bill has now and had not before the year 2000."""
    rows = view(spark, sf_dir, KEYED)
    then = rows.filter("o_orderdate < DATE '2000-01-01'")
    bills = lambda df: df.select("bill_id").distinct().withColumn(
        "bill_key", F.concat(F.lit("TX:89R:hb:"), F.col("bill_id").cast("string"))
    )
    found = watch.changes(bills(then), bills(rows), then.select("bill_id", "kind", "key"), rows.select("bill_id", "kind", "key"))
    return found.select("bill_id", "event_type", "event_key")


RULES = """
SELECT o_orderkey AS seq, 'watch ' || CAST(o_orderkey AS STRING) AS name, CASE WHEN o_orderstatus = 'F' THEN 'bill' WHEN o_orderstatus = 'O' THEN 'congress' ELSE 'session' END AS target_type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'tx' ELSE 'US' END AS jurisdiction, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 119 END AS congress,
  CASE WHEN o_orderstatus = 'F' THEN 'HR' END AS bill_type, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS STRING) END AS bill_number,
  CASE WHEN o_orderstatus = 'P' THEN '89R' END AS session, o_orderkey % 2 = 0 AS auto_research, o_orderkey % 3 = 0 AS auto_report FROM orders
"""


@query(
    "watch_rules",
    f"""
    SELECT target_type, upper(jurisdiction) AS jurisdiction, congress, lower(bill_type) AS bill_type, bill_number, session,
      arg_min(name, seq) AS name, arg_max(auto_research, seq) AS auto_research, arg_max(auto_report, seq) AS auto_report
    FROM ({RULES}) AS r WHERE congress IS NOT NULL AND NOT (target_type = 'congress' AND upper(jurisdiction) <> 'US')
      AND NOT (target_type = 'session' AND upper(jurisdiction) = 'US') GROUP BY ALL
    """,
)
def watch_rules(spark, sf_dir):
    """Valid rules, one per target; a later request switches the flags of the first."""
    valid, _ = watch.validated(view(spark, sf_dir, RULES))
    empty = valid.limit(0).withColumn("active", F.lit(True))
    return watch.upsert_rules(empty, valid).drop("active", "seq")


@query(
    "watch_rules_again",
    f"""
    WITH v AS (SELECT target_type, upper(jurisdiction) AS jurisdiction, congress, lower(bill_type) AS bill_type, bill_number, CASE WHEN target_type = 'session' THEN session END AS session, name, seq,
        auto_research, auto_report, seq % 4 = 0 AS stored, seq % 8 <> 0 OR seq % 4 <> 0 AS active FROM ({RULES}) AS r
      WHERE congress IS NOT NULL AND NOT (target_type = 'congress' AND upper(jurisdiction) <> 'US') AND NOT (target_type = 'session' AND upper(jurisdiction) = 'US')),
    s AS (SELECT target_type, jurisdiction, congress, bill_type, bill_number, session, arg_min(name, seq) AS name, min(seq) AS seq, false AS new, arg_max(active, seq) AS active,
        arg_max(auto_research, seq) AS auto_research, arg_max(auto_report, seq) AS auto_report FROM v WHERE stored GROUP BY ALL),
    u AS (SELECT target_type, jurisdiction, congress, bill_type, bill_number, session, name, seq, new, active, auto_research, auto_report FROM s
      UNION ALL SELECT target_type, jurisdiction, congress, bill_type, bill_number, session, name, seq, true, true, auto_research, auto_report FROM v WHERE NOT stored)
    SELECT target_type, jurisdiction, congress, bill_type, bill_number, session, arg_min(name, (new, seq)) AS name, arg_max(active, (new, seq)) AS active,
      arg_max(auto_research, (new, seq)) AS auto_research, arg_max(auto_report, (new, seq)) AS auto_report FROM u GROUP BY ALL
    """,
)
def watch_rules_again(spark, sf_dir):
    """Requests for targets that are stored already: they keep their name, become active and take the flags."""
    valid, _ = watch.validated(view(spark, sf_dir, RULES))
    stored = watch.upsert_rules(valid.limit(0).withColumn("active", F.lit(True)), valid.filter("seq % 4 = 0"))
    last = valid.filter("seq % 4 = 0").withColumn("session", F.when(F.col("target_type") == "session", F.col("session")))
    state = last.groupBy(*watch.TARGET).agg(F.max_by(F.col("seq") % 8 != 0, "seq").alias("_active"))
    held = stored.join(state, history.same_key(stored, state, watch.TARGET)).select(*[stored[c] for c in stored.columns if c != "active"], F.col("_active").alias("active"))
    return watch.upsert_rules(held, valid.filter("seq % 4 <> 0")).drop("seq")


@query(
    "watch_patches",
    """
    SELECT c_custkey AS rule_id, coalesce((SELECT arg_max(o_orderstatus = 'O', o_orderkey) FILTER (o_orderstatus <> 'P') FROM orders WHERE o_custkey = c_custkey), c_acctbal > 0) AS active,
      coalesce((SELECT arg_max(o_orderkey % 2 = 0, o_orderkey) FILTER (o_orderpriority = '1-URGENT') FROM orders WHERE o_custkey = c_custkey), false) AS auto_research, true AS auto_report
    FROM customer
    """,
)
def watch_patches(spark, sf_dir):
    """Rules after patches that give some flags each; the last given value of a flag counts."""
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), (F.col("c_acctbal") > 0).alias("active"), F.lit(False).alias("auto_research"), F.lit(True).alias("auto_report"))
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    patches = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("rule_id"), F.when(status != "P", status == "O").alias("active"),
        F.when(urgent, F.col("o_orderkey") % 2 == 0).alias("auto_research"), F.lit(None).cast("boolean").alias("auto_report"), F.col("o_orderkey").alias("at"),
    )
    return watch.patch_rules(rules, patches)


@query(
    "watch_keys",
    f"""
    SELECT bill_id, 'bill' AS kind, upper(jurisdiction) || ':' || session_code || ':' || lower(bill_type) || ':' || bill_number AS key FROM ({corpus.BILLS}) AS b
    UNION ALL SELECT bill_id, 'action', action_date || '|' || text FROM ({corpus.ACTIONS}) AS a
    UNION ALL SELECT bill_id, 'document', document_type || '|' || source_url FROM ({corpus.DOCUMENTS}) AS d
    UNION ALL SELECT o_custkey, 'amendment', 'hamdt|' || CAST(o_orderkey AS STRING) FROM orders
    UNION ALL SELECT o_custkey, 'version', sha256(o_orderpriority) FROM orders
    """,
)
def watch_keys(spark, sf_dir):
    """The keys by which watches tell what is new."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bill_id"), F.lit("hamdt").alias("amendment_type"), F.col("o_orderkey").alias("amendment_number"), F.sha2("o_orderpriority", 256).alias("sha256"))
    shown = lambda rows, kind, key: rows.select("bill_id", F.lit(kind).alias("kind"), key.alias("key"))
    parts = [
        shown(corpus.bills(spark, sf_dir), "bill", history.bill_key()),
        shown(view(spark, sf_dir, corpus.ACTIONS), "action", history.child_key("action")),
        shown(view(spark, sf_dir, corpus.DOCUMENTS), "document", history.child_key("document")),
        shown(orders, "amendment", history.child_key("amendment")),
        shown(orders, "version", history.child_key("version")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@query("written_table", f"SELECT bill_id, title, jurisdiction FROM ({corpus.BILLS}) AS b WHERE jurisdiction = 'TX'")
def written_table(spark, sf_dir):
    """Bills written by jurisdiction, and one partition of them read back."""
    path = shared_path(spark, "bills")
    tables.write_table(corpus.bills(spark, sf_dir).select("bill_id", "title", "jurisdiction"), path, ["jurisdiction"])
    return spark.read.parquet(path).filter("jurisdiction = 'TX'").select("bill_id", "title", "jurisdiction")


@query(
    "watch_rule_problems",
    f"""
    SELECT seq, CASE WHEN target_type = 'congress' AND upper(jurisdiction) <> 'US' THEN 'congress watches apply to US federal legislation'
      WHEN target_type = 'session' AND upper(jurisdiction) = 'US' THEN 'US federal monitoring uses congress watches'
      WHEN target_type = 'bill' THEN 'bill watches require congress, bill_type, and bill_number'
      WHEN target_type = 'congress' THEN 'congress watches require congress' ELSE 'session watches require congress/session number and session' END AS problem
    FROM ({RULES}) AS r WHERE congress IS NULL OR (target_type = 'congress' AND upper(jurisdiction) <> 'US') OR (target_type = 'session' AND upper(jurisdiction) = 'US')
    """,
)
def watch_rule_problems(spark, sf_dir):
    _, refused = watch.validated(view(spark, sf_dir, RULES))
    return refused.select("seq", "problem")
