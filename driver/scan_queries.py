"""Rule scans, section splitting, fiscal signals, entities and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver import corpus
from driver.base import query, table, texts, view
from driver.sqltext import distinct_in_order, excerpt, matches, quoted, strip
from ledgerline.functions import rules as R
from ledgerline.functions import text as T
from ledgerline.operators import entities, fiscal, history, metrics, scan, sections as S
from ledgerline.plans import packets

RULE_MONEY = r"(?i)\$\s?([0-9][0-9,]*(?:\.\d+)?)\s*(million|billion|thousand)?"


def first_hit_sql(source: str, keys: str, text: str, rule: R.Rule, before: int, after: int) -> str:
    p = quoted(f"(?{rule.flags}){rule.pattern}")
    hit = f"regexp_extract({text}, {p})"
    at = f"(strpos({text}, {hit}) - 1)"
    return f"""SELECT {keys}, {quoted(rule.kind)} AS kind, {rule.weight} AS severity, {hit} AS detail,
      {excerpt(text, at, f'length({hit})', before, after)} AS evidence
      FROM ({source}) AS s WHERE regexp_matches({text}, {p})"""


def findings_sql(source: str) -> str:
    parts = [
        first_hit_sql(source, "bill_id, version_id, section_id", "section_text", rule, 180, 260)
        for rule in R.SECTION_RULES
    ]
    parts.append(
        f"""SELECT bill_id, version_id, section_id, 'money', 0.5, regexp_replace(hit, '[,\\s]+$', ''),
        {excerpt('txt', 'start0', 'length(hit)', 140, 180)}
        FROM ({matches(source, 'bill_id, version_id, section_id', 'section_text', RULE_MONEY)}) AS m"""
    )
    refs = distinct_in_order("refs")
    parts.append(
        f"""SELECT bill_id, version_id, section_id, 'cross_reference_density', 0.45,
        array_to_string(d, '; '), array_to_string(d, '; ')
        FROM (SELECT bill_id, version_id, section_id, {refs} AS d FROM (
          SELECT *, regexp_extract_all(section_text, {quoted('(?i)' + R.REFERENCE_RULE.pattern)}) AS refs
          FROM ({source}) AS s) AS r) AS q WHERE len(d) >= 2"""
    )
    return " UNION ALL ".join(parts)


def numbered_findings_sql(source: str) -> str:
    """Findings with their rule's place and the place of the hit in the text."""
    keys = "bill_id, version_id, section_id"
    parts = [
        f"SELECT section_id, kind, severity, evidence, {k} AS rule_no, 0 AS hit_no FROM ({first_hit_sql(source, keys, 'section_text', rule, 180, 260)}) AS r{k}(bill_id, version_id, section_id, kind, severity, detail, evidence)"
        for k, rule in enumerate(R.SECTION_RULES)
    ]
    parts.append(f"SELECT section_id, 'money', 0.5, {excerpt('txt', 'start0', 'length(hit)', 140, 180)}, 100, i FROM ({matches(source, keys, 'section_text', RULE_MONEY)}) AS m")
    parts.append(
        f"""SELECT section_id, 'cross_reference_density', 0.45, array_to_string(d, '; '), 200, 0
        FROM (SELECT section_id, {distinct_in_order('refs')} AS d FROM (
          SELECT *, regexp_extract_all(section_text, {quoted('(?i)' + R.REFERENCE_RULE.pattern)}) AS refs FROM ({source}) AS s) AS r) AS q WHERE len(d) >= 2"""
    )
    return " UNION ALL ".join(parts)


LATEST_SECTIONS = f"""
SELECT * FROM ({corpus.SECTIONS}) AS sec WHERE version_id IN (SELECT version_id FROM ({corpus.LATEST}) AS l)
"""


@query("rule_findings", findings_sql(corpus.SECTIONS))
def rule_findings(spark, sf_dir):
    rows = scan.section_findings(
        corpus.sections(spark, sf_dir), ["bill_id", "version_id", "section_id"]
    )
    return rows.drop("finding_no", "label")


@query(
    "findings_by_kind",
    f"SELECT bill_id, kind, count(*) AS findings FROM ({findings_sql(LATEST_SECTIONS)}) AS f GROUP BY bill_id, kind",
)
def findings_by_kind(spark, sf_dir):
    """Latest version of each bill, scanned and counted."""
    found = scan.section_findings(corpus.latest_sections(spark, sf_dir), ["bill_id"])
    return scan.counts_by(found, ["bill_id"])


@query(
    "findings_in_context",
    f"""
    SELECT f.version_id, s.ordinal, s.section_number, s.heading, f.kind, f.severity, h.bill_id, h.version_code
    FROM ({findings_sql(corpus.SECTIONS)}) AS f
    JOIN ({corpus.SECTIONS}) AS s USING (section_id) JOIN ({corpus.VERSION_HEADS}) AS h ON h.version_id = f.version_id
    """,
)
def findings_in_context(spark, sf_dir):
    sections = corpus.sections(spark, sf_dir)
    found = scan.section_findings(sections, ["version_id", "ordinal"]).select(
        "version_id", "ordinal", "kind", "severity"
    )
    return scan.findings_in_context(found, sections, corpus.version_heads(spark, sf_dir))


@query(
    "section_split",
    f"""
    SELECT version_id, ordinal, section_number, heading, {strip('section_text')} AS section_text
    FROM ({corpus.LINES}) AS line_texts
    """,
)
def section_split(spark, sf_dir):
    """Whole version texts are split back into their sections."""
    texts = corpus.versions(spark, sf_dir).select("version_id", "text").filter("text IS NOT NULL")
    return S.split_sections(texts)


# A pack for the given prose, which holds none of the legislative wording.
PROSE_PACK = [
    R.Rule("license", 0.5, r"licen[cs]e|copyright|all rights reserved", "License wording"),
    R.Rule("address", 0.6, r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "Mail address"),
    R.Rule("digits", 0.4, r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", "Telephone number"),
    R.Rule("suffix", 0.3, r"[a-z]+tion ", "Word ending in -tion"),
]


@query(
    "document_rules",
    " UNION ALL ".join(
        first_hit_sql("SELECT doc_id, text FROM documents", "doc_id", "text", rule, 180, 260)
        for rule in PROSE_PACK
    ),
)
def document_rules(spark, sf_dir):
    """A rule pack of one's own over every whole document."""
    rows = scan.first_match_findings(texts(spark, sf_dir, "documents"), ["doc_id"], "text", PROSE_PACK)
    return rows.drop("label")


@query(
    "document_rule_counts",
    f"""
    SELECT source, kind, count(*) AS findings FROM ({
        ' UNION ALL '.join(
            f"SELECT source, {quoted(r.kind)} AS kind FROM documents WHERE regexp_matches(text, {quoted('(?i)' + r.pattern)})"
            for r in PROSE_PACK)}) AS hits GROUP BY source, kind
    """,
)
def document_rule_counts(spark, sf_dir):
    rows = scan.first_match_findings(
        texts(spark, sf_dir, "documents"), ["source"], "text", PROSE_PACK
    )
    return scan.counts_by(rows, ["source"])


PROSE_MATCH = r"(?i)(?:that|with|from) [a-z]+"


@query(
    "all_match_excerpts",
    f"""
    SELECT doc_id, i - 1 AS match_no, start0 AS start, hit AS matched,
      sha256({excerpt('txt', 'start0', 'length(hit)', 140, 180)}) AS evidence
    FROM ({matches('SELECT doc_id, text FROM documents', 'doc_id', 'text', PROSE_MATCH)}) AS m
    """,
)
def all_match_excerpts(spark, sf_dir):
    rows = scan.match_excerpts(
        texts(spark, sf_dir, "documents"), ["doc_id"], "text", PROSE_MATCH, 140, 180
    )
    return rows.withColumn("evidence", F.sha2("evidence", 256))


@query(
    "ordered_distinct",
    f"""
    SELECT doc_id, len(hits) AS mentions, len(d) AS distinct_mentions,
      array_to_string(d, '; ') AS first_mentions
    FROM (SELECT doc_id, hits, {distinct_in_order('hits')} AS d FROM (
      SELECT doc_id, regexp_extract_all(text, {quoted(PROSE_MATCH)}) AS hits FROM documents) AS x) AS y
    """,
)
def ordered_distinct(spark, sf_dir):
    """Mentions per document: how many, how many different, and which."""
    hits = F.regexp_extract_all("text", F.lit(PROSE_MATCH), F.lit(0))
    rows = texts(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"))
    distinct = F.array_distinct("hits")
    return rows.select(
        "doc_id",
        F.size("hits").alias("mentions"),
        F.size(distinct).alias("distinct_mentions"),
        F.array_join(distinct, "; ").alias("first_mentions"),
    )


MONEY_TEXTS = """
SELECT o_orderkey, o_custkey, CASE
  WHEN o_orderpriority = '1-URGENT' THEN 'a total of $' || CAST(o_custkey AS STRING) || '.5 million was set'
  WHEN o_orderpriority = '2-HIGH' THEN 'the sum of $ 1,250,' || CAST(100 + o_custkey % 900 AS STRING) || ', as agreed'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'paid $' || CAST(o_custkey AS STRING) || ' thousand'
  WHEN o_orderpriority = '5-LOW' THEN 'no amount' ELSE '$' || CAST(o_custkey % 7 AS STRING) || ' BILLION over time' END AS t
FROM orders
"""


@query(
    "money_rollup",
    f"""
    SELECT o_custkey, count(v) AS mentions, round(sum(v), 2) AS total, max(v) AS largest FROM (
      SELECT o_custkey, TRY_CAST(nullif(replace(regexp_extract(t, '\\$\\s*([0-9][0-9,]*(?:\\.\\d+)?)', 1), ',', ''), '') AS DOUBLE)
        * CASE lower(regexp_extract(t, '(?i)\\$\\s*[0-9][0-9,]*(?:\\.\\d+)?\\s*(thousand|million|billion)?', 1))
          WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END AS v
      FROM ({MONEY_TEXTS}) AS m) AS x GROUP BY o_custkey
    """,
)
def money_rollup(spark, sf_dir):
    rows = view(spark, sf_dir, MONEY_TEXTS).withColumn("v", T.money_value(F.col("t")))
    return rows.groupBy("o_custkey").agg(
        F.count("v").alias("mentions"),
        F.round(F.sum("v"), 2).alias("total"),
        F.max("v").alias("largest"),
    )


# Fiscal signals.
def fiscal_sql(source: str) -> str:
    """source: bill_id, document_id, source_kind, text."""
    keys = "bill_id, document_id, source_kind"
    parts = []
    for rule in R.FISCAL_RULES:
        found = matches(source, keys, "text", f"(?{rule.flags}){rule.pattern}")
        parts.append(
            f"""SELECT {keys}, {quoted(rule.kind)} AS category, {rule.weight} AS confidence,
            {strip(excerpt('txt', 'start0', 'length(hit)', 220, 320))} AS evidence,
            CAST(NULL AS DOUBLE) AS largest_amount FROM ({found}) AS m"""
        )
    money = matches(source, keys, "text", RULE_MONEY)
    value = f"""CAST(replace(regexp_extract(hit, {quoted(RULE_MONEY)}, 1), ',', '') AS DOUBLE)
      * CASE lower(regexp_extract(hit, {quoted(RULE_MONEY)}, 2)) WHEN 'thousand' THEN 1e3
        WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END"""
    parts.append(
        f"""SELECT {keys}, 'explicit_fiscal_amount', 0.92, arg_max(trimmed, (v, -i)), max(v)
        FROM (SELECT {keys}, i, regexp_replace(hit, '[,\\s]+$', '') AS trimmed, {value} AS v FROM ({money}) AS m) AS y
        GROUP BY {keys}"""
    )
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) AS all_findings"


FISCAL_BILLS = f"""
SELECT l.bill_id, CAST(NULL AS BIGINT) AS document_id, 'bill_text' AS source_kind, v.text
FROM ({corpus.LATEST}) AS l JOIN ({corpus.VERSION_TEXTS_ORACLE}) AS v USING (version_id)
"""
FISCAL_DOCUMENTS = f"""
SELECT bill_id, document_id, document_type AS source_kind, text FROM ({corpus.DOCUMENTS}) AS d
"""


@query(
    "fiscal_signals",
    f"""SELECT bill_id, document_id, source_kind, category, confidence, evidence, largest_amount FROM (
      {fiscal_sql(f'{FISCAL_BILLS} UNION ALL {FISCAL_DOCUMENTS}')}) AS f""",
)
def fiscal_signals(spark, sf_dir):
    """Signals of the latest bill texts and of all documents."""
    found = _fiscal(spark, sf_dir)
    return found.filter("source_kind <> 'comparison'").select(
        "bill_id", "document_id", "source_kind", "category", "confidence", "evidence", "largest_amount"
    )


def _fiscal(spark, sf_dir):
    documents = view(spark, sf_dir, corpus.DOCUMENTS, slow="orders")
    return fiscal.fiscal_findings(corpus.latest_versions(spark, sf_dir), documents)


COMPARED = f"""
WITH b AS (SELECT bill_id, list(DISTINCT category) AS cats, max(largest_amount) AS largest FROM (
    {fiscal_sql(FISCAL_BILLS)}) AS fb GROUP BY bill_id),
  n AS (SELECT bill_id, document_id, list(DISTINCT category) AS cats, max(largest_amount) AS largest FROM (
    {fiscal_sql(FISCAL_DOCUMENTS)}) AS fd GROUP BY bill_id, document_id),
  d AS (SELECT d.*, coalesce(b.cats, []) AS bill_cats, coalesce(b.largest, 0) AS bill_largest,
      coalesce(n.cats, []) AS doc_cats, coalesce(n.largest, 0) AS doc_largest
    FROM ({corpus.DOCUMENTS}) AS d LEFT JOIN b USING (bill_id) LEFT JOIN n USING (bill_id, document_id))
{' UNION ALL '.join(
    f'''SELECT bill_id, document_id, 'analysis_scope_gap' AS category, 0.68 AS confidence,
    'Bill signal: {c}; analysis: ' || coalesce(description, 'bill analysis') AS evidence
    FROM d WHERE document_type = 'bill_analysis' AND list_contains(bill_cats, '{c}')
    AND NOT regexp_matches(text, {quoted('(?i)' + p)})''' for c, p in R.ANALYSIS_TERMS.items())}
UNION ALL SELECT bill_id, document_id, 'fiscal_note_amount_exceeds_bill_text', 0.84,
  'Largest fiscal-note amount: $' || format('{{:,}}', CAST(doc_largest AS BIGINT)) || '; largest bill-text amount: $'
  || format('{{:,}}', CAST(bill_largest AS BIGINT)) || '.'
  FROM d WHERE document_type = 'fiscal_note' AND doc_largest > bill_largest AND doc_largest >= 100000
{' '.join(
    f'''UNION ALL SELECT bill_id, document_id, 'fiscal_effect_not_explicit_in_bill_text', 0.76,
    'Fiscal note: ' || coalesce(description, source_url) || '; signal: {c}.'
    FROM d WHERE document_type = 'fiscal_note' AND list_contains(doc_cats, '{c}') AND NOT list_contains(bill_cats, '{c}')'''
    for c in ('implementation_cost', 'revenue_effect'))}
"""


@query("fiscal_comparison", COMPARED)
def fiscal_comparison(spark, sf_dir):
    found = _fiscal(spark, sf_dir).filter("source_kind = 'comparison'")
    return found.select("bill_id", "document_id", "category", "confidence", "evidence")


FISCAL_HASHED = f"""
SELECT bill_id, document_id, source_kind, category, confidence, evidence, sha256(concat_ws('|', category, source_kind, coalesce(CAST(document_id AS STRING), 'None'), evidence)) AS evidence_hash
FROM ({fiscal_sql(f'{FISCAL_BILLS} UNION ALL {FISCAL_DOCUMENTS}')}) AS own
UNION ALL SELECT bill_id, document_id, 'comparison', category, confidence, evidence, sha256(concat_ws('|', category, 'comparison', coalesce(CAST(document_id AS STRING), 'None'), evidence)) FROM ({COMPARED}) AS cmp
"""


@query("fiscal_hashes", f"SELECT bill_id, document_id, source_kind, category, confidence, evidence_hash FROM ({FISCAL_HASHED}) AS h")
def fiscal_hashes(spark, sf_dir):
    """The hash by which each fiscal finding is known."""
    return _fiscal(spark, sf_dir).select("bill_id", "document_id", "source_kind", "category", "confidence", "evidence_hash")


@query(
    "fiscal_context",
    f"""SELECT bill_id, category, evidence_hash FROM ({FISCAL_HASHED}) AS h
    QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY confidence DESC, evidence_hash) <= 20""",
)
def fiscal_context(spark, sf_dir):
    """The twenty fiscal findings that the packets of a bill show."""
    return packets.fiscal_context(_fiscal(spark, sf_dir)).select("bill_id", "category", "evidence_hash")


@query(
    "fiscal_provenance",
    f"""
    SELECT f.bill_id, f.document_id, f.category, coalesce(d.source_url, b.source_url) AS source_url,
      d.description AS document_description, count(*) AS findings
    FROM ({fiscal_sql(f'{FISCAL_BILLS} UNION ALL {FISCAL_DOCUMENTS}')}) AS f
    LEFT JOIN ({corpus.DOCUMENTS}) AS d ON d.document_id = f.document_id
    LEFT JOIN ({corpus.BILLS}) AS b ON b.bill_id = f.bill_id GROUP BY ALL
    """,
)
def fiscal_provenance(spark, sf_dir):
    """Findings per category with the document or bill they come from."""
    documents = view(spark, sf_dir, corpus.DOCUMENTS)
    found = _fiscal(spark, sf_dir).filter("source_kind <> 'comparison'")
    shown = fiscal.with_documents(found, documents, corpus.bills(spark, sf_dir))
    return shown.groupBy(
        "bill_id", "document_id", "category", "source_url", "document_description"
    ).agg(F.count(F.lit(1)).alias("findings"))


# Entities.
def mentions_sql(source: str) -> str:
    keys = "bill_id, version_id, section_id"
    packs = [
        ("beneficiary_class", "potential_beneficiary_class", 0.7, f"(?i){p}") for p in R.BENEFICIARY_PATTERNS
    ] + [
        ("organization", "named_organization", 0.9, R.ORGANIZATION_PATTERN),
        ("geography", "named_geography", 0.85, R.GEOGRAPHY_PATTERN),
    ]
    return " UNION ALL ".join(
        f"""SELECT {keys}, '{kind}' AS entity_type, '{link}' AS link_type, {weight} AS confidence,
        {strip('hit')} AS name, lower({strip('hit')}) AS normalized_name, start0 AS start,
        {excerpt('txt', 'start0', 'length(hit)', 180, 260)} AS evidence
        FROM ({matches(source, keys, 'section_text', pattern)}) AS m"""
        for kind, link, weight, pattern in packs
    )


@query("entity_mentions", f"SELECT * EXCLUDE (version_id) FROM ({mentions_sql(LATEST_SECTIONS)}) AS m")
def entity_mentions(spark, sf_dir):
    return entities.section_mentions(
        corpus.latest_sections(spark, sf_dir), ["bill_id", "section_id"]
    )


LINKS_SQL = f"""
SELECT bill_id, section_id, entity_type, normalized_name, link_type, arg_min(evidence, (start, evidence)) AS evidence,
  any_value(confidence) AS confidence, arg_min(name, (start, evidence)) AS name
FROM ({mentions_sql(LATEST_SECTIONS)}) AS m GROUP BY ALL
"""


@query(
    "entity_links",
    f"""
    SELECT l.bill_id, l.section_id, s.section_number, l.entity_type, l.normalized_name, l.link_type, l.confidence, l.evidence,
      e.canonical_name
    FROM ({LINKS_SQL}) AS l JOIN ({corpus.SECTIONS}) AS s USING (section_id)
    JOIN (SELECT entity_type, normalized_name, arg_min(name, section_id * 100000 + start) AS canonical_name
      FROM ({mentions_sql(LATEST_SECTIONS)}) AS m GROUP BY ALL) AS e USING (entity_type, normalized_name)
    """,
)
def entity_links(spark, sf_dir):
    """Links with their entity and section."""
    sections = corpus.latest_sections(spark, sf_dir)
    found = entities.section_mentions(sections, ["bill_id", "section_id"])
    empty = F.create_map().cast("map<string,string>")
    nodes = history.merge_entities(
        found.select(
            "entity_type", "name", empty.alias("external_ids"), empty.alias("metadata"),
            (F.col("section_id") * 100000 + F.col("start")).alias("seq"),
        )
    )
    shown = entities.links_in_context(entities.links(found), nodes, sections)
    return shown.drop("start", "name")


@query(
    "sponsor_links",
    f"""
    SELECT DISTINCT bill_id, role AS link_type, lower(replace(full_name, '  ', ' ')) AS normalized_name,
      'Official ' || role || ' record for ' || full_name || '.' AS evidence
    FROM ({corpus.SPONSORS}) AS s
    """,
)
def sponsor_links(spark, sf_dir):
    found = entities.sponsor_mentions(view(spark, sf_dir, corpus.SPONSORS))
    kept = entities.links(found.withColumn("start", F.col("seq")))
    return kept.select("bill_id", "link_type", "normalized_name", "evidence")


@query(
    "citation_audit",
    r"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(used)), ',') AS used_ids,
      array_to_string(list_sort(list_filter(list_distinct(used), lambda x: NOT list_contains(valid, x))), ',') AS invalid_ids,
      len(used) > 0 AS has_citations,
      CASE WHEN len(used) = 0 OR len(list_filter(used, lambda x: NOT list_contains(valid, x))) > 0
        THEN 'rejected' ELSE 'complete' END AS narrative_status
    FROM (SELECT d.doc_id, ['D1', 'S1', 'Q' || CAST(coalesce(l.quality, 9) AS STRING)] AS valid,
      CASE WHEN l.doc_id IS NULL THEN [] ELSE ['S1', 'Q' || CAST(l.quality AS STRING), 'D' || CAST(l.toxic AS STRING), 'S1'] END AS used
      FROM documents d LEFT JOIN labels l USING (doc_id)) AS x
    """,
)
def citation_audit(spark, sf_dir):
    """Narratives cite the labels of a document; only some of those ids exist."""
    labels = table(spark, sf_dir, "labels")
    text = F.concat(
        F.lit("Seen in [S1] and [Q"), "quality", F.lit("], also [D"), "toxic", F.lit("] and [S1].")
    )
    rows = texts(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    rows = rows.withColumn("narrative", F.coalesce(text, F.lit("Nothing cited."))).withColumn(
        "valid_ids",
        F.array(F.lit("D1"), F.lit("S1"), F.concat(F.lit("Q"), F.coalesce("quality", F.lit(9)))),
    )
    audited = scan.cited(rows, "narrative", "valid_ids")
    return audited.select(
        "doc_id", F.array_join("used_ids", ",").alias("used_ids"),
        F.array_join("invalid_ids", ",").alias("invalid_ids"), "has_citations", "narrative_status",
    )


METRICS_SQL = f"""
WITH heads AS ({corpus.VERSION_HEADS}), latest AS ({corpus.LATEST}), sec AS ({LATEST_SECTIONS}),
  f AS ({findings_sql(LATEST_SECTIONS)}),
  money AS (SELECT bill_id, count(*) AS n, sum(v) AS total, max(v) AS most FROM (
    SELECT bill_id, CAST(replace(regexp_extract(detail, {quoted(RULE_MONEY)}, 1), ',', '') AS DOUBLE)
      * CASE lower(regexp_extract(detail, {quoted(RULE_MONEY)}, 2)) WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6
        WHEN 'billion' THEN 1e9 ELSE 1 END AS v FROM f WHERE kind = 'money') AS x GROUP BY bill_id)
SELECT b.bill_id, l.version_code AS latest_version, coalesce(v.n, 0) AS version_count, coalesce(s.n, 0) AS section_count,
  coalesce(s.words, 0) AS word_count, coalesce(c.n, 0) AS finding_count, coalesce(money.n, 0) AS money_mentions,
  coalesce(money.total, 0) AS money_total, coalesce(money.most, 0) AS money_largest,
  coalesce(c.exemption, 0) AS exemption, coalesce(c.unspecified, 0) AS unspecified_spending,
  coalesce(k.sponsors, 0) AS sponsor_count, coalesce(k.cosponsors, 0) AS cosponsor_count,
  coalesce(a.n, 0) AS amendment_count, coalesce(e.geo, 0) AS named_geography_links,
  coalesce(e.ben, 0) AS beneficiary_class_links
FROM ({corpus.BILLS}) AS b LEFT JOIN latest l USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) AS n FROM heads GROUP BY 1) AS v USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) AS n, sum(len(string_split_regex({strip('section_text')}, '\\s+'))) AS words FROM sec GROUP BY 1) AS s USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) AS n, count(*) FILTER (kind = 'exemption') AS exemption,
  count(*) FILTER (kind = 'unspecified_spending') AS unspecified FROM f GROUP BY 1) AS c USING (bill_id)
LEFT JOIN money USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) FILTER (role = 'sponsor') AS sponsors, count(*) FILTER (role = 'cosponsor') AS cosponsors
  FROM ({corpus.SPONSORS}) AS sp GROUP BY 1) AS k USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) AS n FROM ({corpus.AMENDMENTS}) AS am GROUP BY 1) AS a USING (bill_id)
LEFT JOIN (SELECT bill_id, count(*) FILTER (link_type = 'named_geography') AS geo,
  count(*) FILTER (link_type = 'potential_beneficiary_class') AS ben FROM ({LINKS_SQL}) AS li GROUP BY 1) AS e USING (bill_id)
"""


@query(
    "bill_finding_counts",
    f"SELECT bill_id, kind, count(*) AS findings FROM ({findings_sql(LATEST_SECTIONS)}) AS f GROUP BY ALL",
)
def bill_finding_counts(spark, sf_dir):
    """Findings of each bill's latest text by kind."""
    return metrics.finding_counts(scan.section_findings(corpus.latest_sections(spark, sf_dir), ["bill_id"]))


@query("bill_entity_types", f"SELECT bill_id, entity_type, count(*) AS links FROM ({LINKS_SQL}) AS l GROUP BY ALL")
def bill_entity_types(spark, sf_dir):
    """Entities of each bill's latest text by type."""
    sections = corpus.latest_sections(spark, sf_dir)
    return metrics.entity_types(entities.links(entities.section_mentions(sections, ["bill_id", "section_id"])))


@query("bill_metrics", METRICS_SQL)
def bill_metrics(spark, sf_dir):
    sections = corpus.latest_sections(spark, sf_dir)
    found = scan.section_findings(sections, ["bill_id"])
    linked = entities.links(entities.section_mentions(sections, ["bill_id", "section_id"]))
    rows = metrics.bill_metrics(
        corpus.bills(spark, sf_dir), corpus.version_heads(spark, sf_dir), sections, found,
        view(spark, sf_dir, corpus.SPONSORS), view(spark, sf_dir, corpus.AMENDMENTS), linked,
    )
    return rows.select(
        "bill_id", "latest_version", "version_count", "section_count", "word_count", "finding_count",
        "money_mentions", "money_total", "money_largest", "exemption", "unspecified_spending",
        "sponsor_count", "cosponsor_count", "amendment_count", "named_geography_links",
        "beneficiary_class_links",
    )
