"""Evidence packets: everything on record about one section, numbered per kind.

A packet is kept as entry rows plus a header row. Entries of a section may be
many (all relationships of a much-linked entity), so they are never gathered into
one value; the hash of a packet is a sum over entry hashes, which combines on the
map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import ordered

ENTITY_KINDS = ["named_organization", "potential_beneficiary_class", "named_geography"]
ENTRY = ["bill_id", "version_id", "section_id", "prefix", "kind", "summary", "evidence", "source_url", "metadata"]
SORT = ["_o1", "_o2", "_o3"]


def noteworthy_sections(
    sections: DataFrame,
    findings: DataFrame,
    outliers: DataFrame,
    events: DataFrame,
    links: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """Latest sections with a finding, an outlier, a later change or a named entity.

    `limit` keeps the first sections of each bill by id.
    """
    later = events.filter(
        "from_version_id IS NOT NULL AND event_type IN ('introduced', 'modified')"
    ).select("version_id", "section_number")
    changed = sections.join(later, ["version_id", "section_number"], "left_semi").select("section_id")
    named = [t.select("section_id") for t in (findings, outliers, links.filter("section_id IS NOT NULL"))]
    wanted = changed
    for part in named:
        wanted = wanted.unionByName(part)
    kept = sections.join(wanted.distinct(), "section_id", "left_semi")
    if limit:
        kept = ordered.first_rows(kept, ["bill_id"], [F.col("section_id")], limit)
    return kept


def _entry(df: DataFrame, prefix: str, kind, summary: Column, evidence: Column, url: Column,
           metadata: dict[str, Column], order: list[Column], kept: list[str] = ()) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    rank = (order + [F.lit(""), F.lit("")])[:3]
    return df.select(
        "bill_id", "version_id", "section_id", F.lit(prefix).alias("prefix"),
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        summary.alias("summary"), evidence.alias("evidence"), url.alias("source_url"),
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metadata"),
        rank[0].cast("double").alias("_o1"), rank[1].cast("string").alias("_o2"),
        rank[2].cast("string").alias("_o3"), *kept,
    )


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 20, "0")


def section_entries(sections: DataFrame, versions: DataFrame) -> DataFrame:
    rows = sections.join(versions.select("version_id", "version_code", "source_url"), "version_id")
    return _entry(
        rows, "S", "section_text",
        F.concat(F.lit("Latest text for section "), "section_number", F.lit(".")),
        F.col("section_text"), F.col("source_url"),
        {"section_number": F.col("section_number"), "heading": F.col("heading"), "version_code": F.col("version_code")},
        [F.lit(0)],
    )


def finding_entries(sections: DataFrame, findings: DataFrame, versions: DataFrame) -> DataFrame:
    rows = _at(sections, findings).join(versions.select("version_id", "source_url"), "version_id")
    return _entry(
        rows, "D", "deterministic_finding", F.col("label"), F.col("evidence"), F.col("source_url"),
        {"kind": F.col("kind"), "severity": F.col("severity")},
        [-F.col("severity"), _padded(F.col("finding_no"))],
    )


def scope_entries(sections: DataFrame, outliers: DataFrame, versions: DataFrame) -> DataFrame:
    rows = _at(sections, outliers).join(versions.select("version_id", "source_url"), "version_id")
    return _entry(
        rows, "Q", "scope_finding",
        F.lit("Section subject matter is distant from the bill's scope and its neighbours."),
        F.concat(F.lit("Divergent terms: "), "divergent_terms", F.lit(".")), F.col("source_url"),
        {c: F.col(c) for c in ("category", "confidence", "anchor_similarity", "peer_similarity", "peer_cutoff")},
        [F.lit(0), F.col("category"), F.format_string("%.9f", 1 - F.col("confidence"))],
    )


def _at(sections: DataFrame, rows: DataFrame) -> DataFrame:
    held = [c for c in rows.columns if c not in ("bill_id", "version_id", "section_number", "heading")]
    return sections.select("bill_id", "version_id", "section_id").join(rows.select(*held), "section_id")


def lineage_entries(sections: DataFrame, events: DataFrame, places: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Events of a section's number in any version, in version order.

    `places` numbers the versions of each bill. Events bring their text as
    `detail`, or `texts` (version_id, section_number, section_text) holds it: then
    the entries are numbered first, and the text of the version that holds an
    event is joined to numbered entries, so that it travels once.
    """
    seen = events.join(
        places.select(F.col("version_id"), "place", "version_code", "source_url"), "version_id"
    ).withColumnRenamed("version_id", "to_version_id")
    rows = sections.select("bill_id", "version_id", "section_id", "section_number").join(
        seen, ["bill_id", "section_number"]
    )
    if texts is not None:
        holder = F.when(F.col("event_type") == "removed", F.col("from_version_id")).otherwise(F.col("to_version_id"))
        held = texts.select(F.col("version_id").alias("_holder"), "section_number", F.col("section_text").alias("detail"))
        numbered_rows = ordered.positions(rows, ["section_id"], [F.col("place").cast("double"), F.col("event_type")], "_no")
        rows = numbered_rows.withColumn("_holder", holder).join(held, ["_holder", "section_number"], "left")
    entries = _entry(
        rows, "L", "provision_lineage",
        F.concat(F.lit("Section "), "section_number", F.lit(" was "), "event_type", F.lit(" in version "), "version_code", F.lit(".")),
        F.coalesce("detail", F.lit("")), F.col("source_url"),
        {"event_type": F.col("event_type"), "from_version_id": F.col("from_version_id"), "to_version_id": F.col("to_version_id")},
        [F.col("place"), F.col("event_type")],
        kept=["_no"] if texts is not None else [],
    )
    return entries if texts is None else _identified(entries.withColumnRenamed("_no", "place"))


def amendment_entries(sections: DataFrame, attributions: DataFrame, amendments: DataFrame) -> DataFrame:
    """Candidate amendments of the events of a section's number, event by event, the likeliest first.

    attributions: bill_id, section_number, amendment_id, confidence, basis,
    token_overlap, and place, the number of the event's version, where known.
    """
    place = F.col("place") if "place" in attributions.columns else F.lit(0)
    rows = sections.select("bill_id", "version_id", "section_id", "section_number").join(
        attributions.withColumn("_at", place), ["bill_id", "section_number"]
    ).join(amendments.select("amendment_id", "amendment_type", "amendment_number", "source_url"), "amendment_id")
    doubt = F.round((1 - F.col("confidence")) * 1e9).cast("long")
    return _entry(
        rows, "A", "candidate_amendment",
        F.concat(F.lit("Candidate amendment association: "), F.upper("amendment_type"), F.lit(" "), "amendment_number", F.lit(".")),
        F.col("basis"), F.col("source_url"),
        {"basis": F.col("basis"), "confidence": F.col("confidence"), "token_overlap": F.col("token_overlap")},
        [F.col("_at"), _padded(doubt), _padded(F.col("amendment_id"))],
    )


def entity_entries(sections: DataFrame, links: DataFrame, urls: DataFrame) -> DataFrame:
    rows = _at(sections, links).join(urls.select("version_id", "source_url"), "version_id")
    return _entry(
        rows, "E", F.col("link_type"),
        F.concat("name", F.lit(" is linked to this section as "), F.replace("link_type", F.lit("_"), F.lit(" ")), F.lit(".")),
        F.col("evidence"), F.col("source_url"),
        {"entity_type": F.col("entity_type"), "confidence": F.col("confidence")},
        [F.lit(0), F.concat_ws("|", "link_type", "normalized_name"), F.col("evidence")],
    )


def correlation_entries(sections: DataFrame, links: DataFrame, correlations: DataFrame) -> DataFrame:
    """correlations: normalized_name of the linked entity, matched_id, matched_name, match_basis, evidence."""
    linked = _at(sections, links).select("bill_id", "version_id", "section_id", "normalized_name", "name")
    rows = linked.join(correlations.select("normalized_name", "matched_id", "matched_name", "match_basis",
                                           F.col("evidence"), "confidence"), "normalized_name")
    return _entry(
        rows, "C", "external_correlation",
        F.concat("name", F.lit(" correlates with external evidence for "), "matched_name", F.lit(".")),
        F.col("evidence"), F.lit(None).cast("string"),
        {"match_basis": F.col("match_basis"), "confidence": F.col("confidence")},
        [F.lit(0), F.concat_ws("|", "match_basis", "normalized_name", "matched_name"), F.col("evidence")],
    )


def relationship_entries(
    sections: DataFrame, links: DataFrame, correlations: DataFrame, relationships: DataFrame
) -> DataFrame:
    """relationships: entity_id, relationship_id, relation_type, source_system, source_url, observed_on."""
    linked = _at(sections, links).select("bill_id", "version_id", "section_id", "normalized_name").distinct()
    matched = linked.join(correlations.select("normalized_name", F.col("matched_id").alias("entity_id")), "normalized_name")
    rows = matched.join(relationships, "entity_id")
    return _entry(
        rows, "X", "external_relationship",
        F.concat(F.lit("External source records relationship type "), "relation_type", F.lit(".")),
        F.col("relation_type"), F.col("source_url"),
        {"source_system": F.col("source_system"), "observed_on": F.col("observed_on")},
        [F.lit(0), F.concat_ws("|", "normalized_name", "source_system", "relation_type", "observed_on"), F.concat_ws("|", F.coalesce("source_url", F.lit("")), _padded(F.col("relationship_id")))],
    )


def fiscal_context(findings: DataFrame, top: int | None = 20) -> DataFrame:
    """The `top` fiscal findings of each bill, the surest first, then by hash; all of them with None.

    A packet shows that many, whatever the bill has.
    """
    rows = findings.select("bill_id", "document_id", "category", "confidence", "statement", "evidence", "source_kind", "evidence_hash")
    if top is None:
        return rows
    return ordered.first_rows(rows, ["bill_id"], [F.col("confidence").desc(), F.col("evidence_hash")], top)


def fiscal_entries(sections: DataFrame, findings: DataFrame, documents: DataFrame, top: int | None = 20) -> DataFrame:
    """The `top` fiscal findings of a bill, shown with each of its sections."""
    best = fiscal_context(findings, top).join(documents.select("document_id", "source_url"), "document_id", "left")
    rows = sections.select("bill_id", "version_id", "section_id").join(best, "bill_id")
    return _entry(
        rows, "F", "bill_level_fiscal_context", F.col("statement"), F.col("evidence"), F.col("source_url"),
        {"category": F.col("category"), "confidence": F.col("confidence"), "source_kind": F.col("source_kind"),
         "scope": F.lit("bill_level_context_not_attributed_to_section")},
        [-F.col("confidence"), F.col("evidence_hash")],
    )


def _identified(placed: DataFrame) -> DataFrame:
    return placed.withColumn("evidence_id", F.concat("prefix", F.col("place").cast("string"))).drop(*SORT)


def numbered(branches: list[DataFrame], placed: list[DataFrame] = ()) -> DataFrame:
    """All entries with their evidence id: prefix and place within section and prefix.

    `placed` branches have theirs already; no other branch shares their prefix.
    """
    union = branches[0]
    for branch in branches[1:]:
        union = union.unionByName(branch)
    entries = _identified(ordered.positions(union, ["section_id", "prefix"], SORT, "place"))
    for branch in placed:
        entries = entries.unionByName(branch)
    return entries


def _entry_hash() -> Column:
    """Content of an entry without ids, with sorted metadata."""
    stable = F.map_filter("metadata", lambda k, v: ~k.endswith("_id") & ~k.endswith("_ids") & (k != "id"))
    fields = F.struct(
        F.col("evidence"),
        F.col("evidence_id").alias("evidence_number"),
        F.col("kind"),
        F.array_sort(F.map_entries(stable)).alias("metadata"),
        F.col("source_url"),
        F.col("summary"),
    )
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def _parts(digest: Column) -> list[Column]:
    """Four numbers of fifteen hexadecimal digits each."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


#: What a packet says of its bill, version and section; ids are no content.
HEAD = ["jurisdiction", "session_code", "bill_type", "bill_number", "title", "version_code", "issued_on", "version_url", "section_number", "heading"]


def heads(sections: DataFrame, versions: DataFrame, bills: DataFrame) -> DataFrame:
    """(section_id, head): the bill, version and section of a packet as one hash."""
    named = sections.select("section_id", "bill_id", "version_id", "section_number", "heading")
    rows = named.join(versions.select("version_id", "version_code", "issued_on", F.col("source_url").alias("version_url")), "version_id")
    rows = rows.join(bills.select("bill_id", "jurisdiction", "session_code", "bill_type", "bill_number", "title"), "bill_id")
    content = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(HEAD)]), {"ignoreNullFields": "false"})
    return rows.select("section_id", F.sha2(content, 256).alias("head"))


def headers(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per packet: hash, triggers, coverage and gaps.

    The hash covers the entries and, where `known` (`heads`) is given, the bill,
    version and section.
    """
    digest = entries.withColumn("_digest", _entry_hash())
    for i, part in enumerate(_parts(F.col("_digest"))):
        digest = digest.withColumn(f"_p{i}", part)
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    kind = F.col("kind")
    no_url = F.coalesce("source_url", F.lit("")) == ""
    trigger = (
        F.when(kind == "scope_finding", F.coalesce(meta("category"), F.lit("scope_outlier")))
        .when(kind == "provision_lineage", F.concat(F.lit("lineage_"), meta("event_type")))
        .when(kind.isin("candidate_amendment", "external_correlation", "external_relationship", *ENTITY_KINDS), kind)
        .when(kind == "bill_level_fiscal_context", F.coalesce(F.concat(F.lit("fiscal_"), meta("category")), F.lit("fiscal_context")))
        .when(kind == "deterministic_finding", F.coalesce(F.concat(F.lit("bill_text_"), meta("kind")), F.lit("bill_text_signal")))
    )
    gap = (
        F.when((kind == "candidate_amendment") & no_url, "candidate_amendment_source_url")
        .when((kind == "external_relationship") & no_url, "external_relationship_source_url")
        .when(kind.isin(ENTITY_KINDS) & no_url, "section_entity_source_url")
        .when((kind == "bill_level_fiscal_context") & no_url, "fiscal_context_source_url")
    )
    has = lambda *kinds: F.bool_or(kind.isin(*kinds))
    sourced_section = F.bool_or((kind == "section_text") & ~no_url)
    grouped = digest.groupBy("bill_id", "version_id", "section_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(~no_url).alias("source_backed_entry_count"),
        has("section_text").alias("has_section_text"),
        has("deterministic_finding").alias("has_deterministic_findings"),
        has("scope_finding").alias("has_scope_analysis"),
        has("provision_lineage").alias("has_lineage"),
        has("candidate_amendment").alias("has_candidate_amendment"),
        has(*ENTITY_KINDS).alias("has_entity_context"),
        has("external_correlation", "external_relationship").alias("has_external_context"),
        has("bill_level_fiscal_context").alias("has_fiscal_context"),
        # Trigger and gap names are a short fixed list, so these sets stay small.
        F.array_sort(F.collect_set(trigger)).alias("trigger_types"),
        F.collect_set(gap).alias("_gaps"),
        sourced_section.alias("_sourced"),
        *[F.sum(f"_p{i}").alias(f"_s{i}") for i in range(4)],
    )
    gaps = F.when(F.col("_sourced"), F.col("_gaps")).otherwise(
        F.array_append("_gaps", F.lit("section_source_url"))
    )
    parts = [F.col(f"_s{i}").cast("string") for i in range(4)]
    if known is not None:
        grouped = grouped.join(known, "section_id")
        parts.append(F.col("head"))
    sums = F.concat_ws(":", "entry_count", *parts)
    return (
        grouped.withColumn("unresolved_gaps", F.array_sort(gaps))
        .withColumn("packet_hash", F.sha2(sums, 256))
        .drop("_gaps", "_sourced", "head", *[f"_s{i}" for i in range(4)])
    )


PACKET_KEY = ["bill_id", "version_id", "section_id", "packet_hash"]


def new_packets(stored: DataFrame, built: DataFrame) -> DataFrame:
    """Built packets whose hash is not stored for their section."""
    return built.join(stored.select(*PACKET_KEY), PACKET_KEY, "left_anti")


def latest_packets(packets: DataFrame) -> DataFrame:
    """The newest packet of each section."""
    rest = [c for c in packets.columns if c not in ("bill_id", "section_id")]
    return packets.groupBy("bill_id", "section_id").agg(
        F.max_by(F.struct(*rest), "packet_id").alias("_p")
    ).select("bill_id", "section_id", "_p.*")
