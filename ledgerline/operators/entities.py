"""Names found in texts, entity nodes and the links to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import rules as R
from ledgerline.functions import text as T
from ledgerline.operators import history

# Names start with a capital, which is cheaper to see than a word bound.
CAPITAL = "(?=[A-Z])"
MENTIONS = "array<struct<entity_type:string,link_type:string,confidence:double,name:string,start:int,evidence:string>>"
LINK_KEY = ["bill_id", "section_id", "entity_type", "normalized_name", "link_type"]


def _named(text: Column, matches: Column, entity_type: str, link_type: str, confidence: float) -> Column:
    return F.transform(
        matches,
        lambda m: F.struct(
            F.lit(entity_type).alias("entity_type"),
            F.lit(link_type).alias("link_type"),
            F.lit(confidence).alias("confidence"),
            T.strip(m["text"]).alias("name"),
            m["start"].alias("start"),
            T.excerpt(text, m["start"], m["end"], 180, 260).alias("evidence"),
        ),
    )


def section_mentions(sections: DataFrame, keys: list[str], text: str = "section_text") -> DataFrame:
    """Every organisation, geography and beneficiary class a section names."""
    body = F.col(text)
    none = F.array().cast(MENTIONS)

    def classes(low: Column) -> Column:
        return F.concat(
            *[
                _named(body, T.all_opened(body, low, T.flagged(p), words), "beneficiary_class", "potential_beneficiary_class", 0.70)
                for p, words in zip(R.BENEFICIARY_PATTERNS, R.BENEFICIARY_NEEDS, strict=True)
            ]
        )

    found = F.concat(
        F.coalesce(T.let(T.searchable(body), classes), none),
        _named(body, T.all_matches(body, T.flagged(CAPITAL + R.ORGANIZATION_PATTERN, "")), "organization", "named_organization", 0.90),
        _named(body, T.all_matches(body, T.flagged(CAPITAL + R.GEOGRAPHY_PATTERN, "")), "geography", "named_geography", 0.85),
    )
    return (
        T.rows(sections, keys, found, "m")
        .select(*keys, "m.*")
        .withColumn("normalized_name", T.normalize_name(F.col("name")))
    )


def civic_mentions(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Organisations in a local record, each once per document."""
    names = F.array_distinct(
        F.filter(
            F.transform(
                F.regexp_extract_all(
                    F.coalesce(F.col(text), F.lit("")),
                    F.lit(T.flagged(CAPITAL + R.CIVIC_ORGANIZATION_PATTERN, "")),
                    F.lit(1),
                ),
                T.collapse,
            ),
            lambda name: F.length(name) >= 5,
        )
    )
    return T.rows(documents, keys, names, "name", "name_no").withColumn(
        "normalized_name", T.normalize_name(F.col("name"))
    )


def links(mentions: DataFrame) -> DataFrame:
    """One link per bill, section, entity and kind: that of the first mention."""
    return history.first_per_key(mentions, LINK_KEY, ["start", "evidence"])


def sponsor_mentions(sponsors: DataFrame) -> DataFrame:
    """Sponsors as person mentions with their ids."""
    ids = F.when(
        F.coalesce("external_id", F.lit("")) != "",
        F.create_map(F.lit("bioguide"), F.col("external_id")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    fields = [F.lit(x) if i % 2 == 0 else F.col(x) for x in ("party", "state", "district") for i in (0, 1)]
    return sponsors.select(
        "bill_id",
        F.lit(None).cast("long").alias("section_id"),
        F.lit("person").alias("entity_type"),
        F.col("role").alias("link_type"),
        F.lit(1.0).alias("confidence"),
        F.col("full_name").alias("name"),
        F.concat(
            F.lit("Official "), "role", F.lit(" record for "), "full_name", F.lit(".")
        ).alias("evidence"),
        ids.alias("external_ids"),
        F.create_map(*fields).alias("metadata"),
        "seq",
    ).withColumn("normalized_name", T.normalize_name(F.col("name")))


def links_in_context(links: DataFrame, entities: DataFrame, sections: DataFrame) -> DataFrame:
    """Links with their entity, and with their section where they have one."""
    where = sections.select("section_id", "section_number")
    return links.join(
        entities.select("entity_type", "normalized_name", "canonical_name"),
        ["entity_type", "normalized_name"],
    ).join(where, "section_id", "left")
