"""Rule scans: every rule of a pack over every text, in one pass over the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import rules as R
from ledgerline.functions import text as T


HITS = "array<struct<kind:string,severity:double,label:string,evidence:string,detail:string>>"


def _hit(kind: str, weight: float, label: str, evidence: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(weight).alias("severity"),
        F.lit(label).alias("label"),
        evidence.alias("evidence"),
        detail.alias("detail"),
    )


def _first_hits(text: Column, pack: list[R.Rule], before: int, after: int) -> Column:
    """One finding per rule that matches, with the text around its first match."""

    def sought(rule: R.Rule, low: Column) -> Column:
        pattern = T.flagged(rule.pattern, rule.flags)
        if rule.opens:
            return T.first_opened(text, low, pattern, rule.needs)
        return F.when(T.holds(low, rule.needs), T.first_match(text, pattern))

    def scanned(low: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(rule.kind).alias("kind"),
                    F.lit(rule.weight).alias("severity"),
                    F.lit(rule.label).alias("label"),
                    sought(rule, low).alias("match"),
                )
                for rule in pack
            ]
        )

    tried = T.let(T.searchable(text), scanned)
    return F.transform(
        F.filter(tried, lambda one: one["match"].isNotNull()),
        lambda one: F.struct(
            one["kind"].alias("kind"),
            one["severity"].alias("severity"),
            one["label"].alias("label"),
            T.excerpt(text, one["match"]["start"], one["match"]["end"], before, after).alias(
                "evidence"
            ),
            T.matched_text(text, one["match"]).alias("detail"),
        ),
    )


def first_match_findings(
    texts: DataFrame,
    keys: list[str],
    text: str,
    pack: list[R.Rule],
    before: int = 180,
    after: int = 260,
) -> DataFrame:
    """Long findings of a rule pack; the pack is any list of rules."""
    hits = _first_hits(F.col(text), pack, before, after)
    return T.rows(texts, keys, hits, "hit").select(*keys, "hit.*")


def section_findings(sections: DataFrame, keys: list[str], text: str = "section_text") -> DataFrame:
    """Findings of the section rules, every money mention and dense references."""
    body = F.col(text)
    money = F.transform(
        T.all_matches(body, T.BILL_MONEY),
        lambda m: _hit(
            R.MONEY_RULE.kind,
            R.MONEY_RULE.weight,
            R.MONEY_RULE.label,
            T.excerpt(body, m["start"], m["end"], 140, 180),
            F.regexp_replace(m["text"], r"[,\s]+$", ""),
        ),
    )
    # Two references hold two of the words, or one twice.
    references = F.array_distinct(
        F.when(
            T.let(T.searchable(body), lambda low: T.holds_two(low, R.REFERENCE_RULE.needs)),
            F.regexp_extract_all(body, F.lit(T.flagged(R.REFERENCE_RULE.pattern)), F.lit(0)),
        )
    )
    none = F.array().cast(HITS)
    dense = T.let(
        references,
        lambda found: F.when(
            F.size(found) >= 2,
            F.array(
                _hit(
                    R.REFERENCE_RULE.kind,
                    R.REFERENCE_RULE.weight,
                    R.REFERENCE_RULE.label,
                    F.array_join(found, "; "),
                    F.array_join(found, "; "),
                )
            ),
        ).otherwise(none),
    )
    hits = F.concat(_first_hits(body, R.SECTION_RULES, 180, 260), money, dense)
    return T.rows(sections, keys, hits, "hit", "finding_no").select(*keys, "finding_no", "hit.*")


def match_excerpts(
    texts: DataFrame,
    keys: list[str],
    text: str,
    pattern: str,
    before: int,
    after: int,
    limit: int | None = None,
) -> DataFrame:
    """One row per match of a pattern with its offsets and surroundings."""
    body = F.col(text)
    found = T.all_matches(body, pattern, limit)
    return T.rows(texts, [*keys, text], found, "m", "match_no").select(
        *keys,
        "match_no",
        F.col("m.start").alias("start"),
        F.col("m.text").alias("matched"),
        T.excerpt(body, F.col("m.start"), F.col("m.end"), before, after).alias("evidence"),
    )


def counts_by(findings: DataFrame, keys: list[str], column: str = "kind") -> DataFrame:
    """How many findings of each kind a key has."""
    return findings.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("findings"))


def findings_in_context(findings: DataFrame, sections: DataFrame, versions: DataFrame) -> DataFrame:
    """Findings with their section and version."""
    where = sections.select("version_id", "ordinal", "section_number", "heading")
    return findings.join(where, ["version_id", "ordinal"]).join(
        versions.select("version_id", "bill_id", "version_code"), "version_id"
    )


def cited(findings: DataFrame, narrative: str, available: str) -> DataFrame:
    """Citations of a narrative checked against the ids it may use."""
    used = F.array_sort(
        F.array_distinct(
            F.regexp_extract_all(F.coalesce(narrative, F.lit("")), F.lit(R.CITATION), F.lit(1))
        )
    )
    audited = findings.withColumn("used_ids", used).withColumn(
        "invalid_ids", F.array_except("used_ids", available)
    )
    status = (
        F.when(F.col(narrative).isNull(), "not_generated")
        .when((F.size("invalid_ids") > 0) | (F.size("used_ids") == 0), "rejected")
        .otherwise("complete")
    )
    return audited.withColumn("has_citations", F.size("used_ids") > 0).withColumn(
        "narrative_status", status
    )
