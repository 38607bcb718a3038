"""Ordered classifications and routine filters, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import rules as R
from ledgerline.functions import text as T


def any_of(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """True if a pattern matches; `low`, the searchable text, rules most texts out."""
    hit = text.rlike(T.flagged("(?:" + "|".join(patterns) + ")"))
    words = [T.needed(p) for p in patterns]
    return hit if low is None or None in words else T.holds(low, words) & hit


def document_type(title: Column, url: Column) -> Column:
    """Type named by the first known token in title and address."""
    value = T.folded(F.concat_ws(" ", title, url))
    chain = F
    for token, label in R.DOCUMENT_TYPES:
        chain = chain.when(F.contains(value, F.lit(token)), label)
    return chain.otherwise("web_record")


def bill_topic(title: Column, latest_action: Column) -> Column:
    text = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(latest_action, F.lit("")))

    def topic(low: Column) -> Column:
        chain = F
        for name, patterns in R.TOPICS.items():
            chain = chain.when(any_of(text, patterns, low), name)
        return chain.otherwise("other_legislation")

    return T.let(T.searchable(text), topic)


def action_status(text: Column) -> Column:
    value = T.folded(F.coalesce(text, F.lit("")))
    chain = F
    for words, status in R.ACTION_STATUS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(value, F.lit(word))
        chain = chain.when(hit, status)
    return chain.otherwise("legislative action")


def category_label(category: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in R.CATEGORY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, category), F.initcap(F.replace(category, F.lit("_"), F.lit(" "))))


def civic_category(found: Column, item_text: Column | None, doc_type: Column) -> Column:
    """The category of highest priority among findings and the item's own wording."""

    def category(low: Column) -> Column:
        chain = F
        for name in R.CIVIC_PRIORITY:
            hit = F.array_contains(found, name)
            if item_text is not None:
                hit = hit | any_of(item_text, R.CIVIC_SIGNALS[name], low)
            chain = chain.when(hit, name)
        for kind, name in R.CIVIC_TYPE_FALLBACK.items():
            chain = chain.when(doc_type == kind, name)
        return chain.otherwise("other_civic")

    return T.let(F.lit("") if item_text is None else T.searchable(item_text), category)


def substantive(category: Column) -> Column:
    return ~category.isin(R.NOT_SUBSTANTIVE)


def routine_subject(subject: Column) -> Column:
    """True for the heading words of meeting procedure."""
    procedure = subject.rlike(R.ROUTINE_AGENDA) | subject.rlike(R.ROUTINE_MINUTES)
    return procedure & ~subject.rlike(R.SUBSTANTIVE_HINT)


def contact_subject(subject: Column, body_words: Column) -> Column:
    """True for the heading words of contact details."""
    return subject.rlike(R.CONTACT_HEADING) | (
        F.contains(body_words, F.lit(R.CONTACT_BODY)) & subject.isin(R.CONTACT_SUBJECTS)
    )


def routine_action(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(R.ROUTINE_BILL_ACTION)


def meeting_status(doc_type: Column, action: Column, hearing: Column, otherwise: Column) -> Column:
    acted = F.when(doc_type == "minutes", "official action recorded").otherwise("proposed action")
    return F.when(action, acted).when(hearing, "public hearing").otherwise(otherwise)


# Federal bill types, their short form and the word in public addresses.
FEDERAL_TYPES = {
    "HR": ("hr", "house-bill"),
    "S": ("s", "senate-bill"),
    "HJRES": ("hjres", "house-joint-resolution"),
    "SJRES": ("sjres", "senate-joint-resolution"),
    "HCONRES": ("hconres", "house-concurrent-resolution"),
    "SCONRES": ("sconres", "senate-concurrent-resolution"),
    "HRES": ("hres", "house-resolution"),
    "SRES": ("sres", "senate-resolution"),
}


def federal_type(raw: Column) -> Column:
    """Short bill type; NULL for types that are not followed."""
    known = F.create_map(*[F.lit(x) for k, v in FEDERAL_TYPES.items() for x in (k, v[0])])
    return F.try_element_at(known, F.upper(F.coalesce(raw, F.lit(""))))


def federal_url(congress: Column, bill_type: Column, number: Column) -> Column:
    words = F.create_map(*[F.lit(x) for v in FEDERAL_TYPES.values() for x in v])
    return F.concat(
        F.lit("https://www.congress.gov/bill/"), congress.cast("string"), F.lit("th-congress/"),
        F.try_element_at(words, bill_type), F.lit("/"), number.cast("string"),
    )


def session_parts(session: Column) -> Column:
    """Session code, legislature number and label of "89", "89R", "89S2" or "892"."""
    value = F.upper(T.strip(session))
    number = F.substring(value, 1, 2).try_cast("int")
    rest = F.regexp_extract(value, r"^\d{2}S?(\d+)$", 1)
    regular = value.rlike(r"^\d{2}R?$")
    special = value.rlike(r"^\d{2}S\d+$") | value.rlike(r"^\d{3,}$")
    year = F.substring(value, 1, 2)
    return F.struct(
        F.when(regular, F.concat(year, F.lit("R"))).when(special, F.concat(year, rest)).alias("code"),
        F.when(regular | special, number).alias("number"),
        F.when(regular, F.concat(year, F.lit("R")))
        .when(special, F.concat(year, F.lit("S"), rest))
        .alias("label"),
        F.when(~(regular | special), "session must look like 89R, 892, or 89S2").alias("error"),
    )


def watch_problem(rule: dict[str, Column]) -> Column:
    """Why a watch rule is not valid; NULL if it is."""
    kind, place = rule["target_type"], F.upper(rule["jurisdiction"])
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    no_congress = F.coalesce(rule["congress"], F.lit(0)) == 0
    return (
        F.when(~kind.isin("bill", "congress", "session"), "target_type must be bill, congress, or session")
        .when((kind == "congress") & (place != "US"), "congress watches apply to US federal legislation")
        .when((kind == "session") & (place == "US"), "US federal monitoring uses congress watches")
        .when(
            (kind == "bill") & (no_congress | blank(rule["bill_type"]) | blank(rule["bill_number"])),
            "bill watches require congress, bill_type, and bill_number",
        )
        .when((kind == "congress") & no_congress, "congress watches require congress")
        .when(
            (kind == "session") & (no_congress | blank(rule["session"])),
            "session watches require congress/session number and session",
        )
    )
