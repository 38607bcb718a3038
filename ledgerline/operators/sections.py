"""Splitting texts into sections and agenda items, row by row and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import rules as R
from ledgerline.functions import text as T
from ledgerline.operators import ordered
from ledgerline.session import checkpointed


def split_sections(versions: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: number, heading, text and ordinal.

    A version without a section marker is one ``ROOT`` section. Markers and the
    text between them alternate, so each section is a marker and what follows it.
    """
    body = F.col(text)
    cut = F.struct(
        F.regexp_extract_all(body, F.lit(R.SECTION_MARKER), F.lit(0)).alias("marks"),
        F.split(body, R.SECTION_MARKER, -1).alias("rest"),
    )
    heading = lambda mark: T.strip(F.regexp_extract(mark, R.SECTION_MARKER, 2))

    def sections(cut: Column) -> Column:
        after = F.slice(cut["rest"], F.lit(2), F.size(cut["marks"]))
        return F.transform(
            F.arrays_zip(cut["marks"].alias("mark"), after.alias("rest")),
            lambda pair: F.struct(
                F.regexp_extract(pair["mark"], R.SECTION_MARKER, 1).alias("section_number"),
                F.nullif(heading(pair["mark"]), F.lit("")).alias("heading"),
                T.strip(F.concat(pair["mark"], pair["rest"])).alias("section_text"),
            ),
        )

    root = F.array(
        F.struct(
            F.lit("ROOT").alias("section_number"),
            F.lit(None).cast("string").alias("heading"),
            body.alias("section_text"),
        )
    )
    found = F.when(body.rlike(R.SECTION_MARKER), T.let(cut, sections)).otherwise(root)
    others = [c for c in versions.columns if c != text]
    return T.rows(versions, others, found, "section", "ordinal").select(*others, "ordinal", "section.*")


def section_label(item_number: Column, heading: Column) -> Column:
    """Name of an agenda part: a single letter or roman number before a known heading."""
    number = F.regexp_replace(T.strip(F.coalesce(item_number, F.lit(""))), r"^\.+|\.+$", "")
    title = F.regexp_replace(F.coalesce(heading, F.lit("")), r"^[ .:-]+|[ .:-]+$", "")
    named = T.let(
        T.collapse(title),
        lambda label: F.when(label.rlike(R.CONSENT_AGENDA), F.lit("Consent Agenda")).when(
            label.rlike(R.AGENDA_SECTION), label
        ),
    )
    return F.when(number.rlike(r"(?i)^(?:[A-Z]|[IVXLCDM]+)$"), named)


#: An unnumbered line longer than this is prose, though it begins like an action.
LONGEST_ACTION = 1200


def _opens_item(line: Column, longest_action: int | None) -> Column:
    action = line.rlike(R.AGENDA_ACTION)
    if longest_action is not None:
        action = action & (F.length(line) <= longest_action)
    return line.rlike(R.AGENDA_ITEM) | line.rlike(R.AGENDA_NUMBERED_ACTION) | action


def agenda_items(
    documents: DataFrame,
    keys: list[str],
    text: str = "text",
    max_lines: int | None = None,
    max_items: int | None = None,
    max_heading: int | None = None,
    max_text: int | None = None,
    longest_action: int | None = LONGEST_ACTION,
) -> DataFrame:
    """Agenda items of each document, in order, with the section they stand in.

    The bounds cut an item's lines, a document's items, headings and item texts
    for listings; by default everything is kept. An unnumbered line opens an item
    only up to `longest_action` characters (None: whatever its length).

    An opening line starts an item, a contact line ends it. Both become control
    characters in the line list, so that two splits of the joined lines give the
    items; no row leaves its task.
    """
    opened, closed = "\u0001", "\u0002"
    first = lambda values, most: values if most is None else F.slice(values, 1, most)
    start = lambda value, most: value if most is None else F.substring(value, 1, most)
    body = F.coalesce(F.col(text), F.lit(""))
    # Taking characters out goes through a text one by one.
    held = F.contains(body, F.lit(opened)) | F.contains(body, F.lit(closed))
    clean = F.when(held, F.translate(body, opened + closed, "")).otherwise(body)
    marked = F.transform(
        T.lines(clean),
        lambda line: F.when(line.rlike(R.CONTACT_LINE), F.lit(closed))
        .when(_opens_item(line, longest_action), F.concat(F.lit(opened), line))
        .otherwise(line),
    )
    segments = F.split(F.array_join(marked, "\n"), opened, -1)
    bodies = F.transform(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))),
        lambda part: first(
            F.filter(F.split(F.get(F.split(part, closed, 2), F.lit(0)), "\n"), lambda x: x != ""), max_lines
        ),
    )

    def described(body: Column) -> Column:
        opening = F.get(body, F.lit(0))
        kind = (
            F.when(opening.rlike(R.AGENDA_ITEM), 1)
            .when(opening.rlike(R.AGENDA_NUMBERED_ACTION), 2)
            .otherwise(3)
        )

        def part(head: Column, group: int) -> Column:
            return F.when(
                head["kind"] == 1, F.regexp_extract(head["line"], R.AGENDA_ITEM, group)
            ).when(head["kind"] == 2, F.regexp_extract(head["line"], R.AGENDA_NUMBERED_ACTION, group))

        def named(head: Column) -> Column:
            title = start(F.coalesce(part(head, 2), head["line"]), max_heading)
            return F.struct(part(head, 1).alias("item_number"), title.alias("heading"))

        head = F.struct(opening.alias("line"), kind.alias("kind"))
        return T.let(
            T.let(head, named),
            lambda item: F.struct(
                item["item_number"].alias("item_number"),
                item["heading"].alias("heading"),
                start(F.array_join(body, "\n"), max_text).alias("item_text"),
                section_label(item["item_number"], item["heading"]).alias("label"),
                F.length(F.array_join(body, " ")).alias("size"),
            ),
        )

    kept = first(
        F.filter(
            F.transform(bodies, described),
            lambda item: item["label"].isNotNull() | (item["size"] >= 20),
        ),
        max_items,
    )
    found = documents.select(*keys, kept.alias("items"))
    labels = F.transform("items", lambda item: item["label"])
    upto = lambda i: F.filter(F.slice("labels", F.lit(1), i + 1), lambda x: x.isNotNull())
    with_section = found.withColumn("labels", labels).withColumn(
        "items",
        F.transform(
            "items",
            lambda item, i: F.struct(
                (i + 1).alias("ordinal"),
                item["item_number"].alias("item_number"),
                item["heading"].alias("heading"),
                item["item_text"].alias("item_text"),
                F.element_at(
                    F.when(F.size(upto(i)) > 0, upto(i)), -1
                ).alias("agenda_section"),
                T.sha256(item["item_number"], item["item_text"]).alias("evidence_hash"),
            ),
        ),
    )
    return T.rows(with_section, keys, F.col("items"), "item").select(*keys, "item.*")


def headings_in_text(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Agenda headings of raw text with the section in force, numbered per heading."""
    lines = T.rows(documents, keys, T.lines(F.col(text)), "line", "line_no")
    number = F.regexp_extract("line", R.AGENDA_ITEM, 1)
    heading = F.regexp_extract("line", R.AGENDA_ITEM, 2)
    is_item = F.col("line").rlike(R.AGENDA_ITEM)
    label = F.when(is_item, section_label(number, heading)).otherwise(
        F.when(section_label(F.lit("A"), F.col("line")).isNotNull(), F.col("line"))
    )
    marked = (
        lines.withColumn("label", label)
        .withColumn("subject", T.heading_words(F.when(is_item, heading).otherwise(F.col("line"))))
        .filter(is_item | F.col("label").isNotNull() | F.col("line").rlike(R.AGENDA_ACTION))
    )
    # A few lines of each text: the text itself is read once.
    marked = checkpointed(marked.select(*keys, "line_no", "label", "subject"))
    carried = ordered.carry_forward(marked, keys, ["line_no"], "label", "section")
    return ordered.positions(
        carried.filter(F.col("label").isNull()), [*keys, "subject"], ["line_no"], "occurrence"
    ).select(*keys, "subject", "occurrence", "section")


def recover_sections(
    items: DataFrame, documents: DataFrame, keys: list[str], text: str = "text"
) -> DataFrame:
    """Section of items stored without one: the k-th item of a heading takes the
    section of that heading's k-th occurrence in the raw text, else the section
    before it."""
    subject = T.heading_words(F.col("heading"))
    label = section_label(F.col("item_number"), F.col("heading"))
    named = checkpointed(items.select(*keys, "ordinal", "agenda_section", label.alias("own_label"), subject.alias("subject")))
    bodies = ordered.positions(
        named.filter(F.col("own_label").isNull()), [*keys, "subject"], ["ordinal"], "occurrence"
    )
    found = headings_in_text(documents, keys, text).withColumnRenamed("section", "found")
    anchor = F.coalesce("agenda_section", "found").alias("anchor")
    known = bodies.join(found, [*keys, "subject", "occurrence"], "left").select(*keys, "ordinal", "own_label", anchor)
    heads = named.filter(F.col("own_label").isNotNull()).select(*keys, "ordinal", "own_label", F.col("own_label").alias("anchor"))
    placed = ordered.carry_forward(known.unionByName(heads), keys, ["ordinal"], "anchor", "recovered_section")
    flags = placed.select(*keys, "ordinal", "recovered_section", F.col("own_label").isNotNull().alias("is_header"))
    # Windows move numbers and headings; the items' texts are joined last.
    return items.join(flags, [*keys, "ordinal"]).select(*items.columns, "recovered_section", "is_header")


def latest_duplicates(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Of sections sharing a number within a version the last one counts."""
    rest = [c for c in sections.columns if c not in keys]
    return (
        sections.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "ordinal").alias("_row"))
        .select(*keys, "_row.*")
    )
