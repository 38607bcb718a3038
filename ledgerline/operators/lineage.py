"""How provisions move from one bill version to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import session
from ledgerline.functions import diff as D
from ledgerline.functions import text as T
from ledgerline.operators import alike, ordered, sections as S

RENUMBERED_RATIO = 0.90


def version_order(versions: DataFrame) -> DataFrame:
    """Versions with their sort day: dated by date, undated last."""
    day = F.coalesce(T.iso_date(F.col("issued_on")), F.lit("9999-12-31").cast("date"))
    return versions.withColumn("sort_day", day)


def version_pairs(versions: DataFrame) -> DataFrame:
    """Each version with the one before it. No text is read."""
    lean = version_order(versions.select("bill_id", "version_id", "version_code", "issued_on"))
    return ordered.previous(
        lean,
        ["bill_id"],
        ["sort_day", "version_id"],
        {
            "from_version_id": "version_id",
            "from_version_code": "version_code",
            "from_issued_on": "issued_on",
        },
    )


def section_changes(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sections introduced, removed, modified and unchanged between consecutive versions.

    Only section numbers and text hashes are joined. A full outer join would tie
    both sides to one shuffle each; grouping the two sides by number does the same
    with one.
    """
    numbered = S.latest_duplicates(
        sections.select(
            "version_id",
            "section_number",
            "ordinal",
            F.unhex(F.sha2("section_text", 256)).alias("sha"),
        ),
        ["version_id", "section_number"],
    ).select("version_id", "section_number", "sha")
    head = pairs.select("bill_id", "version_id", "from_version_id")
    new = numbered.join(head, "version_id").select(
        "bill_id", "version_id", "from_version_id", "section_number",
        F.lit(None).cast("binary").alias("old_sha"), F.col("sha").alias("new_sha"),
    )
    earlier = head.filter(F.col("from_version_id").isNotNull())
    old = numbered.withColumnRenamed("version_id", "from_version_id").join(
        earlier, "from_version_id"
    ).select(
        "bill_id", "version_id", "from_version_id", "section_number",
        F.col("sha").alias("old_sha"), F.lit(None).cast("binary").alias("new_sha"),
    )
    both = (
        old.unionByName(new)
        .groupBy("bill_id", "version_id", "from_version_id", "section_number")
        .agg(F.max("old_sha").alias("old_sha"), F.max("new_sha").alias("new_sha"))
    )
    kind = (
        F.when(F.col("old_sha").isNull(), "introduced")
        .when(F.col("new_sha").isNull(), "removed")
        .when(F.col("old_sha") != F.col("new_sha"), "modified")
        .otherwise("unchanged")
    )
    text = lambda sha: F.lower(F.hex(sha))
    return both.withColumn("event_type", kind).withColumns({"old_sha": text("old_sha"), "new_sha": text("new_sha")})


def renumbered(changes: DataFrame, sections: DataFrame) -> DataFrame:
    """Vanished sections found again under a new number.

    Only distinct texts of version pairs that lost and gained sections are
    compared; the greedy choice sees numbers, hashes and ratios. Each side is sent
    once, to its version pair; hashes are made where they are needed.
    """
    moved = changes.filter(F.col("event_type").isin("removed", "introduced") & F.col("from_version_id").isNotNull())
    two_sided = (
        moved.groupBy("bill_id", "version_id")
        .agg(F.count_distinct("event_type").alias("kinds"))
        .filter("kinds = 2")
        .drop("kinds")
    )
    pair = ["bill_id", "version_id"]
    side = F.when(F.col("event_type") == "removed", F.col("from_version_id")).otherwise(F.col("version_id"))
    rows = session.checkpointed(
        moved.join(two_sided, pair, "left_semi")
        .withColumn("holder", side)
        .join(_texts(sections).withColumnRenamed("version_id", "holder"), ["holder", "section_number"])
        .select(*pair, "event_type", F.col("section_number").alias("number"), F.col("section_text").alias("text"))
    )
    hashed = lambda df: df.withColumn("sha", F.unhex(F.sha2("text", 256)))
    sides = [rows.filter(F.col("event_type") == event).drop("event_type") for event in ("removed", "introduced")]
    old, new = (hashed(df) for df in sides)
    texts = [hashed(df.select(*pair, "text").repartition(*pair)).groupBy(*pair, "sha").agg(F.first("text").alias("text")) for df in sides]
    pairs = alike.alike_pairs(*texts, pair, RENUMBERED_RATIO)
    return alike.first_choices(old.drop("text"), new.drop("text"), pairs, pair)


def _texts(sections: DataFrame) -> DataFrame:
    return S.latest_duplicates(
        sections.select("version_id", "section_number", "ordinal", "section_text"),
        ["version_id", "section_number"],
    ).select("version_id", "section_number", "section_text")


def lineage_events(
    sections: DataFrame, versions: DataFrame, with_text: bool = True
) -> DataFrame:
    """All provision events; texts, similarity and diff are attached last."""
    pairs = version_pairs(versions)
    # Read three times; its hashes are not needed any more.
    changes = session.checkpointed(section_changes(sections, pairs).filter("event_type <> 'unchanged'").drop("old_sha", "new_sha"))
    moves = renumbered(changes, sections)
    old_side = moves.select("bill_id", "version_id", F.col("old_number").alias("section_number"), F.lit("removed").alias("event_type"))
    new_side = moves.select("bill_id", "version_id", F.col("new_number").alias("section_number"), F.lit("introduced").alias("event_type"))
    kept = changes.join(
        old_side.unionByName(new_side),
        ["bill_id", "version_id", "section_number", "event_type"],
        "left_anti",
    ).select(
        "bill_id", "version_id", "from_version_id", "section_number", "event_type",
        F.col("section_number").alias("old_number"),
    )
    head = pairs.select("bill_id", "version_id", "version_code", "from_version_id", "from_version_code")
    moved = moves.join(head, ["bill_id", "version_id"]).select(
        "bill_id", "version_id", "from_version_id",
        F.col("new_number").alias("section_number"), F.lit("renumbered").alias("event_type"),
        "old_number",
    )
    events = kept.unionByName(moved)
    if not with_text:
        return events
    texts = _texts(sections)
    old_texts = texts.select(
        F.col("version_id").alias("from_version_id"),
        F.col("section_number").alias("old_number"),
        F.col("section_text").alias("old_text"),
    )
    new_texts = texts.withColumnRenamed("section_text", "new_text")
    full = (
        events.join(old_texts, ["from_version_id", "old_number"], "left")
        .join(new_texts, ["version_id", "section_number"], "left")
        .join(head.drop("from_version_id"), ["bill_id", "version_id"])
    )
    compared = F.col("event_type").isin("modified", "renumbered")
    name = lambda code, number: F.concat(code, F.lit(":section-"), number)
    changed = session.spread(full.filter(compared), "bill_id", "version_id", "section_number").withColumns(
        {
            "similarity": F.round(D.similarity("old_text", "new_text"), 4),
            "diff": F.when(
                F.col("old_text") != F.col("new_text"),
                D.unified_diff(
                    "old_text",
                    "new_text",
                    name("from_version_code", "old_number"),
                    name("version_code", "section_number"),
                ),
            ),
        }
    )
    plain = full.filter(~compared).withColumns(
        {"similarity": F.lit(None).cast("double"), "diff": F.lit(None).cast("string")}
    )
    return changed.unionByName(plain)


def amendment_date(raw: Column) -> Column:
    """Date of an amendment: its latest action, else three fallbacks."""
    paths = ["$.latestAction.actionDate", "$.submittedDate", "$.proposedDate", "$.date"]
    found = F.coalesce(*[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths])
    return T.iso_date(found)


def amendment_people(raw: Column) -> Column:
    """Names of sponsors, first come first, each once."""
    person = "struct<fullName:string,name:string,bioguideId:string>"
    listed = F.from_json(F.get_json_object(raw, "$.sponsors"), f"array<{person}>")
    single = F.from_json(F.get_json_object(raw, "$.sponsor"), person)
    everyone = F.concat(
        F.coalesce(listed, F.array().cast(f"array<{person}>")),
        F.when(single.isNotNull(), F.array(single)).otherwise(F.array().cast(f"array<{person}>")),
    )
    blank = lambda c: F.nullif(c, F.lit(""))
    names = F.transform(
        everyone,
        lambda p: F.coalesce(blank(p["fullName"]), blank(p["name"]), blank(p["bioguideId"])),
    )
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull()))


def amendment_text(description: Column, latest_action: Column, raw: Column) -> Column:
    parts = [
        description,
        latest_action,
        F.get_json_object(raw, "$.purpose"),
        F.get_json_object(raw, "$.description"),
    ]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


#: Pairs of events and amendments of one bill that one task compares.
PAIRS_PER_TASK = 50_000_000


def _repeated(rows: DataFrame, key: str) -> DataFrame | None:
    """Ids that several rows hold, None where there are none."""
    many = session.checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    return None if many.isEmpty() else many


def _crowded(left: DataFrame, right: DataFrame, pairs_per_task: int) -> DataFrame | None:
    """(bill_id, slices): bills with more pairs than one task compares, None where there are none."""
    events = left.groupBy("bill_id").agg(F.count(F.lit(1)).alias("events"))
    amendments = right.groupBy("bill_id").agg(F.count(F.lit(1)).alias("amendments"))
    pairs = F.col("events") * F.col("amendments")
    many = session.checkpointed(
        events.join(amendments, "bill_id").filter(pairs > pairs_per_task)
        .select("bill_id", F.ceil(pairs / pairs_per_task).cast("int").alias("slices"))
    )
    return None if many.isEmpty() else many


def _overlaps(shared: Column) -> Column:
    """Share of the smaller token set."""
    return shared / F.greatest(F.lit(1), F.least("left_size", "right_size"))


def _temporal() -> Column:
    return F.coalesce(
        (F.col("amendment_day") <= F.col("to_day"))
        & (F.col("from_day").isNull() | (F.col("amendment_day") >= F.col("from_day"))),
        F.lit(False),
    )


def _dated(overlap: Column) -> Column:
    return _temporal() & (overlap >= 0.08)


def _near(scored: DataFrame) -> DataFrame:
    """Pairs that are candidates; the overlap is named once, since a filter works it out as often as it names it."""
    return scored.filter(_overlaps(F.col("shared")) >= F.when(_temporal(), 0.08).otherwise(0.25))


SCORED = ["bill_id", "event_id", "amendment_id", "from_day", "to_day", "amendment_day", "left_size", "right_size"]


def _met_by_bill(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates among the events and amendments that agree in `keys`, each pair compared where the join makes it.

    The pairs are in the partition of their keys, so nothing but the token sets
    is shuffled.
    """
    sides = left.withColumn("left_words", F.col("words")).drop("words").join(right.withColumn("right_words", F.col("words")).drop("words"), keys)
    shared = F.size(F.array_intersect("left_words", "right_words"))
    return _near(sides.select(*SCORED, shared.alias("shared")))


def _met_by_word(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates among events and amendments whose ids repeat: the tokens of all rows of an id count together."""
    shared = (
        T.rows(left, ["bill_id", "event_id"], F.col("words"), "word")
        .join(T.rows(right, ["bill_id", "amendment_id"], F.col("words"), "word"), ["bill_id", "word"])
        .groupBy("bill_id", "event_id", "amendment_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    scored = shared.join(left.drop("bill_id", "words"), "event_id").join(right.drop("bill_id", "words"), "amendment_id")
    return _near(scored.select(*SCORED, "shared"))


def attribute(
    events: DataFrame, amendments: DataFrame, top: int | None = 10, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Candidate amendments of introduced and modified provisions.

    events: event_id, bill_id, from_day, to_day, new_text.
    amendments: amendment_id, bill_id, amendment_day, search_text.
    `top` candidates of an event are kept, all of them with None. Overlap is the
    share of the smaller token set; tokens are told apart by 64-bit hashes. Token
    sets are written once and travel once, to their bill; the events of a bill with
    more than `pairs_per_task` pairs are dealt out over slices, each with all
    amendments of the bill. Only ids that several rows hold are matched word by word.
    """
    hashed = lambda w: F.transform(w, lambda word: F.xxhash64(word))
    words = lambda text: T.let(T.token_set(F.col(text)), lambda w: F.struct(hashed(w).alias("words"), F.size(w).alias("size")))
    left = session.checkpointed(
        events.filter("bill_id IS NOT NULL AND event_id IS NOT NULL").withColumn("w", words("new_text")).select(
            "bill_id", "event_id", "from_day", "to_day", F.col("w.words").alias("words"), F.col("w.size").alias("left_size")
        )
    )
    right = amendments.filter("bill_id IS NOT NULL AND amendment_id IS NOT NULL").withColumn("w", words("search_text")).select(
        "bill_id", "amendment_id", "amendment_day", F.col("w.words").alias("words"), F.col("w.size").alias("right_size")
    )
    parts = []
    again, twice = _repeated(left, "event_id"), _repeated(right, "amendment_id")
    if again is not None:
        parts.append(_met_by_word(left.join(again, "event_id", "left_semi"), right))
        left = left.join(again, "event_id", "left_anti")
    if twice is not None:
        parts.append(_met_by_word(left, right.join(twice, "amendment_id", "left_semi")))
        right = right.join(twice, "amendment_id", "left_anti")
    crowded = _crowded(left, right, pairs_per_task)
    if crowded is not None:
        dealt = left.join(crowded, "bill_id").withColumn("slice", F.expr("pmod(xxhash64(event_id), slices)").cast("int")).drop("slices")
        copied = right.join(crowded, "bill_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        parts.append(_met_by_bill(dealt, copied, ["bill_id", "slice"]))
        left, right = (side.join(crowded, "bill_id", "left_anti") for side in (left, right))
    scored = _met_by_bill(left, right, ["bill_id"])
    for part in parts:
        scored = scored.unionByName(part)
    overlap = _overlaps(F.col("shared"))
    found = (
        scored.withColumn("overlap", overlap)
        .withColumn("dated", _dated(F.col("overlap")))
        .select(
            "bill_id",
            "event_id",
            "amendment_id",
            F.when(F.col("dated"), F.least(F.lit(0.85), F.col("overlap") + 0.50))
            .otherwise(F.least(F.lit(0.65), F.col("overlap") + 0.35))
            .alias("confidence"),
            F.when(F.col("dated"), "temporal_text_overlap").otherwise("text_overlap_only").alias("basis"),
            F.round("overlap", 4).alias("token_overlap"),
        )
        .withColumn("confidence", F.round("confidence", 9))
    )
    if top is None:
        return found
    return ordered.first_rows(
        found, ["bill_id", "event_id"], [F.col("confidence").desc(), F.col("amendment_id")], top
    )
