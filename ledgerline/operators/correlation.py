"""Exact record linkage and walks over the relationship graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.session import checkpointed

# Comparable entity types, the id names that link, and the tiers.
TYPE_GROUPS = {
    "person": "person",
    "organization": "organization",
    "committee": "organization",
    "lobbying_registrant": "organization",
}
ID_KEYS = ["bioguide", "fec_candidate_id", "fec_committee_id", "lda_client_id", "lda_registrant_id"]
TIERS = {"external_id": 1.0, "exact_name": 0.95, "alias": 0.85}
EXTERNAL_SYSTEMS = ["fec", "lda"]


def _group(entity_type: Column) -> Column:
    chain = F
    for name, group in TYPE_GROUPS.items():
        chain = chain.when(entity_type == name, F.lit(group))
    return chain.otherwise(entity_type)


def _ids(entities: DataFrame, side: str) -> DataFrame:
    return (
        entities.select(F.col("entity_id").alias(side), F.explode("external_ids").alias("k", "v"))
        .filter(F.col("k").isin(ID_KEYS) & (F.coalesce("v", F.lit("")) != ""))
    )


def _names(entities: DataFrame, side: str) -> DataFrame:
    """Every name an entity answers to; `own` marks its normalized name."""
    own = F.array(
        F.struct(F.lit(True).alias("own"), F.col("normalized_name").alias("name"))
    )
    others = F.transform(
        F.coalesce("aliases", F.array().cast("array<string>")),
        lambda a: F.struct(F.lit(False).alias("own"), T.normalize_name(a).alias("name")),
    )
    return (
        T.rows(
            entities,
            [F.col("entity_id").alias(side), _group(F.col("entity_type")).alias("type_group")],
            F.array_distinct(F.concat(own, others)), "n",
        )
        .select(side, "type_group", F.col("n.name").alias("name"), F.col("n.own").alias(f"{side}_own"))
        .filter(F.coalesce("name", F.lit("")) != "")
    )


def match_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members of the classes of entities that share an id or a name: one row per class, side and entity.

    kind 'id' with the id's name and value, or 'name' with the type group and the
    name; `own` marks an entity's normalized name; `lefts` and `rights` count the
    members of the class. A name held by n and m entities is n + m rows, not n * m;
    `unfolded` gives the pairs.
    """
    def members(side: str, rows: DataFrame) -> DataFrame:
        ids = _ids(rows, "entity_id").select(F.lit("id").alias("kind"), "k", "v", F.lit(side).alias("side"), "entity_id", F.lit(True).alias("own"))
        names = _names(rows, "entity_id")
        return ids.unionByName(names.select(F.lit("name").alias("kind"), F.col("type_group").alias("k"), F.col("name").alias("v"), F.lit(side).alias("side"), "entity_id", F.col("entity_id_own").alias("own")))

    rows = members("left", left).unionByName(members("right", right))
    rows = rows.groupBy("kind", "k", "v", "side", "entity_id").agg(F.max("own").alias("own"))
    sizes = rows.groupBy("kind", "k", "v").agg(F.count_if(F.col("side") == "left").alias("lefts"), F.count_if(F.col("side") == "right").alias("rights"))
    return rows.join(sizes.filter("lefts > 0 AND rights > 0"), ["kind", "k", "v"])


def class_links(classes: DataFrame) -> DataFrame:
    """(entity_id, kind, links): how many members of the right side a left entity meets in its classes of a kind."""
    mine = classes.filter("side = 'left'")
    return mine.groupBy("entity_id", "kind").agg(F.sum("rights").alias("links"))


#: Classes or bills an entity carries along with it; pairs of an entity with more are grouped instead.
CARRIED = 32
#: Pairs of one class that one task unfolds.
PAIRS_PER_TASK = 50_000_000


def _reason(tier: Column, k: Column, v: Column) -> list[Column]:
    """Basis, confidence and evidence of a tier; `k` and `v` are the id or the name."""
    return [
        F.when(tier == 1, "external_id").when(tier == 2, "exact_name").otherwise("alias").alias("match_basis"),
        F.when(tier == 1, TIERS["external_id"]).when(tier == 2, TIERS["exact_name"]).otherwise(TIERS["alias"]).alias("confidence"),
        F.when(tier == 1, F.concat(F.lit("Both entities share "), k, F.lit("="), v, F.lit(".")))
        .when(tier == 2, F.concat(F.lit("Canonical names normalize to the same value: "), v, F.lit(".")))
        .otherwise("An explicitly stored alias links the two entity names.")
        .alias("evidence"),
    ]


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """The members of a class of both sides, pair by pair; a class of very many pairs is dealt to several tasks."""
    parts = F.ceil(F.col("lefts") * F.col("rights") / PAIRS_PER_TASK)
    named = lambda df, side: df.select("kind", "k", "v", "part", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in ("kind", "k", "v", "part")])
    mine = left.withColumn("part", F.pmod(F.xxhash64("entity_id"), parts))
    theirs = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    out = named(mine, "left").join(named(theirs, "right"), ["kind", "k", "v", "part"])
    return out.withColumnsRenamed({"left_entity_id": "left_id", "right_entity_id": "right_id"}).filter("left_id <> right_id")


def _grouped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of two sides with their best reason, taken from all their classes in a group."""
    exact = F.col("left_own") & F.col("right_own")
    named = F.col("kind") == "name"
    best = (
        _met(left, right)
        .select(
            "left_id", "right_id", F.when(~named, 1).when(exact, 2).otherwise(3).alias("tier"),
            F.when(named, "").otherwise(F.col("k")).alias("k"), F.when(named & ~exact, "").otherwise(F.col("v")).alias("v"),
        )
        .groupBy("left_id", "right_id")
        .agg(F.min(F.struct("tier", "k", "v")).alias("best"))
    )
    return best.select("left_id", "right_id", *_reason(F.col("best.tier"), F.col("best.k"), F.col("best.v")))


def _sides(classes: DataFrame, bills: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Members that carry their classes, and their bills, with them, and those with too many."""
    key = ["side", "entity_id"]
    sizes = classes.groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    wide = F.col("held") > CARRIED
    if bills is not None:
        numbers = bills.groupBy("entity_id").agg(F.count(F.lit(1)).alias("bills"), F.count_if(F.col("bill_id").isNull()).alias("unnamed"))
        sizes = sizes.join(numbers, "entity_id", "left")
        wide = wide | (F.coalesce("bills", F.lit(0)) > CARRIED) | (F.coalesce("unnamed", F.lit(0)) > 0)
    marked = classes.join(sizes.select(*key, wide.alias("wide")), key)
    rows = checkpointed(marked)
    lean = rows.filter("NOT wide").drop("wide").withColumn("class", F.xxhash64("kind", "k", "v"))
    held = lean.groupBy(*key).agg(F.collect_list(F.struct("class", "kind", "k", "v", "own")).alias("held"))
    if bills is not None:
        few = bills.join(lean.select("entity_id").distinct(), "entity_id", "left_semi")
        held = held.join(few.groupBy("entity_id").agg(F.collect_list("bill_id").alias("bills")), "entity_id", "left")
        held = held.withColumn("bills", F.coalesce("bills", F.array().cast(few.select(F.array("bill_id").alias("b")).schema["b"].dataType)))
    held = held.withColumn("classes", F.transform("held", lambda one: one["class"]))
    return lean.join(held, key), rows


def _carried(lean: DataFrame) -> DataFrame:
    """Pairs with their best reason, each in the class that gives it; no pair leaves its task.

    Both members know all their classes. A pair with one class in common is
    settled by that; of several the best one has the pair.
    """
    pairs = _met(lean.filter("side = 'left'"), lean.filter("side = 'right'"))
    common = F.array_intersect("left_classes", "right_classes")
    theirs = F.transform(F.filter("right_held", lambda x: x["own"]), lambda x: x["class"])

    def placed(one: Column) -> Column:
        named = one["kind"] == "name"
        exact = one["own"] & F.array_contains(theirs, one["class"])
        return F.struct(
            F.when(~named, 1).when(exact, 2).otherwise(3).alias("tier"), F.when(named, "").otherwise(one["k"]).alias("k"),
            F.when(named & ~exact, "").otherwise(one["v"]).alias("v"), one["class"].alias("class"),
        )

    shared = F.filter("left_held", lambda one: F.array_contains(F.col("right_classes"), one["class"]))
    first = F.array_min(F.transform(shared, placed))["class"]
    settled = F.when(F.size(common) == 1, F.lit(True)).otherwise(first == F.col("left_class"))
    tier = F.when(F.col("kind") != "name", 1).when(F.col("left_own") & F.col("right_own"), 2).otherwise(3)
    return pairs.filter(settled).withColumn("tier", tier)


def unfolded(classes: DataFrame) -> DataFrame:
    """Pairs of entities in a common class, each with its best reason."""
    lean, rows = _sides(classes, None)
    pairs = _carried(lean).select("left_id", "right_id", *_reason(F.col("tier"), F.col("k"), F.col("v")))
    return pairs if (rest := _wide_pairs(rows)) is None else pairs.unionByName(rest)


def _wide_pairs(rows: DataFrame) -> DataFrame | None:
    """Pairs of which one has too many classes or bills to carry."""
    if rows.filter("wide").isEmpty():
        return None
    left, right = (rows.filter(F.col("side") == side).drop("side") for side in ("left", "right"))
    wide = _grouped(left.filter("wide").drop("wide"), right.drop("wide"))
    return wide.unionByName(_grouped(left.filter("NOT wide").drop("wide"), right.filter("wide").drop("wide")))


def entity_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of entities that share an id, a name or an alias; the best reason per pair."""
    return unfolded(match_classes(left, right))


def _endpoints(relationships: DataFrame) -> DataFrame:
    """Each relationship once per entity it touches."""
    ends = F.array_distinct(F.array("source_entity_id", "target_entity_id"))
    return relationships.select("relationship_id", "source_system", F.explode(ends).alias("entity_id"))


def correlate(links: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Bill entities matched to entities of external relationships not linked to the bill.

    Entities are matched once, whatever the number of bills that name them. A pair
    is not sent anywhere: both entities bring their bills along.
    """
    linked = links.select("bill_id", "entity_id").distinct()
    involved = _endpoints(relationships).select("entity_id").distinct()
    left = entities.join(linked.select("entity_id").distinct(), "entity_id", "left_semi")
    right = entities.join(involved, "entity_id", "left_semi")
    lean, rows = _sides(match_classes(left, right), linked)
    found = _carried(lean).select(
        F.explode(F.array_except("left_bills", "right_bills")).alias("bill_id"), "right_id", "left_id", *_reason(F.col("tier"), F.col("k"), F.col("v"))
    )
    rest = _wide_pairs(rows)
    if rest is None:
        return found
    own = linked.withColumnRenamed("entity_id", "right_id")
    more = linked.withColumnRenamed("entity_id", "left_id").join(rest, "left_id").join(own, ["bill_id", "right_id"], "left_anti")
    return found.unionByName(more)


def direct_relationships(links: DataFrame, relationships: DataFrame) -> DataFrame:
    """The external relationships behind `direct_evidence`, one row each."""
    linked = links.select("bill_id", "entity_id").distinct()
    return linked.join(_endpoints(relationships.filter(F.col("source_system").isin(EXTERNAL_SYSTEMS))), "entity_id")


def direct_evidence(links: DataFrame, relationships: DataFrame) -> DataFrame:
    """Bill entities that external relationships touch directly."""
    linked = links.select("bill_id", "entity_id").distinct()
    touching = (
        _endpoints(relationships.filter(F.col("source_system").isin(EXTERNAL_SYSTEMS)))
        .groupBy("entity_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set("source_system")), ", ").alias("source_systems"),
            F.count(F.lit(1)).alias("relationships"),
        )
    )
    return linked.join(touching, "entity_id").select(
        "bill_id",
        "entity_id",
        F.lit("direct_external_evidence").alias("match_basis"),
        F.lit(1.0).alias("confidence"),
        "source_systems",
        "relationships",
    )


def _numbered_bills(links: DataFrame) -> DataFrame:
    """(bill_id, number): bills numbered without gaps, so that their bits lie close together."""
    bills = links.select("bill_id").distinct()
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(bills.repartitionByRange(parts, "bill_id").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("bill_id"))
    return placed.withColumn("at", local).join(offsets, "part").select("bill_id", (F.col("at") + F.col("skip")).alias("number"))


def _ends(relationships: DataFrame) -> DataFrame:
    """(relationship_id, low, high, plain): the two ends of each relationship; `plain` where all rows of an id agree in them."""
    low, high = F.least("source_entity_id", "target_entity_id"), F.greatest("source_entity_id", "target_entity_id")
    ends = relationships.groupBy("relationship_id").agg(
        F.min(low).alias("low"), F.max(low).alias("low2"), F.min(high).alias("high"), F.max(high).alias("high2")
    ).filter("low IS NOT NULL")
    plain = F.col("relationship_id").isNotNull() & (F.col("low") == F.col("low2")) & (F.col("high") == F.col("high2"))
    return ends.select("relationship_id", "low", "high", plain.alias("plain"))


def _held_by_pairs(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(relationship_id, n) whose sum is the number of bills that either end holds.

    Both ends' numbers, less what both hold; that is looked up from the end of
    fewer words, so a hub's bitmap is not sent along its edges.
    """
    sizes = held.groupBy("entity_id").agg(F.sum(F.bit_count("bits")).alias("n"), F.count(F.lit(1)).alias("words"))
    side = lambda end: sizes.select(F.col("entity_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("words").alias(f"words_{end}"))
    sized = checkpointed(pairs.join(side("low"), "low", "left").join(side("high"), "high", "left"))
    alone = F.when(F.col("low") == F.col("high"), F.lit(0)).otherwise(F.coalesce("n_high", F.lit(0)))
    either = sized.select("relationship_id", (F.coalesce("n_low", F.lit(0)) + alone).alias("n"))
    less = F.col("words_low") <= F.col("words_high")
    both = sized.filter("low <> high AND n_low IS NOT NULL AND n_high IS NOT NULL").select(
        "relationship_id", F.when(less, F.col("low")).otherwise(F.col("high")).alias("entity_id"),
        F.when(less, F.col("high")).otherwise(F.col("low")).alias("far"),
    )
    theirs = held.select(F.col("entity_id").alias("far"), "word", F.col("bits").alias("far_bits"))
    shared = both.join(held, "entity_id").join(theirs, ["far", "word"])
    return either.unionByName(shared.select("relationship_id", (-F.bit_count(F.col("bits").bitwiseAND(F.col("far_bits")))).alias("n")))


def reach(links: DataFrame, relationships: DataFrame, depth: int = 2) -> DataFrame:
    """(relationship_id, step, bills): how many bills first reach a relationship at each step.

    Bills are bits. An entity has one word for every 64 bills of which it holds
    one; a step sends the words of each end of a relationship to the other end.
    A relationship's bills are counted from those of its ends and get no rows of
    their own; only ids whose rows name different ends unite their words.
    """
    ends = checkpointed(_ends(relationships))
    pairs, mixed = ends.filter("plain").drop("plain"), ends.filter("NOT plain").select(F.col("relationship_id").alias("id"))
    edges = None
    if not mixed.isEmpty():
        every = _endpoints(relationships).select("relationship_id", "entity_id")
        edges = checkpointed(every.join(mixed, every["relationship_id"].eqNullSafe(mixed["id"]), "left_semi"))
    bills = checkpointed(_numbered_bills(links))
    named = links.select("bill_id", "entity_id").distinct().join(bills, "bill_id")
    word, bit = F.shiftright("number", 6), F.expr("shiftleft(1L, CAST(number & 63 AS INT))")
    held = checkpointed(named.groupBy("entity_id", word.alias("word")).agg(F.bit_or(bit).alias("bits")))
    across = pairs.filter("low <> high")
    across = across.select(F.col("low").alias("entity_id"), F.col("high").alias("far")).unionByName(
        across.select(F.col("high").alias("entity_id"), F.col("low").alias("far"))
    )
    counts = None
    for step in range(1, depth + 1):
        numbers = _held_by_pairs(pairs, held)
        if edges is not None:
            touched = checkpointed(held.join(edges, "entity_id").groupBy("relationship_id", "word").agg(F.bit_or("bits").alias("bits")))
            numbers = numbers.unionByName(touched.select("relationship_id", F.bit_count("bits").alias("n")))
        numbers = numbers.withColumn("step", F.lit(step))
        counts = numbers if counts is None else counts.unionByName(numbers)
        if step < depth:
            sent = held.unionByName(held.join(across, "entity_id").select(F.col("far").alias("entity_id"), "word", "bits"))
            if edges is not None:
                sent = sent.unionByName(touched.join(edges, "relationship_id").select("entity_id", "word", "bits"))
            held = checkpointed(sent.groupBy("entity_id", "word").agg(F.bit_or("bits").alias("bits")))
    # What is reached within a step stays reached, so a step's own bills are the growth.
    upto = [F.sum(F.when(F.col("step") == step, F.col("n")).otherwise(0)).alias(f"_{step}") for step in range(1, depth + 1)]
    grown = [
        F.struct(F.lit(step).alias("step"), (F.col(f"_{step}") - (F.col(f"_{step - 1}") if step > 1 else 0)).cast("long").alias("bills"))
        for step in range(1, depth + 1)
    ]
    steps = counts.groupBy("relationship_id").agg(*upto).select("relationship_id", F.explode(F.array(*grown)).alias("s"))
    return steps.select("relationship_id", "s.step", "s.bills").filter("bills > 0")


def traverse(links: DataFrame, relationships: DataFrame, depth: int = 2, most: int | None = 3) -> DataFrame:
    """Relationships within `depth` steps of the entities each bill names; `most` bounds the depth.

    One join per step; a step starts from entities the bill has not reached yet.
    """
    depth = max(1, depth if most is None else min(depth, most))
    edges = _endpoints(relationships).select("relationship_id", "entity_id")
    frontier = links.select("bill_id", "entity_id").distinct()
    seen = frontier
    reached = None
    for step in range(1, depth + 1):
        touched = (
            frontier.join(edges, "entity_id")
            .select("bill_id", "relationship_id")
            .distinct()
            .withColumn("step", F.lit(step))
        )
        reached = touched if reached is None else reached.unionByName(touched)
        if step == depth:
            break
        frontier = checkpointed(
            touched.join(edges, "relationship_id")
            .select("bill_id", "entity_id")
            .distinct()
            .join(seen, ["bill_id", "entity_id"], "left_anti")
        )
        seen = seen.unionByName(frontier)
    return reached.groupBy("bill_id", "relationship_id").agg(F.min("step").alias("step"))
