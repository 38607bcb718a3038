import difflib
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import correlation
from ledgerline.operators import components
from ledgerline.plans import listing, overlap, packets, queue, watch


def entity(spark, rows):
    return spark.createDataFrame(
        rows,
        "entity_id long, entity_type string, canonical_name string, normalized_name string, "
        "external_ids map<string,string>, aliases array<string>",
    )


def test_correlation_tiers(spark):
    left = entity(spark, [
        (1, "person", "Ann", "ann", {"bioguide": "A1"}, []),
        (2, "organization", "Acme", "acme", {}, ["Acme Holdings"]),
        (3, "person", "Acme", "acme", {}, []),
    ])
    right = entity(spark, [
        (11, "organization", "Other", "other", {"bioguide": "A1"}, None),
        (12, "committee", "Acme", "acme", {}, None),
        (13, "committee", "Acme Holdings", "acme holdings", None, None),
        (14, "committee", "Acm", "acm", None, None),
    ])
    found = {(r["left_id"], r["right_id"]): (r["match_basis"], r["confidence"]) for r in correlation.entity_matches(left, right).collect()}
    assert found == {(1, 11): ("external_id", 1.0), (2, 12): ("exact_name", 0.95), (2, 13): ("alias", 0.85)}


def test_walk_depth(spark):
    links = spark.createDataFrame([(1, 10)], "bill_id long, entity_id long")
    edges = spark.createDataFrame(
        [(100, 10, 20, "fec"), (101, 30, 20, "fec"), (102, 30, 40, "lda"), (103, 40, 50, "lda")],
        "relationship_id long, source_entity_id long, target_entity_id long, source_system string",
    )
    reach = lambda d: {r["relationship_id"] for r in correlation.traverse(links, edges, d).collect()}
    assert [reach(d) for d in (1, 2, 3, 9)] == [{100}, {100, 101}, {100, 101, 102}, {100, 101, 102}]


def test_reach_counts_what_the_walk_finds(spark):
    """A hub that all bills name, and a chain; bills far apart in number."""
    links = spark.range(200).select((F.col("id") * 1_000_003).alias("bill_id"), F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(10).alias("entity_id"))
    edges = spark.createDataFrame([(100, 10, 20, "fec"), (101, 30, 20, "fec"), (102, 30, 40, "lda"), (103, 40, 3, "lda"), (104, 5, 5, "lda")],
        "relationship_id long, source_entity_id long, target_entity_id long, source_system string")
    for depth in (1, 2, 4):
        walked = correlation.traverse(links, edges, depth, most=None).groupBy("relationship_id", "step").count()
        got = correlation.reach(links, edges, depth)
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in walked.collect())


def test_reach_of_mixed_and_missing_ends(spark):
    """Ids that repeat with other ends, one or no end, and no id at all, against sets of bills."""
    links = [(b, e) for b in range(150) for e in (b % 13, b % 7 + 20)] + [(None, 3), (5, None)]
    edges = [(i, i % 17, (i * 5) % 29) for i in range(60)] + [(3, 40, 2), (4, 4, None), (9, 9, None), (70, 6, 6), (71, None, None), (None, 1, 22), (None, 2, 41)]
    held = {e: {b for b, x in links if x == e and b is not None} for e in range(50)}
    ends = {}
    for i, a, b in edges:
        ends.setdefault(i, set()).update(x for x in (a, b) if x is not None)
    want, before = set(), dict.fromkeys(ends, 0)
    for step in (1, 2, 3):
        touched = {i: set().union(*(held[e] for e in of)) for i, of in ends.items()}
        want |= {(i, step, len(bills) - before[i]) for i, bills in touched.items() if len(bills) > before[i]}
        before = {i: len(bills) for i, bills in touched.items()}
        held = {e: held[e].union(*(touched[i] for i, of in ends.items() if e in of and i is not None)) for e in held}
    got = correlation.reach(
        spark.createDataFrame(links, "bill_id long, entity_id long"),
        spark.createDataFrame([(*e, "fec") for e in edges], "relationship_id long, source_entity_id long, target_entity_id long, source_system string"), 3,
    )
    assert {tuple(r) for r in got.collect()} == want


def test_reach_sends_no_wide_bitmap(spark, monkeypatch):
    """An entity of one bill is one narrow row, however many bills there are."""
    written = []
    real = correlation.checkpointed
    monkeypatch.setattr(correlation, "checkpointed", lambda df, **conf: written.append(df) or real(df, **conf))
    links = spark.range(3000).select((F.col("id") * 11).alias("bill_id"), F.col("id").alias("entity_id"))
    edges = spark.range(3000).select("id", F.col("id").alias("source_entity_id"), (-1 - F.col("id") % 50).alias("target_entity_id"), F.lit("fec").alias("source_system")).withColumnRenamed("id", "relationship_id")
    rows = correlation.reach(links, edges, 2)
    assert rows.filter("step = 1").count() == 3000
    assert all(f.dataType.simpleString() != "binary" for df in written for f in df.schema.fields)
    assert max(df.count() for df in written) <= 6000


def test_a_name_of_many_is_one_class(spark):
    left = entity(spark, [(i, "person", "Ann", "ann", None, None) for i in range(300)])
    right = entity(spark, [(1000 + i, "person", "Ann", "ann", None, None) for i in range(200)] + [(5000, "person", "Bob", "bob", None, None)])
    classes = correlation.match_classes(left, right)
    rows = classes.collect()
    assert len(rows) == 500 and {(r["lefts"], r["rights"]) for r in rows} == {(300, 200)}
    assert {r["links"] for r in correlation.class_links(classes).collect()} == {200}
    assert correlation.unfolded(classes).count() == 300 * 200


def test_pages_at_any_offset_and_after_a_cursor(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 90).alias("a"), F.when(F.col("id") % 11 != 0, F.sha2(F.col("id").cast("string"), 256)).alias("b"), "id")
    order = ["a", "b", "id"]
    kept = listing.Pages(rows, order, parts=12)
    assert len(kept.index) > 5
    for offset, limit in ((0, 10), (41, 100), (123, 1), (490, 30), (500, 5), (7000, 5), (0, 500)):
        want = listing.page(rows, order, offset, limit).collect()
        assert [tuple(r) for r in kept.page(offset, limit).collect()] == [tuple(r) for r in want]
    # One part is read for a page that lies in one.
    files = kept.page(10, 5).inputFiles()
    assert len({f.split("_part=")[1].split("/")[0] for f in files}) == 1
    seen, cursor = [], (-1, None, -1)
    while page := kept.after(cursor, 60).collect():
        seen += page
        cursor = tuple(page[-1][name] for name in order)
    assert seen == rows.orderBy(*order).collect()


def items(spark, keys):
    rows = [
        ("2024-01-01", "A", key, "", False, True, "s" * (i % 9), i) for i, key in enumerate(keys)
    ]
    return spark.createDataFrame(
        rows, "date string, institution string, issue string, body string, official boolean, substantive boolean, synopsis string, item_id long"
    )


def families(seed, size):
    rng = random.Random(seed)
    keys = []
    for _ in range(size):
        text = list("".join(rng.choice("abcdefghij klmnop") for _ in range(60)).strip().ljust(58, "z"))
        for _ in range(8):
            # A drift: neighbours are alike, the ends of the chain are not.
            for _ in range(rng.choice([0, 1, 1, 2, 9])):
                text[rng.randrange(len(text))] = rng.choice("qrstuvwxy")
            keys.append("".join(text))
    keys += ["short key one", "short key two", "short key one"]
    rng.shuffle(keys)
    return keys


def plain_fold(rows):
    """Item by item, each against every record kept so far."""
    kept = {}
    for row in sorted(rows, key=lambda r: r[7]):
        if not row[2]:
            continue
        records = kept.setdefault(row[:2], [])
        for i, old in enumerate(records):
            close = min(len(row[2]), len(old[2])) >= 40 and difflib.SequenceMatcher(None, row[2], old[2]).ratio() >= 0.94
            if row[2] == old[2] or (len(row[3]) >= 60 and row[3] == old[3]) or close:
                if (row[4], row[5], len(row[6])) > (old[4], old[5], len(old[6])):
                    records[i] = row
                break
        else:
            records.append(row)
    return sorted(r for records in kept.values() for r in records)


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_overlap_merge_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i, key in enumerate(families(seed, 5)):
        body = rng.choice(["", "short", "b" * 60, "c" * 70 + str(rng.randrange(3))])
        rows.append((rng.choice(["2024-01-01", "2024-01-02"]), "A", rng.choice([key, key, key, ""]), body, rng.random() < 0.2, rng.random() < 0.5, "s" * rng.randrange(5), i))
    frame = spark.createDataFrame(rows, "date string, institution string, issue string, body string, official boolean, substantive boolean, synopsis string, item_id long")
    assert sorted(tuple(r) for r in overlap.merge(frame).collect()) == plain_fold(rows)


@pytest.mark.parametrize("carried, at_once", [(32, 50_000_000), (2, 3), (0, 50_000_000)])
def test_correlations_by_plain_loops_without_sending_pairs(spark, monkeypatch, carried, at_once):
    monkeypatch.setattr(correlation, "CARRIED", carried)
    monkeypatch.setattr(correlation, "PAIRS_PER_TASK", at_once)
    rng = random.Random(carried)
    kinds = ["person", "organization", "committee"]
    entities = [
        (i, rng.choice(kinds), f"N{i % 9}", f"n{i % 9}", {k: rng.choice("xyz") for k in rng.sample(["bioguide", "lda_client_id", "other"], rng.randrange(3))},
         [rng.choice([f"N{rng.randrange(12)}", f"Alias {rng.randrange(5)}"]) for _ in range(rng.randrange(4))])
        for i in range(60)
    ]
    links = sorted({(rng.choice([1, 2, 3, None]), rng.randrange(40)) for _ in range(70)}, key=str)
    relations = [(n, rng.randrange(20, 60), rng.randrange(20, 60), "fec") for n in range(40)]
    group = lambda e: {"committee": "organization"}.get(e[1], e[1])
    answers = lambda e: {e[3]: True} | {a.lower(): False for a in e[5] if a.lower() != e[3]}

    def best(a, b):
        ids = sorted((1, k, v) for k, v in a[4].items() if k != "other" and b[4].get(k) == v)
        names = [(2, "", n) if answers(a)[n] and answers(b)[n] else (3, "", "") for n in answers(a) if group(a) == group(b) and n in answers(b)]
        return min(ids + names, default=None)

    touched = {e for r in relations for e in r[1:3]}
    expected = []
    for bill, left in links:
        for right in touched - {left}:
            reason = best(entities[left], entities[right])
            if reason and (bill is None or (bill, right) not in links):
                expected.append((str(bill), left, right, reason[0], reason[1:]))
    found = correlation.correlate(
        spark.createDataFrame(links, "bill_id long, entity_id long"),
        spark.createDataFrame(entities, "entity_id long, entity_type string, canonical_name string, normalized_name string, external_ids map<string,string>, aliases array<string>"),
        spark.createDataFrame(relations, "relationship_id long, source_entity_id long, target_entity_id long, source_system string"),
    )
    tiers = {"external_id": 1, "exact_name": 2, "alias": 3}

    def told(r):
        if r["match_basis"] == "alias":
            return "", ""
        said = r["evidence"].rstrip(".")
        return tuple(said.removeprefix("Both entities share ").split("=")) if r["match_basis"] == "external_id" else ("", said.split(": ")[1])

    rows = [(str(r["bill_id"]), r["left_id"], r["right_id"], tiers[r["match_basis"]], told(r)) for r in found.collect()]
    assert sorted(rows) == sorted(expected) and len({r[3] for r in rows}) == 3
    if carried == 32:
        # Nothing is grouped or joined above the join that makes the pairs.
        above = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
        assert "Aggregate" not in above and "Join" not in above


@pytest.mark.parametrize("items_per_task", [0, 30, 10_000])
def test_overlap_merge_is_the_same_with_and_without_pairs(spark, items_per_task):
    rng = random.Random(11)
    rows = []
    for i, key in enumerate(families(11, 4)):
        body = rng.choice(["", "b" * 60, "c" * 70 + str(rng.randrange(3))])
        rows.append((rng.choice(["2024-01-01", "2024-01-02", "2024-01-02"]), "A", rng.choice([key, key, ""]), body, rng.random() < 0.2, rng.random() < 0.5, "s" * rng.randrange(5), i))
    frame = spark.createDataFrame(rows, "date string, institution string, issue string, body string, official boolean, substantive boolean, synopsis string, item_id long")
    assert sorted(tuple(r) for r in overlap.merge(frame, items_per_task=items_per_task).collect()) == plain_fold(rows)


def test_the_fold_compares_few_keys_where_many_are_alike(monkeypatch):
    asked = []
    plain = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: asked.append(1) or plain(m))
    records = overlap.Records()
    for i in range(1000):
        records.add(i, f"contract number {i % 7} with supplier {i:04d} of {'bolts rings plates anvils'.split()[i % 4] * 6} parts", None, (False, True, 9))
    # 500,000 pairs, a quarter of them alike.
    assert len(records.kept) == 4 and len(asked) < 2000


def test_overlap_of_a_third_of_all_rows(spark):
    base = "award of contract for road repair services in the northern district phase "
    keys = [base + f"{i:03d}" for i in range(100)] + [f"{i} " * 30 + "unlike" for i in range(20)]
    kept = [r["issue"] for r in overlap.merge(items(spark, keys)).collect()]
    assert sum(k.startswith(base) for k in kept) == 1


def test_a_hot_bucket_of_unlike_keys_falls_apart(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(300)]
    keys = [" ".join(rng.choices(words, k=9)) for _ in range(400)]
    keys += [k[:-1] + "!" for k in keys[:40]]
    frame = items(spark, keys)
    nodes = frame.select("date", "institution", "issue", F.xxhash64("date", "institution", "issue").alias("node"))
    links = overlap.verified(nodes).select(F.col("new").alias("a"), F.col("old").alias("b"))
    sizes = [r["count"] for r in components.connected(links).groupBy("root").count().collect()]
    assert max(sizes) <= 3 and len(sizes) >= 35
    rows = [("2024-01-01", "A", key, "", False, True, "s" * (i % 9), i) for i, key in enumerate(keys)]
    assert sorted(tuple(r) for r in overlap.merge(frame).collect()) == plain_fold(rows)


def entries(spark, with_urls=True):
    url = "https://x" if with_urls else None
    kinds = [
        ("S", "section_text", {}), ("D", "deterministic_finding", {"kind": "money"}),
        ("Q", "scope_finding", {"category": "late_scope_outlier"}), ("L", "provision_lineage", {"event_type": "modified"}),
        ("A", "candidate_amendment", {}), ("E", "named_organization", {}), ("C", "external_correlation", {}),
        ("X", "external_relationship", {}), ("F", "bill_level_fiscal_context", {"category": "mandate"}),
    ]
    rows = [(1, 2, 3, p, k, "summary", "text", url, m, 1, p + "1") for p, k, m in kinds]
    return spark.createDataFrame(
        rows, "bill_id long, version_id long, section_id long, prefix string, kind string, summary string, evidence string, "
        "source_url string, metadata map<string,string>, place int, evidence_id string")


def test_packet_headers(spark):
    head = packets.headers(entries(spark)).first()
    assert head["entry_count"] == 9 and head["unresolved_gaps"] == []
    assert head["trigger_types"] == [
        "bill_text_money", "candidate_amendment", "external_correlation", "external_relationship", "fiscal_mandate",
        "late_scope_outlier", "lineage_modified", "named_organization",
    ]
    bare = packets.headers(entries(spark, with_urls=False)).first()
    assert len(bare["unresolved_gaps"]) == 5 and bare["has_external_context"]


def test_packet_hash_ignores_ids_and_order(spark):
    rows = entries(spark)
    with_id = rows.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("finding_id"), F.lit("77"))))
    digest = lambda df: packets.headers(df).first()["packet_hash"]
    assert digest(rows) == digest(with_id) == digest(rows.repartition(3).orderBy(F.rand(1)))
    assert digest(rows) != digest(rows.withColumn("evidence", F.lit("other")))


def test_queue_keeps_what_people_did(spark):
    schema = "bill_id long, version_id long, section_id long, packet_hash string, trigger_types array<string>, unresolved_gaps array<string>, entry_count long"
    first = spark.createDataFrame([(1, 1, 1, "a", ["t"], [], 1), (1, 1, 2, "b", ["t"], [], 1)], schema)
    empty = spark.createDataFrame([], schema + ", status string, analyst_notes string, created_at timestamp, updated_at timestamp, last_seen_at timestamp")
    day1 = queue.sync(empty, first, "2024-01-01")
    done, refused = queue.update(day1, spark.createDataFrame(
        [(1, 1, 2, "b", "completed", "fine", 1), (1, 1, 1, "a", "superseded", None, 1)],
        "bill_id long, version_id long, section_id long, packet_hash string, status string, analyst_notes string, at long",
    ).withColumn("at", F.timestamp_seconds("at")))
    assert refused.count() == 1
    second = spark.createDataFrame([(1, 1, 1, "c", ["t"], ["g"], 2), (1, 1, 2, "d", [], [], 1)], schema)
    rows = {r["packet_hash"]: r for r in queue.next_step(queue.sync(done, second, "2024-02-01")).collect()}
    assert {h: r["status"] for h, r in rows.items()} == {"a": "superseded", "b": "completed", "c": "new", "d": "new"}
    assert rows["b"]["analyst_notes"] == "fine" and rows["c"]["suggested_next_step"] == "resolve_evidence_gaps"


def test_first_sight_of_a_bill_is_one_event(spark):
    bills = spark.createDataFrame([(1, "US:119:hr:1"), (2, "US:119:hr:2")], "bill_id long, bill_key string")
    before = spark.createDataFrame([(1, "action", "x")], "bill_id long, kind string, key string")
    after = spark.createDataFrame([(1, "action", "x"), (1, "version", "s"), (2, "action", "y")], "bill_id long, kind string, key string")
    found = watch.changes(bills.filter("bill_id = 1"), bills, before, after).collect()
    assert {(r["bill_id"], r["event_type"]) for r in found} == {(2, "bill_discovered"), (1, "new_version")}


def test_amendments_and_lineage_enter_packets(spark):
    sections = spark.createDataFrame(
        [(1, 20, 200, "3", "Heading", "Section text")],
        "bill_id long, version_id long, section_id long, section_number string, heading string, section_text string",
    )
    places = spark.createDataFrame(
        [(1, 10, 1, "v1", "https://v1"), (1, 20, 2, "v2", None)],
        "bill_id long, version_id long, place int, version_code string, source_url string",
    )
    events = spark.createDataFrame(
        [(1, 10, None, "3", "introduced", "a"), (1, 20, 10, "3", "modified", "b"), (1, 20, 10, "9", "removed", "c")],
        "bill_id long, version_id long, from_version_id long, section_number string, event_type string, detail string",
    )
    attributions = spark.createDataFrame(
        [(1, "3", 5, 0.6, "temporal_text_overlap", 0.1), (1, "3", 4, 0.7, "temporal_text_overlap", 0.2)],
        "bill_id long, section_number string, amendment_id long, confidence double, basis string, token_overlap double",
    )
    amendments = spark.createDataFrame(
        [(4, "hamdt", "40", "https://a"), (5, "samdt", "50", None)],
        "amendment_id long, amendment_type string, amendment_number string, source_url string",
    )
    rows = packets.numbered(
        [
            packets.section_entries(sections, places),
            packets.lineage_entries(sections, events, places),
            packets.amendment_entries(sections, attributions, amendments),
        ]
    )
    found = {r["evidence_id"]: r["summary"] for r in rows.collect()}
    assert found == {
        "S1": "Latest text for section 3.",
        "L1": "Section 3 was introduced in version v1.",
        "L2": "Section 3 was modified in version v2.",
        "A1": "Candidate amendment association: HAMDT 40.",
        "A2": "Candidate amendment association: SAMDT 50.",
    }
    head = packets.headers(rows).first()
    assert head["unresolved_gaps"] == ["candidate_amendment_source_url", "section_source_url"]


def test_texts_of_events_are_joined_to_numbered_entries(spark):
    sections = spark.createDataFrame(
        [(1, 30, 300, "3", "Heading", "Section text"), (2, 50, 500, "1", None, "Other")],
        "bill_id long, version_id long, section_id long, section_number string, heading string, section_text string",
    )
    places = spark.createDataFrame(
        [(1, 10, 1, "v1", "https://v1"), (1, 20, 2, "v2", None), (1, 30, 10, "v3", None), (2, 50, 1, "w", None)],
        "bill_id long, version_id long, place int, version_code string, source_url string",
    )
    events = spark.createDataFrame(
        [(1, 10, None, "3", "introduced"), (1, 20, 10, "3", "removed"), (1, 30, 20, "3", "introduced"), (1, 30, 20, "9", "introduced"), (2, 50, None, "1", "introduced")],
        "bill_id long, version_id long, from_version_id long, section_number string, event_type string",
    )
    texts = spark.createDataFrame([(10, "3", "a"), (30, "3", "c"), (30, "9", "d")], "version_id long, section_number string, section_text string")
    holder = F.expr("IF(event_type = 'removed', from_version_id, version_id)")
    held = texts.select(F.col("version_id").alias("holder"), "section_number", F.col("section_text").alias("detail"))
    detailed = events.withColumn("holder", holder).join(held, ["holder", "section_number"], "left").drop("holder")
    first = packets.section_entries(sections, places)
    old = packets.numbered([first, packets.lineage_entries(sections, detailed, places)])
    new = packets.numbered([first], [packets.lineage_entries(sections, events, places, texts)])
    assert set(new.columns) == set(old.columns) and new.schema["place"].dataType == old.schema["place"].dataType
    rows = lambda df: sorted(str(r) for r in df.select(*old.columns).collect())
    assert rows(new) == rows(old)
    assert {(r["section_id"], r["evidence_id"]): r["evidence"] for r in new.filter("prefix = 'L'").collect()} == {
        (300, "L1"): "a", (300, "L2"): "a", (300, "L3"): "c", (500, "L1"): ""}


def test_rule_flags_are_patched(spark):
    rules = spark.createDataFrame([(1, True, False, False)], "rule_id long, active boolean, auto_research boolean, auto_report boolean")
    patches = spark.createDataFrame(
        [(1, False, None, None, 1), (1, None, True, None, 2)],
        "rule_id long, active boolean, auto_research boolean, auto_report boolean, at long",
    )
    row = watch.patch_rules(rules, patches).first()
    assert (row["active"], row["auto_research"], row["auto_report"]) == (False, True, False)


def test_pages_are_read_few_at_a_time():
    import pandas as pd

    from ledgerline.sources import pages

    given = pd.DataFrame({"page_id": range(300), "url": "https://a.example.com/", "html": [f'<p>n{i}</p><a href="/{i}">x</a>' for i in range(300)]})
    read = list(pages._read(iter([given, given.iloc[:0]])))
    assert max(len(part) for part in read) <= 64
    whole = pd.concat(read)
    assert list(whole["page_id"]) == list(range(300)) and whole["links"].iloc[299][0]["href"] == "https://a.example.com/299"


def test_frontier_reads_pages_once(spark):
    from ledgerline.sources import pages

    rows = spark.createDataFrame([(1, "https://a.org/x/1", '<a href="/x/2">n</a>'), (2, "https://a.org/x/2", '<a href="/x/3">n</a>')], "page_id long, url string, html string")
    read = pages.page_texts(rows)
    found = pages.frontier(read, read.filter("page_id = 1").select("url"), ["a.org"], ["/x/"])
    assert {(r["url"], r["depth"], r["page_id"]) for r in found.collect()} == {("https://a.org/x/1", 0, 1), ("https://a.org/x/2", 1, 2), ("https://a.org/x/3", 2, None)}
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
