import difflib
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import alike, lineage, scope


def test_undated_versions_come_last(spark):
    versions = spark.createDataFrame(
        [(1, 9, "a", "2024-01-01"), (1, 2, "b", None), (1, 5, "c", "2024-03-01")],
        "bill_id long, version_id long, version_code string, issued_on string",
    )
    pairs = {r["version_id"]: r["from_version_id"] for r in lineage.version_pairs(versions).collect()}
    assert pairs == {9: None, 5: 9, 2: 5}


def expected_events(versions):
    """The greedy matching written out for one bill: {version: {number: text}} in order."""
    events, previous, last = set(), None, None
    for version, current in versions:
        if previous is None:
            events |= {(version, n, "introduced") for n in current}
        else:
            gone, fresh = set(previous) - set(current), set(current) - set(previous)
            used = {}
            for old in sorted(gone):
                best = None
                for new in sorted(fresh - set(used.values())):
                    score = difflib.SequenceMatcher(None, previous[old], current[new]).ratio()
                    if score >= 0.9 and (best is None or score > best[1]):
                        best = (new, score)
                if best:
                    used[old] = best[0]
                    events.add((version, best[0], "renumbered"))
            events |= {(version, n, "removed") for n in gone - set(used)}
            events |= {(version, n, "introduced") for n in fresh - set(used.values())}
            events |= {
                (version, n, "modified") for n in set(previous) & set(current) if previous[n] != current[n]
            }
        previous, last = current, version
    return events


def test_lineage_matches_brute_force(spark):
    base = "The department shall award grants to eligible counties for rural road repair number "
    versions = [
        (10, {"1": base + "one", "2": base + "two", "3": "Short text", "4": "Stays as is"}),
        (11, {"1": base + "one", "5": base + "two!", "6": base + "twa", "7": "Nothing alike at all, really", "4": "Stays as it was"}),
        (12, {"1": base + "one", "8": base + "two!", "4": "Stays as it was"}),
    ]
    heads = spark.createDataFrame(
        [(1, v, f"v{v}", f"2024-01-{v}") for v, _ in versions],
        "bill_id long, version_id long, version_code string, issued_on string",
    )
    rows = [(v, n, i, t) for v, held in versions for i, (n, t) in enumerate(held.items())]
    texts = spark.createDataFrame(rows, "version_id long, section_number string, ordinal int, section_text string")
    found = lineage.lineage_events(texts, heads).collect()
    assert {(r["version_id"], r["section_number"], r["event_type"]) for r in found} == expected_events(versions)
    moved = [r for r in found if r["event_type"] == "renumbered"]
    assert all(r["similarity"] >= 0.9 for r in moved)
    changed = [r for r in found if r["event_type"] == "modified"]
    assert changed and changed[0]["diff"].startswith("--- v10:section-4")


def drifting(seed, size):
    """Texts, many alike and some equal, under numbers that sort as text."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    texts = []
    for _ in range(size):
        if texts and rng.random() < 0.6:
            text = list(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice("qz ")
            texts.append("".join(text))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(4, 30))))
    return texts


def test_renumbering_of_many_sections_equals_brute_force(spark):
    texts = drifting(11, 160)
    versions = [(10, {str(i): t for i, t in enumerate(texts[:80])}), (11, {str(i): t for i, t in enumerate(texts[70:], 500)} | {"3": texts[3], "4": "changed"})]
    heads = spark.createDataFrame([(1, v, f"v{v}", f"2024-01-{v}") for v, _ in versions], "bill_id long, version_id long, version_code string, issued_on string")
    rows = [(v, n, i, t) for v, held in versions for i, (n, t) in enumerate(held.items())]
    sections = spark.createDataFrame(rows, "version_id long, section_number string, ordinal int, section_text string")
    found = {(r["version_id"], r["section_number"], r["event_type"]) for r in lineage.lineage_events(sections, heads, with_text=False).collect()}
    expected = expected_events(versions)
    assert found == expected and sum(e == "renumbered" for *_, e in expected) > 20


def test_bounds_lose_no_alike_pair():
    texts = drifting(5, 60) + ["", "a", "ab", "ab" * 300, "ab" * 290 + "x" * 20]
    for floor in (0.5, 0.9):
        found = {(i, j) for i, j, _ in alike.ratios(texts, texts, floor)}
        assert found == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if difflib.SequenceMatcher(None, a, b).ratio() >= floor}


def test_blocks_of_a_large_pair_are_many_rows(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text")).withColumn("sha", F.sha2("text", 256))
    blocks = alike._blocks(rows, ["k"], "old").collect()
    assert len(blocks) >= 1000 // alike.BLOCK_TEXTS and max(len(b["old_shas"]) for b in blocks) <= alike.BLOCK_TEXTS
    assert sorted(s for b in blocks for s in b["old_shas"]) == sorted(r["sha"] for r in rows.collect())


def test_attribution_needs_overlap_and_dates(spark):
    events = spark.createDataFrame(
        [(1, 7, "2024-01-01", "2024-02-01", "grants for rural road repair and bridges")],
        "bill_id long, event_id long, f string, t string, new_text string",
    ).select("bill_id", "event_id", F.to_date("f").alias("from_day"), F.to_date("t").alias("to_day"), "new_text")
    amendments = spark.createDataFrame(
        [(1, 1, "2024-01-10", "adds rural bridges"), (1, 2, "2024-01-10", "unrelated words entirely"),
         (1, 3, "2025-01-10", "rural road bridges"), (1, 4, "2025-01-10", "bridges only among several different longer words here")],
        "bill_id long, amendment_id long, d string, search_text string",
    ).select("bill_id", "amendment_id", F.to_date("d").alias("amendment_day"), "search_text")
    found = {r["amendment_id"]: r for r in lineage.attribute(events, amendments).collect()}
    assert set(found) == {1, 3}
    assert found[1]["basis"] == "temporal_text_overlap" and found[1]["confidence"] >= 0.5
    assert found[3]["basis"] == "text_overlap_only" and found[3]["confidence"] <= 0.65


def plain_attribution(events, amendments, top):
    """Tokens of all rows of an id count together, sizes are those of a row."""
    token = lambda text: {w for w in words(text) if w not in T.LINEAGE_STOPWORDS}
    out = []
    for bill, event, text in events:
        seen = []
        for other, amendment, search in amendments:
            if bill != other:
                continue
            shared = sum(
                len(token(t) & token(s)) for b, e, t in events if (b, e) == (bill, event)
                for c, a, s in amendments if (c, a) == (bill, amendment)
            )
            overlap = shared / max(1, min(len(token(text)), len(token(search))))
            if shared and overlap >= 0.25:
                seen.append((-round(min(0.65, overlap + 0.35), 9), amendment, round(overlap, 4)))
        out += [(bill, event, a, o) for _, a, o in seen]
    if top is None:
        return sorted(out)
    kept = []
    for bill, event in {(b, e) for b, e, *_ in out}:
        mine = sorted((-round(min(0.65, o + 0.35), 9), a, o) for b, e, a, o in out if (b, e) == (bill, event))
        kept += [(bill, event, a, o) for _, a, o in mine[:top]]
    return sorted(kept)


def test_attribution_compares_pairs_within_the_bill(spark):
    pool = "bridge lane asphalt culvert gravel paving drain curb sidewalk signal".split()
    line = lambda seed, n: " ".join(pool[(seed * 7 + k * k + k) % 10] for k in range(n))
    events = [(b, b * 100 + i, line(b + i, 3 + i % 4)) for b in (1, 2, 3) for i in range(12)] + [(None, 1, "bridge"), (1, None, "bridge")]
    amendments = [(b, b * 1000 + i, line(b * 3 + i, 2 + i % 3)) for b in (1, 2, 4) for i in range(9)] + [(2, None, "bridge lane")]
    twice = [(1, 103, "bridge lane"), (2, 1001, "gravel drain")], [(1, 1004, "bridge curb")]

    def frames(e, a):
        nothing = F.lit(None).cast("date")
        return (
            spark.createDataFrame(e, "bill_id long, event_id long, new_text string").withColumns({"from_day": nothing, "to_day": nothing}),
            spark.createDataFrame(a, "bill_id long, amendment_id long, search_text string").withColumn("amendment_day", nothing),
        )

    def found(e, a, **how):
        rows = lineage.attribute(*frames(e, a), **how).collect()
        return sorted((r["bill_id"], r["event_id"], r["amendment_id"], r["token_overlap"]) for r in rows)

    whole = lambda rows: [r for r in rows if r[0] and r[1]]
    for top in (None, 4):
        expected = plain_attribution(whole(events), whole(amendments), top)
        assert expected
        assert found(events, amendments, top=top) == expected
        # Crowded bills are compared slice by slice.
        assert found(events, amendments, top=top, pairs_per_task=10) == expected
    again = events + twice[0][:1], amendments + twice[1]
    assert found(*again, top=None) == plain_attribution(whole(again[0]), whole(again[1]), None)


def test_attribution_shuffles_token_sets_and_no_pairs(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        day = F.current_date()
        events = spark.range(40).select((F.col("id") % 4).alias("bill_id"), F.col("id").alias("event_id"), day.alias("from_day"), day.alias("to_day"), F.lit("bridge lane").alias("new_text"))
        amendments = spark.range(20).select((F.col("id") % 4).alias("bill_id"), F.col("id").alias("amendment_id"), day.alias("amendment_day"), F.lit("lane").alias("search_text"))
        rows = lineage.attribute(events, amendments)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(bill_id") == plan.count("Exchange ") == 2


def words(text):
    import re

    found = re.findall(r"\b[A-Za-z][A-Za-z0-9'-]{2,}\b", text)
    return [w.lower() for w in found if w.lower() not in T.SCOPE_STOPWORDS]


def test_scope_matches_pairwise_cosine(spark):
    topics = ["road bridge highway asphalt lane", "road bridge traffic signal lane", "road highway lane curb paving",
              "school pupil teacher lesson desk", "road bridge lane gravel drain", "fish whale ocean coral reef"]
    texts = [" ".join(f"{w} {w}s {w}ing" for w in t.split() * 4) for t in topics]
    rows = [(1, i, str(i + 1), "Heading", t) for i, t in enumerate(texts)]
    sections = spark.createDataFrame(
        rows, "bill_id long, section_id long, section_number string, heading string, section_text string"
    )
    bills = spark.createDataFrame([(1, "Relating to road bridge repair", "lane")], "bill_id long, title string, scope_text string")
    counts = [Counter(words("Heading " + t)) for t in texts]
    anchor = Counter(words("Relating to road bridge repair lane"))
    df = Counter(term for c in counts + [anchor] for term in c)
    n = len(counts) + 1
    weigh = lambda c: {t: f / sum(c.values()) * (math.log((1 + n) / (1 + df[t])) + 1) for t, f in c.items()}
    vectors, anchored = [weigh(c) for c in counts], weigh(anchor)

    def cosine(a, b):
        dot = sum(v * b.get(t, 0) for t, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values())) / math.sqrt(sum(v * v for v in b.values()))

    def centroid(skip):
        out = defaultdict(float)
        for i, v in enumerate(vectors):
            if i != skip:
                for t, w in v.items():
                    out[t] += w
        return out

    peers = [cosine(v, centroid(i)) for i, v in enumerate(vectors)]
    near = [cosine(v, anchored) for v in vectors]
    at = (len(peers) - 1) * 0.25
    low, high = sorted(peers)[math.floor(at)], sorted(peers)[math.ceil(at)]
    cutoff = min(0.20, low + (high - low) * (at - math.floor(at)))
    expected = {i for i in range(6) if peers[i] <= cutoff + 1e-9 and near[i] <= 0.12}
    found = {r["section_id"]: r for r in scope.scope_outliers(sections, bills).collect()}
    assert set(found) == expected and 5 in found
    for i, row in found.items():
        assert abs(row["peer_similarity"] - peers[i]) < 1e-4
        assert abs(row["anchor_similarity"] - near[i]) < 1e-4


def test_scope_needs_four_sections(spark):
    rows = [(1, i, str(i), "h", " ".join(f"word{i}{j} thing" for j in range(40))) for i in range(3)]
    sections = spark.createDataFrame(
        rows, "bill_id long, section_id long, section_number string, heading string, section_text string"
    )
    bills = spark.createDataFrame([(1, "x", "")], "bill_id long, title string, scope_text string")
    assert scope.scope_outliers(sections, bills).isEmpty()


def test_scope_sends_words_once_and_deals_out_crowded_bills(spark):
    """Two shuffles of words at most, none of them by word, and the same scores where a bill is dealt out by word."""
    rows = [(b, b * 10 + i, str(i + 1), "h", " ".join(f"word{(i * j + b) % 23} thing{i} thing{j % 5}" for j in range(30))) for b in (1, 2, 3) for i in range(5)]
    rows.append(rows[-1])
    sections = spark.createDataFrame(rows, "bill_id long, section_id long, section_number string, heading string, section_text string")
    bills = spark.createDataFrame([(1, "word1 word2", "thing1"), (2, "other", None), (2, "other word3 word4", "x")], "bill_id long, title string, scope_text string")
    held, sizes = scope._terms(sections, bills)
    whole = sorted(scope.similarities(held, sizes).collect())
    assert len(whole) == 15 and whole == sorted(scope.similarities(held, sizes, words_per_task=460).collect())
    assert sizes.filter("words > 460").count() not in (0, 3)
    plan = scope._dealt(held, sizes)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bill_id" in plan and "term" not in "".join(re.findall(r"hashpartitioning\((.*?)\)", plan))


def small_tables(spark, folder):
    """Three bills of three versions, of which one order and one line are repeated."""
    day = lambda n: f"DATE '1995-01-0{n}'"
    spark.sql("SELECT 1 AS r_regionkey, 'ASIA' AS r_name").write.parquet(f"{folder}/region.parquet")
    spark.sql("SELECT 1 AS n_nationkey, 1 AS n_regionkey").write.parquet(f"{folder}/nation.parquet")
    spark.sql("SELECT id AS s_suppkey, 1 AS s_nationkey FROM range(2)").write.parquet(f"{folder}/supplier.parquet")
    spark.sql("SELECT id AS p_partkey, 'part ' || id AS p_name, 'Brand' || id AS p_brand, 'LARGE' AS p_type FROM range(3)").write.parquet(f"{folder}/part.parquet")
    orders = " UNION ALL ".join(
        f"SELECT CAST({c * 10 + v} AS BIGINT) AS o_orderkey, CAST({c} AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, '{'5-LOW' if c == v else '1-URGENT'}' AS o_orderpriority, {day(4 - v)} AS o_orderdate"
        for c in (1, 2, 3) for v in (1, 2, 3, 3)[:4 if c == 3 else 3]
    )
    spark.sql(orders).write.parquet(f"{folder}/orders.parquet")
    lines = f"""SELECT o_orderkey AS l_orderkey, n.id AS l_linenumber, n.id % 3 AS l_partkey, n.id % 2 AS l_suppkey, 10.5D AS l_extendedprice, {day(1)} AS l_shipdate,
      'A' AS l_returnflag, 'F' AS l_linestatus, 3.0D AS l_quantity FROM (SELECT DISTINCT o_orderkey FROM ({orders})) CROSS JOIN range(3) AS n"""
    spark.sql(f"{lines} UNION ALL SELECT * FROM ({lines}) WHERE l_orderkey = 11 AND l_linenumber = 1").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_latest_sections_and_texts_join_only_lines_of_latest_versions(spark, tmp_path):
    from driver import base, corpus

    sf_dir = small_tables(spark, tmp_path)
    newest = base.view(spark, sf_dir, corpus.LATEST).select("version_id")
    plain = base.view(spark, sf_dir, corpus.SECTIONS).join(newest, "version_id", "left_semi")
    found = corpus.latest_sections(spark, sf_dir)
    assert plain.count() > 9 and sorted(found.select(plain.columns).collect()) == sorted(plain.collect())
    texts = corpus.versions(spark, sf_dir).join(newest, "version_id", "left_semi")
    latest = corpus.latest_versions(spark, sf_dir)
    assert sorted(latest.select("version_id", "text").collect()) == sorted(texts.select("version_id", "text").collect())
    for rows in (found, latest):
        joins = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = lambda word: max(line.index(word) for line in joins if word in line)
        assert depth("LeftSemi") > depth("Join Inner")


def test_lines_are_numbered_before_their_texts_are_written_out(spark, tmp_path):
    from driver import base, corpus

    sf_dir = small_tables(spark, tmp_path)
    plain, found = base.view(spark, sf_dir, corpus.SECTIONS), corpus.sections(spark, sf_dir)
    assert sorted(found.collect()) == sorted(plain.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("The department shall award") < plan.index("Window")


def test_agenda_lines_are_numbered_first_and_stored_items_hold_no_hash(spark, tmp_path):
    from driver import base, civic_queries

    sf_dir = small_tables(spark, tmp_path)
    plain, found = base.view(spark, sf_dir, civic_queries.CIVIC_LINES), base.view(spark, sf_dir, civic_queries.READ_LINES)
    assert plain.count() == 28 and sorted(found.collect()) == sorted(plain.select(found.columns).collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Consent Agenda") < plan.index("Window")
    assert "evidence_hash" not in civic_queries.stored_items(civic_queries.agendas(spark, sf_dir)).columns


def test_section_changes_send_hashes_as_bytes(spark):
    sections = spark.createDataFrame([(1, "1", 0, "a"), (2, "1", 0, "b")], "version_id long, section_number string, ordinal int, section_text string")
    pairs = spark.createDataFrame([(1, 1, None), (1, 2, 1)], "bill_id long, version_id long, from_version_id long")
    changes = lineage.section_changes(sections, pairs)
    found = {r["version_id"]: (r["event_type"], r["new_sha"]) for r in changes.collect()}
    assert found == {v: (kind, hashlib.sha256(t.encode()).hexdigest()) for v, kind, t in ((1, "introduced", "a"), (2, "modified", "b"))}
    assert "unhex(sha2" in changes._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_are_worked_out_once_to_choose_candidates(spark):
    """A filter repeats an expression as often as it names it, pair by pair."""
    side = "bill_id long, words array<long>, "
    left = spark.createDataFrame([(1, [1, 2, 3, 4], 7, None, None, 4)], side + "event_id long, from_day date, to_day date, left_size int")
    right = spark.createDataFrame([(1, [4, 5], 8, None, 2), (1, [9], 9, None, 1)], side + "amendment_id long, amendment_day date, right_size int")
    met = lineage._met_by_bill(left, right, ["bill_id"])
    assert [(r["event_id"], r["amendment_id"], r["shared"]) for r in met.collect()] == [(7, 8, 1)]
    # Once to choose a pair, once to show it.
    assert met._jdf.queryExecution().optimizedPlan().toString().count("array_intersect(") == 2


def test_documents_are_scanned_on_all_cores(spark, tmp_path):
    """Orders come in one file; the rows are spread before their texts are written out and scanned."""
    from driver import base, corpus

    spark.range(40).selectExpr(
        "id AS o_orderkey", "id % 3 AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "TIMESTAMP'2000-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority"
    ).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = base.view(spark, str(tmp_path), corpus.DOCUMENTS, slow="orders")
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert rows.count() == 40 and sorted(rows.columns) == sorted(base.view(spark, str(tmp_path), corpus.DOCUMENTS).columns)
