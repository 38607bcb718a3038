from pyspark.sql import functions as F

from ledgerline.operators import history, ordered
from ledgerline.plans import listing, packets


def rows(spark):
    """One key holds a third of all rows."""
    return spark.range(1200).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 11 == 0, F.col("id").cast("string")).alias("v"),
        (F.col("id") % 50).alias("slot"),
    )


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hot_keys_are_sliced_without_changing_results(spark):
    df = rows(spark)
    for order in (["id"], ["slot", "id"]):
        assert same(
            ordered.positions(df, ["k"], order, "p", 60), ordered.positions(df, ["k"], order, "p")
        )
        assert same(
            ordered.previous(df, ["k"], order, {"pid": "id", "pv": "v"}, 60),
            ordered.previous(df, ["k"], order, {"pid": "id", "pv": "v"}),
        )
        assert same(
            ordered.carry_forward(df, ["k"], order, "v", "c", 60),
            ordered.carry_forward(df, ["k"], order, "v", "c"),
        )


def test_a_constant_first_column_is_sliced_too(spark):
    df = rows(spark).withColumn("same", F.lit(0)).withColumn("name", F.sha2(F.col("id").cast("string"), 256))
    order = ["same", F.col("name").desc(), "id"]
    assert same(ordered.positions(df, ["k"], order, "p", 60), ordered.positions(df, ["k"], order, "p"))
    hot = ordered._hot_keys(df, ["k"], 60)
    by_order = [F.col("same").asc(), F.col("name").desc(), F.col("id").asc()]
    slices = ordered._sliced(df, ["k"], hot, by_order).groupBy("k", "_slice").count().collect()
    assert max(r["count"] for r in slices) < 150 and sum(r["k"] == 0 for r in slices) >= 5


def test_hot_timelines_and_packets_are_numbered_in_slices(spark, monkeypatch):
    sponsors = spark.range(600).select((F.col("id") % 3 % 2).alias("bill_id"), F.lit("sponsor").alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("full_name"), F.col("id").alias("seq"))
    actions = spark.range(50).select(F.lit(0).cast("long").alias("bill_id"), F.lit("2024-01-02").alias("action_date"), F.lit("t").alias("text"), F.col("id").alias("action_id"))
    amendments = spark.range(300).select(F.lit(1).cast("long").alias("bill_id"), F.lit(None).cast("string").alias("amendment_date"), F.lit("s").alias("search_text"), F.col("id").alias("amendment_id"))
    entries = spark.range(500).select(F.lit(1).alias("section_id"), F.lit("Q").alias("prefix"), F.lit(0.0).alias("_o1"), F.lit("same").alias("_o2"), F.sha2(F.col("id").cast("string"), 256).alias("_o3"))
    plain = listing.timeline(actions, sponsors, amendments).collect(), packets.numbered([entries]).collect()
    positions = ordered.positions
    monkeypatch.setattr(ordered, "positions", lambda df, keys, order, name: positions(df, keys, order, name, 40))
    sliced = listing.timeline(actions, sponsors, amendments), packets.numbered([entries])
    assert sorted(sliced[0].collect()) == sorted(plain[0])
    assert sliced[1].select("place").distinct().count() == 500 == len(plain[1])


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = ordered.first_rows(rows(spark), ["k"], [F.col("id").desc()], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert df.count() == 21


def test_revisions_return_to_an_earlier_text(spark):
    seen = spark.createDataFrame(
        [(1, i, i, s) for i, s in enumerate("AABAB")], "doc long, at long, seq long, sha256 string"
    )
    log = history.revision_log(seen, ["doc"], ["at", "seq"]).orderBy("seq")
    assert [r["sha256"] for r in log.collect()] == ["A", "B", "A", "B"]
    assert history.revision_log(seen, ["doc"], ["at", "seq"], distinct_hash=True).count() == 2


def test_entities_merge_maps_per_key(spark):
    mentions = spark.createDataFrame(
        [
            ("person", "Ann  Lee", {"bioguide": "A1"}, {"party": "X", "state": "TX"}, 1),
            ("person", "ANN LEE", {"fec_candidate_id": "P9"}, {"party": "Y"}, 2),
        ],
        "entity_type string, name string, external_ids map<string,string>, metadata map<string,string>, seq long",
    )
    node = history.merge_entities(mentions).first()
    assert node["canonical_name"] == "Ann  Lee"
    assert node["external_ids"] == {"bioguide": "A1", "fec_candidate_id": "P9"}
    assert node["metadata"] == {"party": "Y", "state": "TX"}
