import pytest
from pyspark.sql import functions as F

from ledgerline.functions import rules as R
from ledgerline.functions import text as T
from ledgerline.operators import classify, entities, facts, scan, sections


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("x")).first()["x"]


def test_money_texts(spark):
    cases = {"$50 million": 5e7, "$1.5 billion": 1.5e9, "$250,000": 250000.0, "none": None}
    for text, value in cases.items():
        assert one(spark, text, T.money_value(F.col("t"))) == value


def test_dates_in_text(spark):
    cases = {
        "Meeting 2026-02-30, moved to 3/4/2026": "2026-03-04",
        "On March 5, 2026": "2026-03-05",
        "x 2026/1/9": "2026-01-09",
        "in 1999-01-01": None,
    }
    for text, day in cases.items():
        assert one(spark, text, T.date_in_text(F.col("t")).cast("string")) == day


def test_names_fold_case_and_space(spark):
    assert one(spark, "  Foo   STRAßE ", T.normalize_name(F.col("t"))) == "foo strasse"


def test_all_matches_carry_offsets(spark):
    found = one(spark, "a1bb22c3", T.all_matches(F.col("t"), r"\d+"))
    assert [(m["start"], m["end"], m["text"]) for m in found] == [(1, 2, "1"), (4, 6, "22"), (7, 8, "3")]
    assert len(one(spark, "a1bb22c3", T.all_matches(F.col("t"), r"\d+", 2))) == 2
    assert one(spark, "none", T.all_matches(F.col("t"), r"\d+")) == []


def test_section_rules(spark):
    text = "Notwithstanding any other provision, $50 million goes to the School District."
    rows = spark.createDataFrame([(1, text)], "id long, section_text string")
    kinds = {r["kind"] for r in scan.section_findings(rows, ["id"]).collect()}
    assert kinds == {"money", "exemption", "named_geography"}


def test_sections_split_and_root(spark):
    rows = spark.createDataFrame(
        [(1, "Preamble\nSEC. 1. Short title\nText\n\nSECTION 2A. Other\nMore"), (2, "no marker")],
        "version_id long, text string",
    )
    found = sections.split_sections(rows).orderBy("version_id", "ordinal").collect()
    assert [(r["section_number"], r["heading"], r["section_text"]) for r in found] == [
        ("1", "Short title", "SEC. 1. Short title\nText"),
        ("2A", "Other", "SECTION 2A. Other\nMore"),
        ("ROOT", None, "no marker"),
    ]


def test_agenda_items(spark):
    text = (
        "I. Call to order\nC. Consent Agenda\nC1. Approve the contract with Foo LLC for roads\nmore\n"
        "Phone 123\nlost line\nD. Public Hearings\nD1. Consider a zoning change for 5 acres\n3. x"
    )
    rows = spark.createDataFrame([(1, text)], "doc long, text string")
    found = sections.agenda_items(rows, ["doc"]).orderBy("ordinal").collect()
    assert [(r["item_number"], r["agenda_section"]) for r in found] == [
        ("C", "Consent Agenda"), ("C1", "Consent Agenda"), ("D", "Public Hearings"), ("D1", "Public Hearings"),
    ]
    assert found[1]["item_text"].endswith("\nmore")


def test_agenda_keeps_whole_items_unless_a_bound_is_asked_for(spark):
    text = "1. Consider the annual budget\n" + "\n".join(f"line {i}" for i in range(60))
    rows = spark.createDataFrame([(1, text)], "doc long, text string")
    assert len(sections.agenda_items(rows, ["doc"]).first()["item_text"].split("\n")) == 61
    assert len(sections.agenda_items(rows, ["doc"], max_lines=30).first()["item_text"].split("\n")) == 30


def test_statuses_and_topics(spark):
    assert one(spark, "Signed by the Governor", classify.action_status(F.col("t"))) == "signed / enacted"
    assert one(spark, "Referred to Committee", classify.action_status(F.col("t"))) == "referred"
    assert one(spark, "Relating to school district tax", classify.bill_topic(F.col("t"), F.lit(""))) == "education"


def test_session_codes(spark):
    for raw in ("892", "89S2"):
        part = one(spark, raw, classify.session_parts(F.col("t")))
        assert (part["code"], part["number"], part["label"]) == ("892", 89, "89S2")
    assert one(spark, "abc", classify.session_parts(F.col("t")))["error"]


def test_attributes(spark):
    json = '{"OBJECTID":"5","ProjectName":"Plaza","PZDate":"1700000000000","council_note":"n","Empty":"null"}'
    attrs = facts.attributes(F.col("t"))
    assert one(spark, json, facts.attribute_text(attrs)) == "Project Name: Plaza\nP Z Date: 1700000000000\ncouncil note: n"
    assert str(one(spark, json, facts.event_date(attrs)["day"])) == "2023-11-14"


def test_routine_headings(spark):
    subject = T.heading_words(F.col("t"))
    assert one(spark, "1. Call to Order", classify.routine_subject(subject))
    assert one(spark, "A. Approve the regular meeting minutes", classify.routine_subject(subject))
    assert not one(spark, "2. Approve the minutes contract", classify.routine_subject(subject))


def test_rule_packs_are_data():
    assert len(R.SECTION_RULES) == 6 and len(R.FISCAL_RULES) == 7 and len(R.CIVIC_SIGNALS) == 10


def test_word_search_finds_whatever_the_patterns_find(spark):
    """Every character that a pattern takes for a Latin letter is found by the word search as well."""
    import random

    draw = random.Random(8)
    alike = {"i": "iIİı", "s": "sSſ", "k": "kKK"}
    wild = [chr(c) for c in range(0x80, 0x2200) if chr(c).isalpha()]
    rows = []
    for _ in range(400):
        word = "".join(draw.choice(alike.get(c, c + c.upper())) for c in draw.choice(["municipality", "risk", "assistance"]))
        rows.append((" ".join([draw.choice(wild) * 2, word, draw.choice(wild)]),))
    rows += [(f"muni{c}ipality r{c}sk ri{c}k ris{c} a{c}sistance",) for c in wild]
    for word in ("municipality", "risk", "assistance"):
        hit = F.col("t").rlike(T.flagged(rf"\b{word}\b"))
        missed = spark.createDataFrame(rows, "t string").filter(hit & ~T.holds(T.searchable(F.col("t")), [word]))
        assert missed.collect() == []


ODD = [
    "", "District", "a DiStrict of ſuch", "Countywide county \U0001f600 District of X", "\U0001f600É town OF b́", None,
    "\u0001County\u0001 of", "no word", "districtDistrict district\n.District", "  Parish \x1c\x85 ", "İCity of İ city of",
]


@pytest.mark.parametrize("words", [("district", "county", "parish", "city of", "town of"), ("district",)])
def test_searches_from_the_first_word_on_find_what_whole_searches_find(spark, words):
    pattern = T.flagged(r"\b(?:" + "|".join(words) + r")\b")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    t = F.col("t")
    low = T.searchable(t)
    got = rows.select(
        "i", T.first_match(t, pattern).alias("f"), T.first_opened(t, low, pattern, words).alias("o"),
        T.all_matches(t, pattern).alias("a"), T.all_opened(t, low, pattern, words).alias("b"), T.all_matches(t, pattern, 1).alias("c"),
        F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hits"), F.split(t, pattern, -1).alias("gaps"),
        T.strip(t).alias("s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("s2"),
    ).collect()
    for row in got:
        at, want = 0, []
        for gap, hit in zip(row["gaps"] or [], row["hits"] or []):
            want.append((at + len(gap), at + len(gap) + len(hit), hit))
            at += len(gap) + len(hit)
        assert [tuple(m) for m in row["a"]] == want == [tuple(m) for m in row["b"]]
        assert [tuple(m) for m in row["c"]] == want[:1]
        first = want[0][:2] if want else None
        assert (row["f"] and tuple(row["f"])) == first == (row["o"] and tuple(row["o"]))
        assert row["s"] == row["s2"]


@pytest.mark.parametrize("rule", [r for r in [*R.SECTION_RULES, *R.FISCAL_RULES] if r.opens], ids=lambda r: r.kind)
def test_patterns_that_open_with_their_words_do_so(rule):
    """Every alternative of the pattern's head starts with one of the words."""
    words = sorted(rule.needs)
    head = rule.pattern.removeprefix(r"\b")
    head = head[3:head.index(")\\b")] if head.startswith("(?:") else head
    depth, parts = 0, [""]
    for c in head:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    for part in parts:
        plain = part.lower().replace("(?:", "")
        assert any(plain.startswith(w) or w.startswith(plain) for w in words), part


def test_patterns_are_not_compiled_for_every_text(spark):
    """A split compiles its pattern for every row; only texts that hold the mark are split by it."""
    import time

    words = [f"word{i}[a-z]{{1,9}}" for i in range(300)]
    pattern = T.flagged(r"\b(?:" + "|".join(words) + r")\b")
    rows = spark.range(0, 40000, 1, 1).select(F.concat(F.lit("word1abc "), F.col("id").cast("string")).alias("t"))
    count = lambda df: df.agg(F.sum("n")).collect()
    new = rows.select(T.first_match(F.col("t"), pattern)["end"].alias("n"))
    old = rows.select(F.length(F.get(F.split("t", pattern, 2), F.lit(1))).alias("n"))
    took = []
    for df in (new, old):
        count(df)
        started = time.time()
        count(df)
        took.append(time.time() - started)
    assert took[0] < took[1]


def test_beneficiary_classes_are_those_of_their_patterns(spark):
    text = (
        "Eligible recipients, an eligible recipient and ELIGIBLE entities; Tribal governments, tribal law, trade Associations; "
        "institutions of higher education, nonprofit organizationſ, \U0001f600 small Businesses, producers' manufacturer"
    )
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, section_text string")
    got = {(m["k"], m["start"], m["name"]) for m in entities.section_mentions(rows, ["k"]).filter("entity_type = 'beneficiary_class'").collect()}
    want = set()
    for pattern in R.BENEFICIARY_PATTERNS:
        for m in rows.select("k", F.explode(T.all_matches(F.col("section_text"), T.flagged(pattern))).alias("m")).collect():
            want.add((m["k"], m["m"]["start"], m["m"]["text"]))
    assert got == want and len(got) == 9


def test_texts_of_ascii_characters_are_searched_without_unicode_classes(spark):
    """Characters that Unicode and ASCII classes tell apart do not occur in them; other texts keep the wide classes."""
    import re

    texts = [
        "The Small business of O'Neil-Smith, not_a_word 9lives ab abc's x-ray THE", "Ein Größe-Test: naïve cafés, the KELVIN \u212aelvin \u0130stanbul small business",
        "", None, "a\x1cb small\x0bbusiness small business\x85producers", "the the The word Word wOrd", "\u00a0small businesses\u2003producers",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for pattern, needs in zip(R.BENEFICIARY_PATTERNS, R.BENEFICIARY_NEEDS, strict=True):
        found = T.let(T.searchable(F.col("t")), lambda low: T.all_opened(F.col("t"), low, T.flagged(pattern), needs))  # noqa: B023
        for r in rows.select(found.alias("a"), T.all_matches(F.col("t"), T.flagged(pattern)).alias("b")).filter("t IS NOT NULL").collect():
            assert r["a"] == r["b"]
    assert all(re.match(r"\(\?i?s?d\)", T._plain(T.flagged(rule.pattern, rule.flags))) for rule in [*R.SECTION_RULES, *R.FISCAL_RULES])
    shown = str(T.all_opened(F.col("t"), F.lower("t"), T.flagged("small"), ("small",)))
    assert "(?id)small" in shown and "(?iUd)small" in shown
