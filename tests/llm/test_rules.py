import collections
import random
import re

import pytest

from driver import check
from ledgerline.llm import queries, rules

SCHEMA = "doc_id bigint, text string, source string, host string, kept boolean"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered)


def test_measures_equal_brute_force():
    draw = random.Random(2)
    pieces = ["a", "bé", "漢字", "***", " ", "  ", "\n", "\t", "a a a a a a", "\x0b", "same line\n", "x&y", "\x1c", " ", "\xa0"]
    for _ in range(600):
        text = "".join(draw.choice(pieces) + draw.choice(["", " "]) for _ in range(draw.randint(0, 40)))
        assert rules.measures(text.encode()) == brute(text), repr(text)


def test_equals_sql(spark):
    frame = queries.QUERIES["op4_host_rules"](spark, "/root/testdata/sf0.01")
    got = check.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    done = check.duck("/root/testdata/sf0.01").execute(queries.ORACLES["op4_host_rules"])
    want = check.rows_of([d[0] for d in done.description], done.fetchall())
    assert got == want and len(got[1]) == 1000


@pytest.fixture(scope="module")
def judged(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good, "fine", "x", True) for i in range(40)] + [(100 + i, "short" if i else good, "bad", "x", True) for i in range(40)]
    rows += [(200, "short", "small", "x", True), (201, good, "small", None, None), (202, good, None, "x", True), (203, None, None, "x", True), (204, "", "fine", "x", True), (None, "w " * 100000, "fine", "x", True), (205, good, "fine", "x", True), (205, good, "fine", "x", True)]
    return rules.host_rules(spark.createDataFrame(rows, SCHEMA)).collect()


def test_host_verdicts(judged):
    by = collections.defaultdict(list)
    for r in judged:
        by[r.doc_id].append(r)
    assert all(by[i][0].kept for i in range(40))
    assert not by[100][0].base_failed and not by[100][0].kept and by[100][0].host_rate > 0.5  # a good text of a bad host
    assert by[202][0].kept and by[202][0].host_rate is None
    assert by[203][0].base_failed and by[204][0].base_failed and by[None][0].base_failed
    assert len(by[205]) == 2
    assert 0.0 < by[0][0].host_rate < 0.5 < by[101][0].host_rate < 1


def test_no_rows(spark):
    assert rules.host_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rules.host_rules(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).first().kept is False
