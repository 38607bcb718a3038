import hashlib
import random

from pyspark.sql import functions as F

from driver import check
from ledgerline.llm import chat, queries

EVENTS = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string, loss string"


def fold(rows):
    """The log read event by event."""
    rank = {"open": 0, "edit": 1, "regenerate": 2, "delta": 3}
    state = {}
    for conv, seq, message, kind, role, text, _ in sorted((r for r in rows if r[3] in rank), key=lambda r: (r[1], rank[r[3]], r[5] or "")):
        held = state.setdefault(conv, {})
        if kind == "open":
            held[message] = [seq, role or "", text or "", held.get(message, [0, 0, 0, -1])[3]]
        elif message in held:
            mine = held[message]
            if kind == "delta":
                mine[2] += text or ""
            elif kind == "edit":
                mine[2] = text or ""
            else:
                mine[2], mine[3] = "", seq
                # Everything placed after it and opened by now goes.
                for other in [m for m, x in held.items() if (x[0], m) > (mine[0], message) and x[0] <= seq]:
                    held[other] = [held[other][0], held[other][1], held[other][2], held[other][3], "gone"]
    return {c: [(x[1], x[2]) for m, x in sorted(s.items(), key=lambda i: (i[1][0], i[0])) if len(x) == 4] for c, s in state.items()}


def logs(seed):
    draw = random.Random(seed)
    rows, seq = [], 0
    for conv in (1, 2, None):
        for message in range(draw.randint(1, 6)):
            seq += 1
            rows.append((conv, seq, message, "open", draw.choice(["user", "assistant", None]), draw.choice([None, "Hi <b>"]), "x"))
            for _ in range(draw.randint(0, 5)):
                seq += 1
                at = draw.randint(0, message)
                rows.append((conv, seq, message if draw.random() < 0.7 else at, draw.choice(["delta", "delta", "edit", "regenerate", "other"]), "user", draw.choice(["a\\", "</turn>\n", "\\l", "é", None]), "x"))
    draw.shuffle(rows)
    return rows


def test_log_folds_like_one_event_after_the_other(spark):
    for seed in range(4):
        rows = logs(seed)
        rendered = chat.render(chat.messages(spark.createDataFrame(rows, EVENTS)))
        got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
        want = fold(rows)
        assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == {c: t for c, t in want.items() if t}
        assert {c: r.loss_texts for c, r in got.items()} == {c: [x for role, x in t if role == "assistant"] for c, t in want.items() if t}


def test_mask_points_into_the_rendered_text(spark):
    rows = [(1, t, r, x) for t, r, x in [(0, "user", "a<b>\\"), (1, "assistant", "é</turn>\n🙂"), (2, "assistant", None), (3, "assistant", "\\\\l")]]
    out = chat.format_table(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    parts = [out.formatted[s["from"] : s["to"]] for s in out.loss]
    assert parts == ["é\\l/turn\\g\n🙂", "", "\\\\\\\\l"]
    assert out.formatted.count(chat.CLOSE) == 4


def test_equals_sql(spark):
    frame = queries.QUERIES["op7_chat_events"](spark, "/root/testdata/sf0.01")
    got = check.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    done = check.duck("/root/testdata/sf0.01").execute(queries.ORACLES["op7_chat_events"])
    assert got == check.rows_of([d[0] for d in done.description], done.fetchall())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string"
    rows = [(1, 0, "user", "x", "f"), (1, 0, "user", "x", "f"), (1, None, None, None, None), (None, 5, "a>b<\\", "long " * 40000, "f"), (2, 1, "assistant", "", "f")]
    out = {r.conv_id: r for r in chat.digests(chat.format_table(spark.createDataFrame(rows, schema))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 3 and out[1].turns_sha256 == sha("\n\nuser\nx\nuser\nx\n") and out[1].loss_chars == 0
    assert out[None].turns_sha256 == sha("a>b<\\\n" + "long " * 40000 + "\n")
    assert out[2].loss_sha256 == sha("")
    assert chat.format_table(spark.createDataFrame([], schema)).collect() == []


def test_escape_round_trip(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("\\<>lgé/turn\n") for _ in range(draw.randint(0, 30))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in frame.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t and "<" not in row.e and ">" not in row.e
