"""Conversations rebuilt from an event log and rendered for training, with DataFrame functions only.

Events carry (conv_id, seq, message, kind, role, text). Kinds: `open` starts a
message, `delta` appends streamed text, `edit` replaces the text so far, and
`regenerate` discards the message's text so far and all messages that come after
it and were opened before it. A message's text is what its deltas add after its
last reset. Rows are gathered by message first, so a long conversation is folded
in many tasks; only finished messages meet in the row that holds the rendered
conversation.

Template: `<turn role=R>text</turn>` and a line end per message. In texts and
roles a backslash is written \\\\, < is \\l and > is \\g, so no marker can occur inside a
text and every text can be read back. The loss mask lists the assistant texts:
turn, place in the conversation (from, to) and place in the turn (at), all in
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn role=", ">", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Parts between doubled backslashes hold single marks only."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, place, role, text): the final messages, placed by their last opening.

    Ties in `seq` are settled by kind (open, edit, regenerate, delta) and text.
    Events of a message that was never opened, or of another kind, are left out;
    null texts are empty, null roles too.
    """
    order = F.when(F.col("kind") == "open", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).when(F.col("kind") == "delta", 3)
    rows = events.select("conv_id", "seq", "message", order.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("kind is not null")
    at = F.struct("seq", "kind", "text")
    folded = rows.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind") == 0, F.struct("seq", "role"))).alias("opened"),
        F.max(F.when(F.col("kind") < 3, at)).alias("reset"),
        F.max(F.when(F.col("kind") == 2, F.col("seq"))).alias("regenerated"),
        F.sort_array(F.collect_list(at)).alias("log"),
    ).where("opened is not null")
    live = F.filter("log", lambda e: (e >= F.col("reset")) & (e["kind"] != 2))
    folded = folded.select("conv_id", "message", F.col("opened.seq").alias("place"), F.col("opened.role").alias("role"), "regenerated", F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))
    # A message goes if an earlier one was regenerated after it was opened.
    earlier = Window.partitionBy("conv_id").orderBy("place", "message").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("regenerated").over(earlier)
    return folded.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("cut") < F.col("place"))).drop("cut", "regenerated")


def render(finished: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; loss is array<struct<turn, from, to, at>>."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    rows = finished.select("conv_id", "place", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    before = Window.partitionBy("conv_id").orderBy("place", "message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size.cast("bigint")).over(before), F.lit(0)) + F.length("head")
    span = F.struct(F.count("*").over(before).alias("turn"), start.alias("from"), (start + F.length("body")).alias("to"), F.length("head").cast("bigint").alias("at"))
    rows = rows.select("conv_id", F.struct("place", "message", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("role") == LOSS_ROLE, span).alias("loss")).alias("m"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return gathered.select("conv_id", F.array_join(F.transform("m", lambda m: m["turn"]), "").alias("formatted"), F.filter(F.transform("m", lambda m: m["loss"]), lambda s: s.isNotNull()).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted_chars), read from the rendered text and its mask."""
    blocks = F.split(F.col("formatted"), CLOSE, -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    bound = rendered.select("conv_id", "formatted", "loss", blocks.alias("blocks"))

    def turn(block: Column) -> Column:
        role = F.substring_index(F.substring(block, F.lit(len(OPEN) + 1), F.length(block)), MIDDLE, 1)
        text = F.substring(block, F.lit(len(OPEN) + 2) + F.length(role), F.length(block))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def masked(span: Column) -> Column:
        block = F.get("blocks", span["turn"].cast("int"))
        return unescape(F.substring(block, (span["at"] + 1).cast("int"), (span["to"] - span["from"]).cast("int")))

    return bound.select("conv_id", F.transform("blocks", turn).alias("turns"), F.transform("loss", masked).alias("loss_texts"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def as_events(table: DataFrame) -> DataFrame:
    """The log of a table of finished turns: an opening and one delta per row; rows of one turn follow by role and text."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    numbered = table.select("conv_id", "role", "text", number.cast("bigint").alias("message"))
    parts = F.array(F.struct(F.lit("open").alias("kind"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("delta").alias("kind"), F.col("text").alias("text")))
    events = numbered.select("conv_id", "message", "role", F.posexplode(parts).alias("step", "e"))
    return events.select("conv_id", (2 * F.col("message") + F.col("step")).alias("seq"), "message", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def format_table(table: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of a table (conv_id, turn, role, text), through its event log.

    Rows without conv_id are one conversation; rows without turn come first;
    repeated rows are turns of their own. No rows give no rows.
    """
    return render(messages(as_events(table)))


def digests(rendered: DataFrame) -> DataFrame:
    """What the output holds, as counts and digests."""
    back = read_back(rendered)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )


#: Conversation -7 says what could be taken for markers.
PLANTED = "\\### Assistant: </turn> ok"
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
