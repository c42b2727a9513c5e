"""Event-sourced chat reconstruction and formatting, in DataFrame functions only.

A log has events (conversation, message, seq, kind, role, content). Per message the last resetting event
(`message` and `edit` carry the whole text, `regenerate` empties it) is found by a partial aggregate; the
deltas after it are appended in the order of seq. Superseded deltas are dropped before anything is
collected, so what meets in one task is never more than the final text of one message, and then the
messages of one conversation, which is one value of the output.

The template is `<turn ROLE>\\nTEXT</turn>\\n`. In roles and texts the characters \\ < > # become \\b \\l \\g \\h,
so no control string can occur inside them, and the escaping is undone exactly.

Edge cases: null role or content counts as empty; events of equal seq are ordered by kind, role and content;
repeated rows stay separate messages in `turn_events`; unknown kinds are ignored; a message of deltas only starts
empty; a null conversation id is a conversation of its own; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h"))
_CLOSE = "</turn>\n"
RESETS = ("message", "edit", "regenerate")
PROBE_ID = -7
LAST_TURN = 1 << 59
PROBE_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, message_id, first_seq, role, text): the final state of every message of an event log."""
    kind = F.coalesce(F.col("kind"), F.lit(""))
    events = log.select("conv_id", "message_id", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content")).filter(F.col("kind").isin(*RESETS, "delta"))
    resets = F.when(F.col("kind").isin(*RESETS), F.struct("seq", "kind", "role", "content"))
    state = events.groupBy("conv_id", "message_id").agg(
        F.max(resets).alias("reset"),
        F.min("seq").alias("first_seq"),
        F.min(F.struct("seq", "kind", "role")).alias("opening"),
    )
    start = state.select(
        "conv_id",
        "message_id",
        "first_seq",
        F.coalesce(F.nullif(F.col("opening.role"), F.lit("")), F.col("reset.role"), F.lit("")).alias("role"),
        F.when(F.col("reset.kind") != "regenerate", F.col("reset.content")).otherwise(F.lit("")).alias("base"),
        F.col("reset.seq").alias("since"),
    )
    names = [F.col("conv_id").alias("_c"), F.col("message_id").alias("_m")]
    live = events.filter(F.col("kind") == "delta").select(*names, "seq", "content").join(
        start.select("conv_id", "message_id", "since"), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("message_id").eqNullSafe(F.col("_m"))
    ).filter(F.col("since").isNull() | (F.col("seq") > F.col("since")))
    tails = live.groupBy("_c", "_m").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x.content), "").alias("tail"))
    joined = start.join(tails, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("message_id").eqNullSafe(F.col("_m")), "left")
    return joined.select("conv_id", "message_id", "first_seq", "role", F.concat(F.coalesce("base", F.lit("")), F.coalesce("tail", F.lit(""))).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): one row per conversation; mask lists (start, chars) of assistant texts in formatted."""
    opening = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n"))
    turns = messages.select("conv_id", "first_seq", "role", "text", "message_id", opening.alias("opening"), escape(F.col("text")).alias("body"))
    whole = F.length("opening") + F.length("body") + len(_CLOSE)
    order = [F.col("first_seq"), F.col("role"), F.col("text"), F.col("message_id")]
    window = Window.partitionBy("conv_id").orderBy(*order)
    turns = turns.withColumn("place", F.row_number().over(window)).withColumn("end", F.sum(whole.cast("long")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("end") - len(_CLOSE) - F.length("body")
    piece = F.struct("place", F.concat("opening", "body", F.lit(_CLOSE)).alias("piece"), F.struct(begin.alias("start"), F.length("body").cast("long").alias("chars")).alias("span"), (F.col("role") == "assistant").alias("loss"))
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p.loss), lambda p: p.span).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): turns and the text under the mask, parsed from the output alone."""
    blocks = F.filter(F.split("formatted", _CLOSE, -1), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.struct(unescape(F.substring_index(F.substring(b, 7, 1 << 30), ">\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, ">\n") + 2, F.length(b))).alias("text")),
    )
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m.start + 1).cast("int"), m.chars.cast("int")))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def turn_events(table: DataFrame) -> DataFrame:
    """An event log of a table with one row per turn; rows of one turn become messages of their own."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = table.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("content"))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "content")
    return rows.select("conv_id", F.struct("turn", F.row_number().over(same).alias("copy")).alias("message_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "content")


def streamed_events(table: DataFrame) -> DataFrame:
    """A log as a chat service writes it, whose fold is the table with one row per turn.

    An assistant's turn starts to stream, is generated again and streamed in two parts; any other turn is sent as a draft and edited. Rows of one turn become
    messages of their own; a null turn comes last.
    """
    log = turn_events(table.withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN))))
    half = F.floor(F.length("content") / 2).cast("int")
    event = lambda step, kind, content: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), content.alias("content"))
    before, after = F.substring(F.col("content"), F.lit(1), half), F.substring(F.col("content"), half + 1, F.length("content"))
    streamed = F.array(event(0, "delta", after), event(1, "regenerate", F.lit("")), event(2, "delta", before), event(3, "delta", after))
    edited = F.array(event(0, "message", before), event(1, "edit", F.col("content")))
    steps = log.select("conv_id", "message_id", "seq", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return steps.select("conv_id", "message_id", (F.col("seq") * 4 + F.col("e.step")).alias("seq"), "e.kind", "role", "e.content")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    parsed = read_back(render(fold_events(streamed_events(table.unionByName(probe)))))
    story = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(story, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text) + 16
    + length(regexp_replace(role, '[^\\<>#]', '', 'g')) + length(regexp_replace(text, '[^\\<>#]', '', 'g')) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
