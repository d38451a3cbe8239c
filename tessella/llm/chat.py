"""Chat formatting from an event log.

Events are rows ``conv_id, seq, message, kind, role, text``. A ``delta`` adds
text to a message, an ``edit`` replaces it, and a ``regenerate`` starts the
message again and voids what was logged before for later messages. A message's
text so is its events from the last reset on, joined in order of ``seq``; the
resets of earlier messages reach it through a running maximum over the
conversation. All state is one exchange by conversation.

A turn renders as ``### role: text</turn>`` and a line end. Inside roles and
texts a backslash becomes ``\\0``, ``###`` becomes ``\\1``, ``</turn>`` becomes
``\\2``, and in roles ``:`` becomes ``\\3``. Every backslash of the output thus
starts an escape, so replacing the codes one after the other, ``\\0`` last,
restores any text.

Only DataFrame functions. Defined results: null texts and roles are empty; a
null conv_id is a conversation; an empty message stays a turn; events that tie
on ``seq`` follow kind, role and text; repeated rows count again; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "### ", "</turn>\n"
#: Fixed values of the template: what is escaped, and its code.
ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"))


def escape(text, table=ESCAPES):
    for raw, code in table:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text, table=ESCAPES):
    for raw, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Finished turns (``conv_id, turn, role, text``) as a log of one delta each, in order of turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select("conv_id", n.alias("seq"), n.alias("message"), F.lit("delta").alias("kind"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text``: the final messages of a log."""
    text = F.coalesce("text", F.lit(""))
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    messages = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(event)).alias("events"), at("regenerate").alias("regenerated"), at("edit").alias("edited")
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    messages = messages.withColumn("reset", F.greatest(F.max("regenerated").over(before), "edited"))
    live = F.filter("events", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    messages = messages.withColumn("events", live).where(F.size("events") > 0)
    return messages.select(
        "conv_id", "message", F.element_at("events", -1)["role"].alias("role"), F.array_join(F.transform("events", lambda e: e["text"]), "").alias("text")
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: the rendered conversation and the spans (start and
    length in characters) of the texts of the role to learn from."""
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    c = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"], ROLE_ESCAPES), F.lit(": "))
    c = c.withColumn("parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["role"] == learn).alias("learn"))))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(acc, p):
        start, n = acc["at"] + F.length(p["head"]), F.length(p["text"])
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(END)).alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return c.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", nothing, place)["spans"].alias("loss_spans"),
    )


def parse(formatted):
    """An array of ``role, text`` read back from a rendered conversation."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda p: F.substring_index(body(p), ": ", 1)
    rest = lambda p: F.substr(p, F.length(role(p)) + F.lit(len(START) + 3))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p), ROLE_ESCAPES).alias("role"), unescape(rest(p)).alias("text")))


def masked(formatted, spans):
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
