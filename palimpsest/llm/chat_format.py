"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is partitioned by conversation and message, sorted by sequence and folded into final messages, which
are then rendered into one training text per conversation with a loss mask.  Events:

* ``message`` begins a message with its text, ``delta`` appends to it, ``edit`` replaces what it says,
  ``regenerate`` throws it away so that the deltas after it stream it anew.

Template: ``<|role|>text<|end|>``.  Inside roles and texts ``\\``, ``<``, ``[`` and ``|`` become ``\\e``, ``\\l``, ``\\b`` and ``\\p``, so no
control string of this or a like template (``</s>``, ``[INST]``, ``<|end|>``) can stand in a text, and the escape can be
undone without doubt: no escaped text holds ``\\`` but before e, l, b or p.

Defined results: a null text or role counts as empty; a null sequence sorts first; a null conversation is one of its own;
events of one sequence are ordered by kind, role and text; repeated rows of kind ``message`` are messages each; an event
that finds no message begins one.  An empty log gives no rows.  Other columns of the log are ignored.

A conversation is rendered into one row, so its final messages meet in one task; its deltas are folded per message
before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"

#: What is escaped, in this order; undone in the opposite order.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, msg, seq, kind, role, text) to messages (conv_id, at, part, role, text).

    ``msg`` names the message that an event belongs to; ``at`` is the sequence of its first event and ``part`` numbers
    the messages that begin in it.
    """
    event = F.struct("seq", F.when(F.col("kind") == "message", 0).otherwise(1).alias("late"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("log"))

    def step(done: Column, e: Column) -> Column:
        # done: the messages before the last, the last one's role and its pieces of text
        begins = (e["kind"] == "message") | ~done["open"]
        before = F.when(begins & done["open"], F.concat(done["closed"], F.array(F.struct(done["role"].alias("role"), F.array_join(done["parts"], "").alias("text"))))).otherwise(done["closed"])
        parts = F.when(begins | (e["kind"] == "edit"), F.array(e["text"])).when(e["kind"] == "regenerate", F.array().cast("array<string>")).otherwise(F.concat(done["parts"], F.array(e["text"])))
        return F.struct(before.alias("closed"), F.when(begins, e["role"]).otherwise(done["role"]).alias("role"), parts.alias("parts"), F.lit(True).alias("open"))

    nothing = F.struct(
        F.array().cast("array<struct<role:string,text:string>>").alias("closed"), F.lit("").alias("role"), F.array().cast("array<string>").alias("parts"), F.lit(False).alias("open")
    )
    final = F.aggregate("log", nothing, step, lambda d: F.concat(d["closed"], F.array(F.struct(d["role"].alias("role"), F.array_join(d["parts"], "").alias("text")))))
    return grouped.select("conv_id", F.col("log")[0]["seq"].alias("at"), F.posexplode(final).alias("part", "m")).select("conv_id", "at", "part", "m.role", "m.text")


def render(messages: DataFrame) -> DataFrame:
    """Messages to (conv_id, formatted, loss_spans): spans are (start, length) in code points, from 0."""
    turn = F.struct("at", "role", "text", "part")
    grouped = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = F.transform(
        "turns",
        lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")),
    )
    grouped = grouped.select("conv_id", piece.alias("pieces"))

    def span(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct(
            (end + len(END)).alias("at"), F.when(p["learn"], F.concat(done["spans"], F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length"))))).otherwise(done["spans"]).alias("spans")
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("pieces", zero, span, lambda d: d["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the rendered text says: (conv_id, formatted, turns as (role, text, learn)), all taken from the text and its mask."""
    # every turn ends with END, so the last piece of the split is empty
    cells = F.split("formatted", F.lit(r"<\|end\|>"))
    pieces = F.slice(cells, F.lit(1), F.size(cells) - 1)
    rows = formatted.select("conv_id", "formatted", "loss_spans", pieces.alias("pieces"))

    def place(done: Column, p: Column) -> Column:
        head = F.instr(p, F.lit(CLOSE)) + len(CLOSE) - 1
        return F.struct((done["at"] + F.length(p) + len(END)).alias("at"), F.concat(done["starts"], F.array(done["at"] + head)).alias("starts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    rows = rows.withColumn("starts", F.aggregate("pieces", zero, place, lambda d: d["starts"])).withColumn("masked", F.transform("loss_spans", lambda s: s["start"]))
    turns = F.zip_with(
        "pieces",
        "starts",
        lambda p, at: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), CLOSE, 1)).alias("role"),
            unescape(p.substr(F.instr(p, F.lit(CLOSE)) + len(CLOSE), F.length(p))).alias("text"),
            F.array_contains(F.col("masked"), at).alias("learn"),
        ),
    )
    return rows.select("conv_id", "formatted", "loss_spans", turns.alias("turns"))


def format_chats(events: DataFrame) -> DataFrame:
    """Events to one rendered conversation per row."""
    return render(fold_events(events))


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log: each row is the one event of its message."""
    return conversations.select(
        F.col("conv_id"), F.struct("turn", "role", "text").alias("msg"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("role"), F.col("text")
    )
