"""Chat formatting from an event log, with DataFrame functions only.

Events of a message (``open``, ``delta``, ``edit``, ``regenerate``, ``delete``) are gathered by conversation and
message, sorted by ``seq`` and folded: an edit or a regeneration replaces the text so far, deltas append, and a
deleted message is gone. A delta that comes after the ``delete`` was under way and changes nothing; an edit or a
regeneration after it brings the message back. A conversation of any length is therefore folded message by message;
only its finished output meets in one row. ``seq`` runs through a conversation, so messages may interleave.

A turn is rendered as ``<|start|>role<|text|>content<|end|>``. In roles and contents a backslash goes behind every
``<`` and ``[``, so neither these marks nor other control strings (``</s>``, ``[INST]``) can stand in a text, and
taking the backslashes out again restores it exactly. The output has the whole string and its segments with the
loss mask: the content of assistant turns is under the loss, nothing else.

Defined cases: null text and null role count as empty; null conversations form one conversation; a null turn or
seq sorts first; repeated events of one message count once, events with equal ``seq`` come by kind, role and text; turns with equal numbers sort by role, then text;
repeated rows of a conversation table are turns each; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
TURN_STEPS = 4  # events of a turn that come before the next turn begins


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))


def events_of(conversations: DataFrame) -> DataFrame:
    """A finished conversation table (``conv_id, turn, role, text``) as an event log that folds back to it.

    Every message goes the way of a live one. An assistant turn streams a draft, is regenerated and streams its text
    in three deltas; other turns are typed in part and edited to their text. Beside each assistant turn stands an
    alternative that is deleted while its last delta is still under way. ``seq`` counts through the conversation:
    a turn begins ``TURN_STEPS`` after the one before, so events of neighbouring turns interleave.
    """
    empty = F.lit("")
    rows = (
        conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count("*").alias("copies"))
        .select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .select("conv_id", "turn", "role", "text", "copy", F.sha2("text", 256).alias("tie"))
    )
    begin = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit(0)) * TURN_STEPS
    third = F.ceil(F.char_length("text") / 3).cast("int")
    no_role = F.lit(None).cast("string")

    def event(step: int, kind: str, text: Column, role: Column = no_role, other: bool = False) -> Column:
        message = F.struct("turn", "role", "tie", "copy", F.lit(other).alias("other"))
        return F.struct(
            message.alias("message"),
            (begin + step).cast("decimal(38,0)").alias("seq"),
            F.lit(kind).alias("kind"),
            role.alias("role"),
            text.alias("text"),
        )

    def piece(number: int) -> Column:
        return F.col("text").substr(third * number + 1, third)

    typed = F.array(event(0, "open", piece(0), F.col("role")), event(1, "delta", piece(2)), event(5, "edit", F.col("text")))
    streamed = F.array(
        event(0, "open", empty, F.col("role")),
        event(1, "delta", piece(1)),
        event(2, "regenerate", empty),
        *(event(3 + number, "delta", piece(number)) for number in range(3)),
        event(0, "open", piece(0), F.col("role"), other=True),
        event(4, "delete", empty, other=True),
        event(6, "delta", piece(1), other=True),
    )
    live = F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(typed)
    return rows.select("conv_id", "turn", F.explode(live).alias("e")).select("conv_id", "turn", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log (``conv_id, turn, message, seq, kind, role, text``): ``conv_id, turn, role, text``."""
    log = events.groupBy("conv_id", "message").agg(
        F.min("turn").alias("turn"),
        F.sort_array(F.collect_set(F.struct("seq", "kind", "role", "text"))).alias("log"),
    )

    def last(*kinds: str) -> Column:
        """Where in the log the last event of these kinds stands; -1 without one."""
        places = F.transform("log", lambda e, i: F.when(e["kind"].isin(*kinds), i))
        return F.coalesce(F.array_max(places), F.lit(-1))

    written = F.transform("log", lambda e, i: F.when(i >= F.col("since"), F.coalesce(e["text"], F.lit(""))))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda role: role.isNotNull())
    return (
        log.withColumn("since", last("edit", "regenerate"))
        .where(last("delete") <= F.col("since"))
        .select(
            "conv_id",
            "turn",
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(written, "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, segments`` (``text``, ``loss``)."""
    body = escaped(F.col("text"))
    segments = F.array(
        F.struct(F.concat(F.lit(START), escaped(F.col("role")), F.lit(TEXT)).alias("text"), F.lit(False).alias("loss")),
        F.struct(body.alias("text"), (F.col("role") == LOSS_ROLE).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )
    turns = messages.select("conv_id", F.struct("turn", "role", "text", segments.alias("segments")).alias("t"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
        )
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log and render every conversation."""
    return render(fold(events))


def read_turns(formatted: Column) -> Column:
    """The turns (``role``, ``text``) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda piece: piece != "")
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescaped(F.substring_index(F.substring_index(piece, START, -1), TEXT, 1)).alias("role"),
            unescaped(F.substring_index(piece, TEXT, -1)).alias("text"),
        ),
    )


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
