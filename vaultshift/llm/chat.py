"""Chat transcripts folded from an event log, then rendered with a loss mask.

A log row is an event (conversation, seq, message, kind, role, text) of kind

* ``message``: the message begins with this text,
* ``delta``: the text is appended to its message,
* ``edit``: the text replaces what the message says so far,
* ``regenerate``: the message starts anew; it and later messages lose what they said before.

Events are partitioned by conversation, ordered by ``seq`` and folded into the
final messages, which are rendered into one string per conversation with
``<|im_start|>role\\ntext<|im_end|>\\n`` turns.  DataFrame functions only.

Defined cases: a null text counts as empty, a null role as the empty role, a
null conversation is a conversation of its own; events of equal ``seq`` are
ordered by kind, then text; the greatest role of a message's live events is its role.  A role's newlines and backslashes, and ``<|`` inside
roles and texts, are escaped reversibly.  One conversation is one output
string, so its size bounds what a task holds; rows of the log are folded per
message before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")
#: Deltas that a streamed text of the conversations table arrives in.
DELTAS = 4


def escape_text(text: Column) -> Column:
    r"""``<|`` becomes ``<\|``; an already escaped one gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    one_line = unescape_text(role)
    halves = F.split(one_line, r"\\\\")  # at escaped backslashes; what is left escapes newlines only
    return F.array_join(F.transform(halves, lambda s: F.replace(s, F.lit("\\n"), F.lit("\n"))), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conversation, message, role, text) after all events of ``events``."""
    e = events.select("conversation", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).alias("reset")
    anew = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("anew")
    said = F.collect_list(F.struct("seq", "kind", "text", "role")).alias("said")
    told = e.groupBy("conversation", "message").agg(own, anew, said)
    before = Window.partitionBy("conversation").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    since = told.withColumn("cut", F.greatest("reset", F.max("anew").over(before)))
    live = since.withColumn("live", F.array_sort(F.filter(
        "said", lambda x: F.col("cut").isNull() | (x["seq"] >= F.col("cut")))))
    return live.where(F.size("live") > 0).select(
        "conversation", "message",
        F.coalesce(F.array_max(F.transform("live", lambda x: x["role"])), F.lit("")).alias("role"),
        F.array_join(F.transform("live", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conversation, formatted, mask): the mask lists (start, length) spans, 1-based, in code points."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape_text(F.col("text"))
    lines = messages.select(
        "conversation", "message", F.length(head).alias("head"), F.length(body).alias("body"),
        (F.col("role") == loss_role).alias("learned"), F.concat(head, body, F.lit(END + "\n")).alias("line"))
    before = Window.partitionBy("conversation").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("at", F.coalesce(F.sum(F.length("line").cast("long")).over(before), F.lit(0)))
    every = placed.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct(
        "message", "line", "learned", (F.col("at") + F.col("head") + 1).alias("start"), F.col("body").alias("length")))).alias("all"))
    return every.select(
        "conversation", F.array_join(F.transform("all", lambda x: x["line"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["learned"]), lambda x: F.struct(x["start"], x["length"])).alias("mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s: s != "")
    n_end = len(END) + 1

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        rest = F.substr(s, F.length(role) + F.lit(2), F.length(s) - F.length(role) - F.lit(1 + n_end))
        return F.struct(unescape_role(role).alias("role"), unescape_text(rest).alias("text"))

    return F.transform(turns, turn)


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape_text(
        F.substr(formatted, m["start"].cast("int"), m["length"].cast("int")))), "")


def streamed(conversations: DataFrame) -> DataFrame:
    """The conversations table as a log: each row a message that arrives in ``DELTAS`` pieces."""
    order = Window.partitionBy("conversation").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("conversation"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("message", F.row_number().over(order).cast("long"))
    size = F.ceil(F.length("text") / F.lit(DELTAS)).cast("int")
    pieces = F.array(*[F.substr("text", size * F.lit(i) + F.lit(1), size) for i in range(DELTAS)])
    return numbered.select("conversation", "message", "role", F.posexplode(pieces).alias("part", "text")).select(
        "conversation", (F.col("message") * DELTAS + F.col("part")).alias("seq"), "message",
        F.when(F.col("part") == 0, "message").otherwise("delta").alias("kind"), "role", "text")
