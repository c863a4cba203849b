"""Chat formatting with a checked grammar round trip, in DataFrame functions alone.

Template: each turn is ``<|im_start|>role\\n text <|im_end|>\\n`` (no blanks around the
text). The parser is deterministic: it cuts at every start mark, takes the role up to the
first line end and the text up to the first end mark, and undoes escapes. A turn is first
rendered as it is; if parsing that does not give the turn back, its conflicting content is
escaped and the turn is rendered again. Every finished conversation is parsed once more as
a whole and compared with its source; a difference stops the job.

Escape: a control string, or one that already looks escaped, gets one more backslash after
its ``<``; in roles, backslashes and line ends are escaped too. Both are reversible.

Defined results: null roles and texts are empty ones; turns are ordered by turn, role and
text, nulls first, so ties and repeated rows have one order; conversations with a null id
form one conversation; no rows give no rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexaloc.llm._shared import let

START, END = "<|im_start|>", "<|im_end|>"
MARKS = r"\|(im_start|im_end)\|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)" + MARKS, r"<\\$1|$2|>")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)" + MARKS, r"<$1|$2|>")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape_text(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string; null where it breaks the grammar."""

    def turn(piece: Column) -> Column:
        def cut(at: Column) -> Column:
            line, end = at["line"], at["end"]
            sound = (line > 0) & (end > line) & (F.substring(piece, end + len(END), F.length(piece)) == "\n")
            role = unescape_role(F.substring(piece, F.lit(1), line - 1))
            text = unescape_text(F.substring(piece, line + 1, end - line - 1))
            return F.when(sound, F.struct(role.alias("role"), text.alias("text")))

        return let(F.struct(F.instr(piece, "\n").alias("line"), F.instr(piece, END).alias("end")), cut)

    pieces = F.split(formatted, r"<\|im_start\|>")
    return let(
        pieces,
        lambda p: F.when(F.get(p, F.lit(0)) == "", F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), turn)),
    )


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans, n_turns, n_escaped: a row per conversation.

    loss_spans: array of (start, end), code points of formatted, end exclusive: the texts
    of the role to learn. One shuffle by conversation serves the offsets and the grouping."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    source = F.array(F.struct("role", "text"))
    turns = turns.withColumn("plain", parse(render(F.col("role"), F.col("text"))).eqNullSafe(source))
    turns = turns.withColumn("r", F.when(F.col("plain"), F.col("role")).otherwise(escape_role(F.col("role")))).withColumn(
        "t", F.when(F.col("plain"), F.col("text")).otherwise(escape_text(F.col("text")))
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("line", render(F.col("r"), F.col("t"))).withColumn("at", F.coalesce(F.sum(F.length("line")).over(order), F.lit(0)))
    start = F.col("at") + len(START) + F.length("r") + 1
    turns = turns.withColumn("span", F.when(F.col("role") == learn, F.struct(start.alias("start"), (start + F.length("t")).alias("end"))))
    chats = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text", "line", "span"))).alias("x"),
        F.sum((~F.col("plain")).cast("long")).alias("n_escaped"),
    )
    x = F.col("x")
    chats = chats.select(
        "conv_id",
        F.array_join(x["line"], "").alias("formatted"),
        F.filter(x["span"], lambda s: s.isNotNull()).alias("loss_spans"),
        F.size(x).cast("long").alias("n_turns"),
        "n_escaped",
        F.transform(x, lambda y: F.struct(y["role"], y["text"])).alias("source"),
    )
    same = parse(F.col("formatted")).eqNullSafe(F.col("source"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back as it was")).cast("string"))
    return chats.select("conv_id", checked.alias("formatted"), "loss_spans", "n_turns", "n_escaped")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape_text(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
