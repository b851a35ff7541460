"""Chat formatting with a grammar round trip, by DataFrame expressions only.

Grammar of the formatted text, one line of it for each turn::

    conversation := turn*
    turn         := "### " role ": " body "</turn>" newline

A deterministic parser cuts at the turn ends, takes the role up to the first
colon, and undoes the escapes of the body.  Each text is first rendered as it
is and reparsed; where the parser finds a control string in it, or recovers
another text, it is escaped.  The whole conversation is then reparsed and
compared with its source.

Escapes: a backslash is doubled, ``</turn>`` becomes ``<\\/turn>``, ``### ``
becomes ``##\\# ``, and in a role a colon becomes ``<\\.>``.

Defined results: null roles and texts are empty; rows of a conversation go by
turn, role, text (null turn first), and repeated rows stay as turns of their
own; rows without a conversation id are one conversation; an empty table gives
no rows.  Columns besides the four are not read.  A conversation is one row of
the result and thus stands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings: fixed values of the grammar.
HEAD, COLON, END, NEWLINE = "### ", ": ", "</turn>", "\n"
HEAD_ESCAPED, END_ESCAPED, COLON_ESCAPED = "##\\# ", "<\\/turn>", "<\\.>"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\", "\\\\"), END, END_ESCAPED), HEAD, HEAD_ESCAPED)


def unescape(body: Column) -> Column:
    return _replace(_replace(_replace(body, HEAD_ESCAPED, HEAD), END_ESCAPED, END), "\\\\", "\\")


def escape_role(role: Column) -> Column:
    return _replace(escape(role), ":", COLON_ESCAPED)


def unescape_role(role: Column) -> Column:
    return unescape(_replace(role, COLON_ESCAPED, ":"))


def read_body(body: Column) -> Column:
    """What the parser makes of a body; null if a control string stands in it."""
    return F.when(~F.contains(body, F.lit(END)) & ~F.contains(body, F.lit(HEAD)), unescape(body))


def render_body(text: Column) -> Column:
    """The text as it is if it reads back the same, else escaped."""
    return F.when(read_body(text).eqNullSafe(text), text).otherwise(escape(text))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    lines = F.split(formatted, "</turn>\\n")
    turns = F.slice(lines, F.lit(1), F.size(lines) - 1)

    def turn(line: Column) -> Column:
        colon = F.instr(line, ":")
        role = F.substring(line, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        return F.struct(unescape_role(role).alias("role"), read_body(F.substring(line, colon + len(COLON), F.length(line))).alias("text"))

    return F.transform(turns, turn)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans (code points of the assistant bodies).

    Fails if a conversation does not read back as its source.
    """
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    start = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(COLON))
    rows = rows.withColumn("start", start).withColumn("body", render_body(F.col("text")))
    rows = rows.withColumn("line", F.concat("start", "body", F.lit(END + NEWLINE)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("conv", "role", "text", "line", "body", F.row_number().over(order).alias("seq"), (before + F.length("start")).alias("at"))
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "line", span.alias("span")))).alias("turns"))
    whole = whole.select(
        "conv", F.array_join("turns.line", "").alias("formatted"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["span"]).alias("loss_spans"),
    )
    same = parse(F.col("formatted")) == F.col("source")
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back as its source")).cast("string"))
    return whole.select(F.col("conv").alias(conv), checked.alias("formatted"), "loss_spans")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests read back from the formatted text and its loss mask."""
    turns = parse(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    out = formatted.select(conv, "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss"))
    return out.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
