r"""Chat formatting by a grammar round trip, with DataFrame functions only.

A conversation is rendered as turns joined by a line feed, each ``<turn>role LF body</turn>``. The parser is
deterministic and has no choices: it splits at every ``</turn>``, takes the one ``<turn>`` that opens the piece, takes
the role up to the first line feed, and undoes the escapes ``\l`` (less-than sign), ``\n`` (line feed in a role)
and ``\b`` (backslash) in role and body. A piece with a second ``<turn>`` doesn't parse.

Rounds: (0) render role and text as they are, reparse, compare with the source; (1) where they differ, write
backslashes as ``\b`` and the less-than sign of control strings as ``\l``, reparse, compare; (2) where they still
differ, write every less-than sign and line feed of the role as an escape too. Since the parser's state is reset by
``</turn>``, turns that each survive their own round trip survive it together; the joined text is parsed once more
and a conversation that didn't come back whole stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def _escape(c: Column, level: int) -> Column:
    c = _swap(c, "\\", "\\b")
    if level > 1:
        return _swap(_swap(c, "<", "\\l"), "\n", "\\n")
    return _swap(_swap(c, OPEN, "\\l" + OPEN[1:]), CLOSE, "\\l" + CLOSE[1:])


def unescape(c: Column) -> Column:
    """Role or body as it was before it was written."""
    return _swap(_swap(_swap(c, "\\l", "<"), "\\n", "\n"), "\\b", "\\")


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from rendered text; null role and text mark a piece that doesn't parse."""
    pieces = F.split(formatted, r"\Q" + CLOSE + r"\E", -1)

    def turn(piece: Column, i: Column) -> Column:
        piece = F.when((i > 0) & piece.startswith("\n"), F.substring(piece, 2, 1 << 30)).otherwise(piece)
        inner = F.substring(piece, len(OPEN) + 1, 1 << 30)
        cut = F.locate("\n", inner)
        fine = piece.startswith(OPEN) & ~F.contains(inner, F.lit(OPEN)) & (cut > 0)
        return F.struct(
            F.when(fine, unescape(F.substring_index(inner, "\n", 1))).alias("role"),
            F.when(fine, unescape(F.substring(inner, cut + 1, F.lit(1 << 30)))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _survives(rendered: Column, role: Column, text: Column) -> Column:
    back = parse_turns(rendered)
    return (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)


def escape_turn(role: Column, text: Column) -> tuple[Column, Column]:
    """Role and body as the first round writes them whose reparsed turn is the source."""
    out = []
    # The cheap form of the round trip's failures spares most texts the parser, and lets no failure by.
    suspect = F.rlike(F.concat(role, F.lit("\0"), text), F.lit(r"<turn>|</turn>|\\[lnb]")) | F.contains(role, F.lit("\n"))
    fails0 = suspect & ~F.coalesce(_survives(_render(role, text), role, text), F.lit(False))
    fails1 = ~F.coalesce(_survives(_render(_escape(role, 1), _escape(text, 1)), role, text), F.lit(False))
    for c, is_role in ((role, True), (text, False)):
        full = _escape(c, 2) if is_role else _swap(_swap(c, "\\", "\\b"), "<", "\\l")
        out.append(F.when(~fails0, c).when(~fails1, _escape(c, 1)).otherwise(full))
    return out[0], out[1]


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv``, formatted (string), loss_spans (array of start, end: code points of the
    formatted text that the loss covers, end exclusive), turns (array of role, text as parsed back from it).

    Turns are ordered by ``turn`` (null first), then role, then text; repeated rows stay as repeated turns. Null role
    and text count as empty. Rows with a null conversation id form one conversation of id null. Other columns take no
    part, so their names can't clash. An empty table gives no rows; texts of any length are written whole. The conversation is the unit of the result, so its
    turns do meet in one row.
    """
    src = conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    role_out, body_out = escape_turn(F.col("role"), F.col("text"))
    order = W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    lines = (
        src.withColumns({"r": role_out, "b": body_out})
        .withColumn("piece", F.concat(F.when(F.row_number().over(order) > 1, F.lit("\n")).otherwise(F.lit("")), _render(F.col("r"), F.col("b"))))
        .withColumn("seq", F.row_number().over(order))
        .withColumn("stop", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    )
    end = F.col("stop") - len(CLOSE)
    span = F.struct((end - F.length("b")).alias("start"), end.alias("end"))
    whole = lines.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("seq", "piece", "role", "text", F.when(F.col("role").isin(*loss_roles), span).alias("span")))).alias("all"),
    )
    done = (
        whole.withColumn("formatted", F.array_join(F.col("all.piece"), ""))
        .withColumn("turns", parse_turns(F.col("formatted")))
        .withColumn("source", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    )
    checked = F.when(F.col("turns") == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("the round trip failed for conversation "), F.coalesce(F.col("conv").cast("string"), F.lit("null")))))
    return done.select(
        F.col("conv").alias(conv),
        checked.cast("string").alias("formatted"),
        F.filter("all.span", lambda s: s.isNotNull()).alias("loss_spans"),
        "turns",
    )
