"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = turn*
    turn         = "<turn " role ">" text "</turn>" newline

A turn ends at the first end mark, so the only string that can conflict is the end mark
inside a text. Every turn is rendered as it is, parsed again and compared; where the
parse differs, the text is escaped: a backslash goes after the "<" of anything that
reads as an end mark with any number of backslashes, of which the parser takes one away.
The escaped turn is parsed and compared again, and so on for ROUNDS rounds. At last the
whole conversation is parsed and its turns compared with the source: one that isn't
identical fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

OPEN, CLOSE, MARK = "<turn ", ">", "</turn>"
END = MARK + "\n"
LEARNT = "assistant"
ROUNDS = 2  # one is enough for this escape; the second shows that it is


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)/turn>", r"<$1\\/turn>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)/turn>", "<$1/turn>")


def _role(role: Column) -> Column:
    """Signs that would end a role early are percent-encoded."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(">"), F.lit("%3E")), F.lit("</"), F.lit("%3C/"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C/"), F.lit("</")), F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def parse_turn(piece: Column) -> Column:
    """Role, text, and where the text begins, of a turn without its end mark."""
    cut = F.instr(piece, CLOSE)
    body = F.substring(piece, cut + 1, F.length(piece))
    return F.struct(_unrole(F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(body).alias("text"), cut.alias("skip"))


def pieces_of(formatted: Column) -> Column:
    """The turns of a conversation, each without its end mark."""
    pieces = F.split(formatted, END)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def turns_of(formatted: Column) -> Column:
    return F.transform(pieces_of(formatted), parse_turn)


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask): one row for each conversation; null roles and texts are empty.

    Turns go by number, null last; of equal numbers by role, then by the rendered turn; repeated rows are repeated
    turns. The rows of a null conv_id are one conversation; an empty table gives no rows; other columns are left
    behind. A conversation of any length is one row. loss_mask has for each turn, in code points of ``formatted``: ``head`` to skip, ``size`` to learn
    (0 but for assistants), and ``all`` that the turn takes.
    """
    rows = turns.select(column(conv).alias("conv_id"), column(turn).alias("turn"), F.coalesce(column(role), F.lit("")).alias("role"), F.coalesce(column(text), F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(CLOSE))
    rows = rows.withColumn("body", F.col("text"))
    for _ in range(ROUNDS):
        got = parse_turn(F.get(F.split(F.concat(head, F.col("body"), F.lit(MARK)), MARK), F.lit(0)))
        conflict = (got["role"] != F.col("role")) | (got["text"] != F.col("text"))
        rows = rows.withColumn("body", F.when(conflict, escape(F.col("body"))).otherwise(F.col("body")))
    rows = rows.withColumn("head", F.length(head)).withColumn("size", F.length("body")).withColumn("piece", F.concat(head, F.col("body")))
    entry = F.struct(F.col("turn").isNull().alias("n"), "turn", "role", "piece", "head", "size", "text")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    spans = F.transform("t", lambda x: F.struct(x["head"].alias("head"), F.when(x["role"] == LEARNT, x["size"]).otherwise(0).alias("size"), (x["head"] + x["size"] + len(END)).alias("all")))
    formatted = F.concat(F.array_join(F.transform("t", lambda x: x["piece"]), END), F.lit(END))
    got = whole.select("conv_id", formatted.alias("formatted"), spans.alias("loss_mask"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("said"))
    same = F.transform(turns_of(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == F.col("said")
    failed = F.raise_error(F.concat(F.lit("conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(" doesn't parse back")))
    return got.select("conv_id", F.when(same, F.col("formatted")).otherwise(failed).alias("formatted"), "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: the turns recovered from the text, and the text under the loss mask.

    The mask says for each turn how much to skip, how much to learn and how long it is, so runs of one and the
    same text are never read twice and a long conversation is read in one go. An empty table gives no rows.
    """
    df = formatted.withColumn("pieces", pieces_of(F.col("formatted")))
    df = df.withColumn("turns", F.transform("pieces", parse_turn))
    learnt = F.zip_with("pieces", "loss_mask", lambda p, m: unescape(F.substring(p, m["head"] + 1, m["size"])))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    df = df.withColumn("learnt", F.array_join(learnt, ""))
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        digest(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
