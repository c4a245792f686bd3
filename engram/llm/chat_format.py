"""Relational chat formatting: turns are collected, sorted, merged and concatenated by Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template. Each holds "<", which texts and roles never do once they are escaped.
OPEN, CLOSE, TURN, END = "<|", "|>", "<|turn|>", "<|end|>"


def escape(c: Column) -> Column:
    """Reversible: afterwards no control string, nor a part of one, is left."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, text. Returns one row per conv_id: conv_id, formatted, loss_spans.

    A block is <|role|>text<|turn|>text...<|end|>: adjacent turns of one role share a block, and their border
    is kept, so that the turns can be read back. loss_spans holds (start, length) in code points, from 0, of each
    text of `loss_role`. Null role or text: empty. Turns are ordered by turn, ties by role, then text; repeated
    rows stay repeated; null turns come first, and rows of null conv_id form one conversation. An empty table gives no rows.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    with_starts = sorted_turns.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i).role != F.get("ts", i - 1).role)),
    )
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("ts"))
        role = F.get("ts", start).role
        texts = F.transform(
            F.slice("ts", start + 1, stop - start),
            lambda t, j: F.array(piece(F.when(j > 0, F.lit(TURN)).otherwise(F.lit("")), no), piece(escape(t.text), role == loss_role)),
        )
        return F.concat(F.array(piece(F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE)), no)), F.flatten(texts), F.array(piece(F.lit(END), no)))

    # Each piece's place: a running sum over a conversation's pieces. All of this keeps to the partitioning by conv_id.
    pieces = with_starts.select("conv_id", F.posexplode(F.flatten(F.transform("starts", block))).alias("pos", "p"))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("p.s")).over(so_far), F.lit(0)).cast("int"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "p.s", "p.loss"))).alias("ps"))
    spans = F.transform(F.filter("ps", lambda p: p.loss), lambda p: F.struct(p["at"].alias("start"), F.length(p.s).alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("ps", lambda p: p.s), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")
    role = lambda b: F.substring_index(F.substring(b, len(OPEN) + 1, 2**31 - 1), CLOSE, 1)
    body = lambda b: F.substring(b, F.length(role(b)) + len(OPEN) + len(CLOSE) + 1, F.lit(2**31 - 1))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(body(b), r"<\|turn\|>", -1),
                lambda t: F.struct(unescape(role(b)).alias("role"), unescape(t).alias("text")),
            ),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start + 1, s.length))), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
