"""Chat formatting by prefix-target expansion.

A conversation becomes one formatted stream; every assistant turn becomes an
example of its own whose text is a prefix of that stream (all preceding turns
as context, then the reply) and whose loss mask covers the reply alone.
Examples hold character spans, so their number and size stay linear in the
conversation; :func:`example_texts` cuts the texts out where they are wanted.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Make control strings inside a text inert; :func:`unescape` restores it."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def conversation_streams(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, stream, parts.

    ``parts`` lists the turns in order as (head, body, target): the escaped text
    and what stands before it in ``stream``; ``target`` marks assistant turns.
    Turns are ordered by turn (null first), then role, then text, so ties and
    repeated rows have a fixed order.  Null text and null role count as empty; a
    null conv_id is a conversation of its own.  Other columns are not carried.
    """
    piece = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("_turns"))
    parts = F.transform("_turns", lambda t: F.struct(
        F.concat(F.lit(START), _role_in(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("target")))
    conv = conv.select("conv_id", parts.alias("parts"))
    stream = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "")
    return conv.select("conv_id", stream.alias("stream"), "parts")


def prefix_examples(streams: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, part, context_end, loss_start, loss_end, chars, reply.

    ``part`` numbers the turns of the stream from 0.
    Spans count characters of the stream from 0.  The example's text is the
    first ``chars`` characters of the stream; only [loss_start, loss_end) is
    trainable, and ``reply`` is that part as it stands in the formatted text.
    Every row carries its own turn alone and spans are running sums of lengths,
    so the work is linear in the conversation.
    """
    turns = streams.select("conv_id", F.posexplode("parts").alias("_pos", "_part")).select("conv_id", "_pos", "_part.*")
    upto = Window.partitionBy("conv_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, body = F.length("head").cast("long"), F.length("body").cast("long")
    turns = turns.select("conv_id", F.col("_pos").alias("part"), "target", "body", head.alias("_head"), body.alias("_body"),
                         F.sum(head + body + len(END) + 1).over(upto).alias("chars"), (F.sum(F.col("target").cast("long")).over(upto) - 1).alias("example"))
    loss_end = F.col("chars") - len(END) - 1
    return turns.filter("target").select(
        "conv_id", "example", "part", (loss_end - F.col("_body") - F.col("_head")).alias("context_end"), (loss_end - F.col("_body")).alias("loss_start"), loss_end.alias("loss_end"),
        "chars", F.col("body").alias("reply"))


def masked_replies(streams: DataFrame, examples: DataFrame) -> DataFrame:
    """conv_id, stream, replies, chars: every stream with what it holds under the loss masks of its examples, in order.

    The stream is cut at its end marks once and a mask is read in the part of
    its own turn, so the work is linear in the conversation; examples travel as
    spans.  ``chars`` sums the examples' characters (null without examples).
    """
    spans = examples.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.sort_array(F.collect_list(F.struct("example", "part", "context_end", "loss_start", "loss_end"))).alias("_spans"), F.sum("chars").alias("chars"))
    rows = streams.select("conv_id", "stream").join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    rows = rows.withColumn("_parts", F.split("stream", r"<\|im_end\|>\n", -1))
    under = F.transform("_spans", lambda s: F.substring(
        F.get("_parts", s["part"]), (s["loss_start"] - s["context_end"] + 1).cast("int"), (s["loss_end"] - s["loss_start"]).cast("int")))
    return rows.select("conv_id", "stream", F.coalesce(under, F.array().cast("array<string>")).alias("replies"), "chars")


def example_texts(streams: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples with their full texts; repeats every context, so it grows with turns squared."""
    return examples.join(streams.select("conv_id", "stream"), examples["conv_id"].eqNullSafe(streams["conv_id"])).select(
        examples["*"], F.substring(F.col("stream"), F.lit(1), F.col("chars").cast("int")).alias("text"))


def read_turns(stream: Column) -> Column:
    """Parse a formatted stream back into an array of (role, text)."""
    marks = F.filter(F.split(stream, r"<\|im_end\|>\n", -1), lambda s: s != "")
    inner = F.transform(marks, lambda s: F.substring(s, F.lit(len(START) + 1), F.length(s)))
    return F.transform(inner, lambda s: F.struct(
        _role_out(F.call_function("substring_index", s, F.lit("\n"), F.lit(1))).alias("role"),
        unescape(F.substring(s, F.call_function("instr", s, F.lit("\n")) + 1, F.length(s))).alias("text")))
