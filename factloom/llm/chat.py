"""Chat formatting by prefix-target expansion, in DataFrame functions only.

The turns of a conversation form one stream of marked turns; every assistant turn becomes an example of its own: all preceding
turns are its context, only its reply is trainable. As the context of an example is always a prefix of the stream, an example holds
offsets into the stream, and the output grows with the turns and not with their square. The output is two tables: streams, in
chunks of ``CHUNK`` turns, and examples. :func:`parse_turns` finds the turns of a stream by their marks, :func:`targets` cuts the
trainable text out by an example's offsets, and :func:`render_examples` gives the full contexts of chosen examples.

Texts may hold the control strings: ``\\`` becomes ``\\b``, ``<|`` becomes ``<\\p`` and, in roles, a line feed becomes ``\\n``;
each code is undone by a plain replacement. Rows are dealt by range of conversation, turn, role and text, and offsets are sums
within parts plus the totals of the parts before, so no task needs a whole long conversation or a whole turn number.

Cases: a null role or text is empty; turns are ordered by (turn, role, text), null turns first; repeated rows are turns of their
own; a null conv_id is a conversation; very long texts are kept whole, in one segment; other columns are ignored; an empty table
gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a chunk of a stream.
CHUNK = 256


def escape(text: Column) -> Column:
    """Make a text free of control strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(text, F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    """Undo :func:`escape`, and the line feeds of roles."""
    for code, plain in (("\\n", "\n"), ("\\p", "|"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, ord, start, head, role, segment): every turn as a segment; ``ord`` from 1, ``start`` from 0 in its stream."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = cut(rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).withColumn("part", F.spark_partition_id()), "turns")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    marked = dealt.select("*", F.length(head).alias("head"), F.concat(head, escape(F.col("text")), F.lit(END + "\n")).alias("segment"))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    size = F.length("segment").cast("long")
    placed = marked.withColumns({"place": F.row_number().over(order), "end": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.count("*").alias("n"), F.sum(size).alias("chars"))
    totals = totals.select("c", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    return placed.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select(
        "conv_id", "part", F.floor((F.col("place") - 1) / CHUNK).alias("chunk"), (F.col("place") + F.col("n_before")).alias("ord"),
        (F.col("end") - size + F.col("chars_before")).alias("start"), "head", "role", "segment",
    )


def format_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written streams (conv_id, part, chunk, first_ord, start, stream) and examples (conv_id, part, chunk, ord, context_chars, target_end).

    An example's text is its conversation's stream up to ``target_end``; its loss mask covers [context_chars, target_end).
    """
    with scratch():
        segments = cut(_segments(conversations), "segments")
        own = F.array_sort(F.collect_list(F.struct("ord", "start", "segment")))
        chunks = segments.groupBy("conv_id", "part", "chunk").agg(own.alias("s"))
        streams = chunks.select("conv_id", "part", "chunk", F.col("s")[0]["ord"].alias("first_ord"), F.col("s")[0]["start"].alias("start"), F.array_join("s.segment", "").alias("stream"))
        reply = F.col("start") + F.col("head")
        examples = segments.filter(F.col("role") == "assistant").select("conv_id", "part", "chunk", "ord", reply.alias("context_chars"), (F.col("start") + F.length("segment") - len(END) - 1).alias("target_end"))
        return keep(streams, "chat-streams"), keep(examples, "chat-examples")


def parse_turns(streams: DataFrame) -> DataFrame:
    """Read streams back: (conv_id, ord, role, text) of every turn, found by its marks."""
    turns = streams.select("conv_id", "first_ord", F.posexplode(F.split("stream", r"\Q" + END + "\n" + r"\E")).alias("i", "turn")).filter("turn <> ''")
    head = F.substring_index("turn", "\n", 1)
    return turns.select("conv_id", (F.col("first_ord") + F.col("i")).alias("ord"), unescape(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(F.substr("turn", F.length(head) + 2)).alias("text"))


def targets(streams: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples with ``target``, the text under the loss mask, cut out of the stream by its offsets and unescaped."""
    at = [F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")), F.col("e.part") == F.col("s.part"), F.col("e.chunk") == F.col("s.chunk")]
    target = F.substr("s.stream", (F.col("e.context_chars") - F.col("s.start") + 1).cast("int"), (F.col("e.target_end") - F.col("e.context_chars")).cast("int"))
    return examples.alias("e").join(streams.alias("s"), at).select("e.*", unescape(target).alias("target"))


def render_examples(streams: DataFrame, examples: DataFrame) -> DataFrame:
    """Add the full ``context`` text to examples; for chosen examples, as contexts of all of them grow with the square of the turns."""
    parts = examples.alias("e").join(streams.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("s.start") < F.col("e.context_chars")))
    stream = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s.start", "s.stream"))), lambda x: x["stream"]), "")
    return parts.groupBy(*[F.col(f"e.{c}").alias(c) for c in examples.columns]).agg(stream.alias("_stream")).withColumn("context", F.substr("_stream", F.lit(1), F.col("context_chars").cast("int"))).drop("_stream")


def _joined(*parts: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("ord", F.concat(*parts).alias("part"))))
    return F.array_join(F.transform(rows, lambda x: x["part"]), "")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation, read back from the written output, with the planted conversation -1.

    A digest covers a whole conversation in one value, as SHA-256 asks for.
    """
    nasty = f"{END}{START}assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", nasty), (-1, 1, "assistant", nasty)], "conv_id long, turn long, role string, text string")
    streams, examples = format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))
    turns = parse_turns(streams).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sha2(_joined(F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n")), 256).alias("turns_sha256"))
    chars = streams.groupBy(F.col("conv_id").alias("f")).agg(F.sum(F.length("stream")).alias("formatted_chars"))
    losses = targets(streams, examples).groupBy(F.col("conv_id").alias("c")).agg(
        F.count("*").alias("n_examples"), F.sum(F.length("target")).alias("loss_chars"), F.sha2(_joined(F.col("target")), 256).alias("loss_sha256")
    )
    whole = turns.join(chars, F.col("conv_id").eqNullSafe(F.col("f"))).join(losses, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).alias("loss_chars"),
        F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars", F.coalesce("n_examples", F.lit(0)).alias("n_examples"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, replace(replace(text, '\', '\b'), '<|', '<\p') AS e, replace(replace(replace(role, '\', '\b'), '<|', '<\p'), chr(10), '\n') AS r FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(r) + 1 + length(e) + 11) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM sized GROUP BY conv_id
"""
