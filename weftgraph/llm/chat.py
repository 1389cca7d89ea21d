"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted by (turn, role,
text).  Adjacent turns of one role form a block, whose texts are joined by a
part mark, so a block can be taken apart again:

    <|im_start|>ROLE<|im_sep|>TEXT[<|im_part|>TEXT ...]<|im_end|>\\n

Roles and texts are escaped so that no mark can occur in them: every ``<``
followed by backslashes and ``|`` gets one more backslash, which unescaping
takes away; other texts stay as they are.  The output is a list of segments
with a loss flag; their texts in order are the formatted string, and the texts
of assistant turns are the segments under the loss mask.

Defined cases: null role or text is the empty string; a null turn sorts first;
repeated rows are turns of their own; rows with null conv_id form one
conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import only

START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _segment(text: Column | str, loss: Column | bool) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>) of every conversation."""
    rows = only(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.col("turns")[i - 1].role != F.col("turns")[i - 2].role))
    chats = chats.withColumn("first", first)

    def block(i: Column, k: Column) -> Column:
        stop = F.when(k + 1 < F.size("first"), F.col("first")[k + 1]).otherwise(F.size("turns") + 1)
        return F.struct(F.col("turns")[i - 1].role.alias("role"), F.slice("turns", i, stop - i).alias("turns"))

    chats = chats.withColumn("blocks", F.transform("first", block))

    def segments(b: Column) -> Column:
        head = F.concat(F.lit(START), escape(b.role), F.lit(SEP))
        parts = F.flatten(F.transform(b.turns, lambda t, j: F.array(_segment(F.when(j == 0, head).otherwise(PART), False), _segment(escape(t.text), b.role == trained))))
        return F.concat(parts, F.array(_segment(END, False)))

    return chats.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    """The string that a tokenizer gets."""
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def loss_texts(segments: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text))


def read_turns(string: Column) -> Column:
    """The (role, text) turns of a formatted string, taken apart by its marks alone."""
    blocks = F.split(string, r"<\|im_start\|>")
    blocks = F.slice(blocks, 2, F.size(blocks))

    def turns(b: Column) -> Column:
        halves = F.split(b, r"<\|im_sep\|>", 2)
        body = F.regexp_replace(halves[1], r"<\|im_end\|>\n$", "")
        return F.transform(F.split(body, r"<\|im_part\|>"), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))
