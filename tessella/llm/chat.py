"""Chat formatting: one training example for every assistant turn.

Each assistant turn becomes an example of its own. All turns before it are
context, and only its reply is trainable: ``loss_start`` and ``loss_chars``
(code points into ``formatted``) mark exactly that text. Turns after the last
reply would be in no example; they close the conversation in one more example
whose loss mask is empty, so that the output holds every turn.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a
``<`` that backslashes and a ``|`` follow gets one more backslash, so no text
can hold a control string, and taking one backslash away restores it. In roles
``%`` and line feeds are written ``%25`` and ``%0A``, since a line feed ends the role.

Defined cases: null texts and null roles count as empty; turns are ordered by
``turn``, ties by role, then text, and repeated rows are repeated turns; null
turns come first; a null conversation id is a conversation; an empty table has
no examples; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """A text without any ``<|``; ``unescape`` gives the original back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chat(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(conv_id, example, is_last, formatted, loss_start, loss_chars), an example for every assistant turn.

    A conversation is gathered once (that is its natural unit: an example
    holds all turns before it); the expansion itself needs no more shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    opening = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), opening.alias("opening"), escape(text).alias("body")).alias("t"))
    # The rendered turns stand in order; `at` counts code points before each turn.
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rendered = F.transform("ts", lambda t: F.concat(t["opening"], t["body"], F.lit(END)))
    replies = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: F.element_at("ts", i)["role"] == F.lit(assistant))
    conv = conv.select("conv_id", "ts", rendered.alias("rendered"), replies.alias("replies"))
    n = F.size("ts")
    closed = F.when((F.size("replies") > 0) & (F.element_at("replies", -1) == n), F.col("replies")).otherwise(F.concat("replies", F.array(n)))
    each = conv.withColumn("n", n).select("conv_id", "ts", "rendered", "n", F.posexplode(closed).alias("example", "upto"))
    target = F.expr("ts[upto - 1]")
    reply = target["role"] == F.lit(assistant)
    context = F.concat_ws("", F.slice("rendered", F.lit(1), F.col("upto") - 1))
    return each.select(
        "conv_id", F.col("example").cast("long").alias("example"), (F.col("upto") == F.col("n")).alias("is_last"),
        F.concat(context, F.expr("rendered[upto - 1]")).alias("formatted"),
        F.when(reply, F.length(context) + F.length(target["opening"])).otherwise(0).cast("long").alias("loss_start"),
        F.when(reply, F.length(target["body"])).otherwise(0).cast("long").alias("loss_chars"),
    )


def loss_text(examples: DataFrame) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(examples["formatted"].substr((examples["loss_start"] + 1).cast("int"), examples["loss_chars"].cast("int")))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    body = lambda p: F.substring_index(p, "<|im_end|>", 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(body(p), "\n", 1)
        return F.struct(_unescape_role(head).alias("role"), unescape(F.substr(body(p), F.length(head) + 2)).alias("text"))

    return F.transform(pieces, turn)
