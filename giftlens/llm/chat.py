"""Chat formatting by prefix-target expansion, in native expressions.

Every assistant turn becomes its own example: all turns before it are context,
and only that reply is trainable (its span is the loss mask). A conversation
that does not end with an assistant turn also gives one example with every turn
and nothing trainable, so no turn is lost.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also a line
feed ``&#10;``), which is undone exactly when reading back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """One row per example: the conversation, ``position`` (of its last turn, from 0), ``prompt`` (the formatted
    context up to the reply), ``reply`` (the formatted trainable text, empty if there is none) and ``closing``.

    The example's text is ``prompt || reply || closing``; the loss mask is
    the reply. Turns are ordered by turn, role, text (nulls first), so ties and
    repeated rows have a fixed order. Null role or text: empty. A null
    conversation id is a conversation of its own. Other columns are not read.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = whole.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == TRAINED_ROLE).alias("trained"),
        F.concat(F.lit(BEGIN), escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"))).alias("parts"))
    chosen = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("position"), p["trained"].alias("trained"))),
                      lambda p: p["trained"] | (p["position"] == F.size("parts") - 1))
    each = parts.select("conv_id", "parts", F.explode(chosen).alias("x")).select(
        "conv_id", "parts", F.col("x.position").alias("position"), F.col("x.trained").alias("trained"))
    last = F.get("parts", F.col("position"))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("position")),
                                       lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return each.select(
        "conv_id", "position", F.concat(context, last["head"], F.when(F.col("trained"), "").otherwise(last["body"]))
        .alias("prompt"), F.when(F.col("trained"), last["body"]).otherwise("").alias("reply"),
        F.lit(END).alias("closing"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its examples: ``turns`` (role, text), ``losses`` (trained texts in order) and
    ``formatted_chars`` (code points of all its examples)."""
    text = F.concat("prompt", "reply", "closing")
    per = formatted.groupBy("conv_id").agg(
        F.max_by(text, "position").alias("whole"),
        F.array_sort(F.collect_list(F.struct("position", "reply"))).alias("replies"),
        F.sum(F.length("prompt") + F.length("reply") + F.length("closing")).alias("formatted_chars"))
    pieces = F.split("whole", r"<\|im_start\|>")
    per = per.select("conv_id", "replies", "formatted_chars",
                     F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("pieces"))

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return per.select("conv_id", F.transform("pieces", turn).alias("turns"),
                      F.transform("replies", lambda r: unescape(r["reply"])).alias("losses"), "formatted_chars")
