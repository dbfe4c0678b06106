"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, adjacent turns of one
role are merged by array functions and everything is concatenated:

    <|im_start|>role
    first text<|im_sep|>next text of the same role<|im_end|>

Texts and roles are escaped so that no marker can be forged: ``&`` becomes ``&amp;``,
``<|`` becomes ``&lt;|``; in roles a line break becomes ``&#10;``.  Undoing the three
in reverse order gives the original back.

Cases: null roles and texts are empty; turns are ordered by (turn, role, text), nulls
first, and repeated rows stay, each as a turn; rows with a null ``conv_id`` form one
conversation; other columns are ignored; an empty table gives no rows.  A conversation
is one output row, so its turns meet in one row by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``segments`` and ``formatted``.

    ``segments`` are the consecutive parts of ``formatted`` with a flag ``loss``: true
    for the (escaped) texts of ``trained_role``, false for markers and other roles.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    merged = F.transform(
        "starts",
        lambda at, k: F.struct(
            F.get("turns", at)["role"].alias("role"),
            F.transform(
                F.slice("turns", at + 1, F.coalesce(F.get("starts", k + 1), n) - at), lambda t: t["text"]
            ).alias("texts"),
        ),
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    parts = F.transform(
        "merged",
        lambda m: F.concat(
            F.array(segment(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")), no)),
            F.flatten(
                F.transform(
                    m["texts"],
                    lambda text, k: F.filter(
                        F.array(
                            segment(F.when(k > 0, F.lit(SEPARATOR)).otherwise(F.lit("")), no),
                            segment(escape(text), m["role"] == trained_role),
                        ),
                        lambda s: s["text"] != "",
                    ),
                )
            ),
            F.array(segment(F.lit(END), no)),
        ),
    )
    return (
        sorted_turns.withColumn("starts", starts)
        .withColumn("merged", merged)
        .select("conv_id", F.flatten(parts).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)

    def texts(block: Column) -> Column:
        body = F.substr(block, F.instr(block, "\n") + 1)
        body = F.left(body, F.char_length(body) - len(END))
        role = unescape_role(F.substring_index(block, "\n", 1))
        return F.transform(
            F.split(body, r"<\|im_sep\|>"),
            lambda text: F.struct(role.alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(blocks, texts))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
