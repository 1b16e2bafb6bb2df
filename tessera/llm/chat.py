"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text). Adjacent
turns of one role share a block; each block is <|im_start|>role, a line break, its texts with
<|im_sep|> between, <|im_end|> and a line break. In roles and texts a backslash is doubled and
`<|` becomes `<\\|`, so no control string can occur in them and both steps can be undone
(roles also write a line break as `\\n`). The loss mask lists runs of characters: control run
and text run in turn, 2 n + 1 for n turns; text runs of the assistant carry the loss.

Reading back splits the output at its control strings into the same runs and compares every one
with the mask, control runs too, and their sum with the output's length. The runs are then the
pieces that the mask's offsets cut, found in one pass (cutting each by its offset would read the
output from its start for every turn). A mask that does not fit gives no loss text (null).

Nulls: a null text or role is empty, a null conv_id is a conversation of its own, a null turn
sorts first. Repeated rows stay repeated turns. No rows give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(col: Column) -> Column:
    return F.replace(escape(col), F.lit("\n"), F.lit("\\n"))


def unescape_role(col: Column) -> Column:
    """Undo escape_role: a doubled backslash must not be read as half of a line break."""
    parts = F.transform(F.split(col, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_mask array<struct<chars, loss>>, n_blocks."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn("turns", F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("loss"))))
    fresh = lambda t, i: (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
    convs = convs.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                F.when(fresh(t, i), F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END + "\n")), F.lit(START), t["role"], F.lit("\n"))).otherwise(F.lit(SEP)).alias("control"),
                t["text"].alias("text"),
                t["loss"].alias("loss"),
                fresh(t, i).cast("int").alias("fresh"),
            ),
        ),
    )
    run = lambda s, loss: F.struct(F.length(s).cast("long").alias("chars"), loss.alias("loss"))
    last = F.lit(END + "\n")
    return convs.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["control"], p["text"])), ""), last).alias("formatted"),
        F.concat(F.flatten(F.transform("parts", lambda p: F.array(run(p["control"], F.lit(False)), run(p["text"], p["loss"])))), F.array(run(last, F.lit(False)))).alias("loss_mask"),
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["fresh"]).alias("n_blocks"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, read back: conv_id, turns array<struct<role, text>>, loss_text (null unless the mask fits), mask_fits."""
    blocks = F.transform(
        F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda b: b != ""),
        lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), F.split(F.regexp_replace(F.regexp_replace(b, r"\A[^\n]*\n", ""), r"<\|im_end\|>\n\z", ""), r"<\|im_sep\|>", -1).alias("texts")),
    )
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))))
    last = len(END) + 1
    first = lambda b, i: F.length(b["role"]) + F.when(i == 0, 0).otherwise(last) + len(START) + 1
    control = F.flatten(F.transform(blocks, lambda b, i: F.transform(b["texts"], lambda t, j: F.when(j == 0, first(b, i)).otherwise(len(SEP)))))
    out = formatted.withColumn("raw", turns).withColumn("control", control)
    out = out.withColumn("cut", F.concat(F.flatten(F.zip_with("control", "raw", lambda c, t: F.array(c, F.length(t["text"])))), F.array(F.lit(last))))
    masked = F.filter(F.transform("raw", lambda t, i: F.struct(t["text"].alias("text"), F.get("loss_mask", 2 * i + 1)["loss"].alias("loss"))), lambda x: x["loss"])
    total = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda n, r: n + r["chars"])
    fits = F.forall(F.zip_with("cut", "loss_mask", lambda n, r: n.cast("long").eqNullSafe(r["chars"])), lambda x: x) & (total == F.length("formatted"))
    fits &= F.size(F.filter("loss_mask", lambda r, i: r["loss"] & (i % 2 == 0))) == 0
    return out.select(
        "conv_id",
        "formatted",
        "n_blocks",
        F.transform("raw", lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        F.when(fits, F.array_join(F.transform(masked, lambda x: unescape(x["text"])), "")).alias("loss_text"),
        fits.alias("mask_fits"),
    )


def chat_digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks, mask_fits, read back from the output."""
    back = read_chat(format_chat(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_blocks").cast("long").alias("n_blocks"),
        "mask_fits",
    )
