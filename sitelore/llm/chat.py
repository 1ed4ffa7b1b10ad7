"""Chat formatting of dialogues from every participant's point of view.

For each participant the dialogue is rendered with that speaker as the assistant and all
others as named users; masks mark the characters that the assistant is trained on. Turns
are numbered by position over the whole table, and a rendering is emitted in parts of
`PART_TURNS` turns, so a dialogue of any length is never gathered in one task. Only SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.llm.positions import number_rows

PART_TURNS = 64

# fixed values of the template
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Text in which the template's own marks cannot be mistaken for turns."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<|im start|>")), F.lit(CLOSE), F.lit("<|im end|>"))


def perspectives(
    turns: DataFrame, context_roles: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS
) -> DataFrame:
    """conv_id, perspective, part, first_turn, n_turns, text, masks per rendering part.

    `turns`: conv_id, turn, role, text. Each role but `context_roles` is a participant; a
    context turn stays what it is for everyone. `first_turn`: position of the part's first
    turn in the dialogue. `masks`: (start, end) character ranges of `text` that the
    perspective's speaker said, end mark included; empty where it is silent.

    Order in a dialogue: turn, then role, then text, nulls first; repeated rows are turns
    of their own. A null role or text is empty; a null conv_id is a dialogue like any other.
    A dialogue of context turns alone has no perspective and gives no row, nor does an
    empty table. Texts of any length stay whole: a part is bounded in turns. Other columns are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = number_rows(rows, order, "position")
    # null-safe key, so that a null conv_id joins with itself
    placed = placed.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    dialogues = placed.groupBy("conv_key").agg(F.min("position").alias("first"))
    speakers = placed.where(~F.col("role").isin(*context_roles)).select(
        "conv_key", F.col("role").alias("perspective")
    ).distinct()
    seen = (
        placed.join(dialogues, "conv_key").join(speakers, "conv_key")
        .withColumn("at", F.col("position") - F.col("first"))
        .withColumn("part", F.floor(F.col("at") / part_turns).cast("int"))
    )
    mine = F.col("role") == F.col("perspective")
    head = (
        F.when(mine, F.lit("assistant"))
        .when(F.col("role").isin(*context_roles), F.col("role"))
        .otherwise(F.concat(F.lit("user name="), escape(F.col("role"))))
    )
    opening = F.concat(F.lit(OPEN), head, F.lit("\n"))
    body = F.concat(escape(F.col("text")), F.lit(CLOSE))
    turn = F.struct(
        "at", F.concat(opening, body, F.lit("\n")).alias("text"),
        F.length(opening).alias("lead"), F.length(body).alias("said"), mine.alias("mine"),
    )
    parts = seen.groupBy("conv_id", "conv_key", "perspective", "part").agg(
        F.sort_array(F.collect_list(turn)).alias("turns")  # at most `part_turns` of them
    )
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["text"])).alias("at"),
            F.when(
                t["mine"],
                F.concat(
                    acc["masks"],
                    F.array(
                        F.struct(
                            (acc["at"] + t["lead"]).alias("start"),
                            (acc["at"] + t["lead"] + t["said"]).alias("end"),
                        )
                    ),
                ),
            ).otherwise(acc["masks"]).alias("masks"),
        ),
        lambda acc: acc["masks"],
    )
    return parts.select(
        "conv_id", "perspective", "part",
        F.get("turns", F.lit(0))["at"].alias("first_turn"),
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
        walked.alias("masks"),
    )
