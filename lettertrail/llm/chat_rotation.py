"""Multi-party chats rendered from every participant's side, in DataFrame functions only.

From the side of one participant, that speaker's turns are the assistant's and are trained on; everyone else's are a
named user's; system turns stay what they are. One row for each side and turn: the rendered turn, its place in the
side's whole text and the span to train on. The text of a side is its rows' texts in order of `position`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# The markers of the rendering.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _plain(text: Column) -> Column:
    """Text that can't be taken for a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, position, role, name, rendered, first_char, end_char, trained, train_from, train_till).

    `turns` has conv_id, turn, role (the speaker) and text. Turns are ordered by turn, speaker and text, nulls first;
    repeated rows are turns of their own. A null text is empty, a null speaker is called "unknown", a null conv_id is
    one conversation. Offsets count characters of the side's whole text; `train_from` and `train_till` are null where
    nothing is trained. A conversation of system turns alone has no side and gives no row; other columns are not read.

    A conversation may hold any share of all rows: its turns are spread by ranges of their order, and only one sum for
    each range and side is brought together.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    sides = rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(sides, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~own & ~system, _plain(F.col("speaker")))
    head = F.concat(F.lit(BEGIN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    drawn = seen.select(
        "conv_id", "perspective", "turn", "speaker", "text", role.alias("role"), name.alias("name"), own.alias("trained"),
        F.char_length(head).alias("head_size"), F.concat(head, _plain(F.col("text")), F.lit(END)).alias("rendered"),
    ).withColumn("size", F.char_length("rendered"))

    order = [F.asc_nulls_first(c) for c in ("turn", "speaker", "text")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = drawn.repartitionByRange(parts, F.asc_nulls_first("conv_id"), "perspective", *order)
    # stored, so that both uses below see the same ranges
    ranged = materialise(placed.withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range", "conv_id", "perspective").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("till", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside))
    before = Window.partitionBy("conv_id", "perspective").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range", "conv_id", "perspective").agg(F.sum("size").alias("all"), F.count("*").alias("rows"))
    shift = sums.select(
        F.col("range").alias("r"), F.col("conv_id").alias("c"), F.col("perspective").alias("p"),
        F.coalesce(F.sum("all").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    joined = local.join(shift, (F.col("range") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")))
    end = F.col("chars_before") + F.col("till")
    first = end - F.col("size")
    return joined.select(
        "conv_id", "perspective", (F.col("rows_before") + F.col("nth") - 1).alias("position"), "role", "name", "rendered",
        first.alias("first_char"), end.alias("end_char"), "trained",
        F.when(F.col("trained"), first + F.col("head_size")).alias("train_from"), F.when(F.col("trained"), end - 1).alias("train_till"),
    )
