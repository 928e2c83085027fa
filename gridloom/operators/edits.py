"""Manual edits as a log over grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.keys import ERASE_HEX, ERASE_KEY
from gridloom.operators.cells import POSITION, color_counts
from gridloom.operators.sizing import previous_in_blocks

# Fixed value: steps the undo history keeps.
HISTORY_LIMIT = 50
CELL = ["pattern_id", *POSITION]


def normalize_edits(edits: DataFrame) -> DataFrame:
    """Painting with the erase code makes a cell external; anything else makes it internal."""
    erase = F.col("color_key") == ERASE_KEY
    return edits.select(
        *CELL, "edit_seq", "color_key",
        F.when(erase, ERASE_HEX).otherwise(F.col("hex")).alias("hex"), erase.alias("is_external"),
    )


def effective_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits inside the grid that change code or externality of their cell; only these enter the history."""
    log = previous_in_blocks(normalize_edits(edits), CELL, "edit_seq", ["color_key", "is_external"])
    base = cells.select(*CELL, F.col("color_key").alias("_key"), F.col("is_external").alias("_ext"))
    changed = (F.coalesce("prev_color_key", "_key") != F.col("color_key")) | (
        F.coalesce("prev_is_external", "_ext") != F.col("is_external")
    )
    return log.join(base, CELL).where(changed).select(*CELL, "edit_seq", "color_key", "hex", "is_external")


def undo_last(edits: DataFrame, steps: int, history: int | None = HISTORY_LIMIT) -> DataFrame:
    """Drop the last `steps` edits of each pattern, never more than the `history` keeps (None: all)."""
    steps = steps if history is None else min(steps, history)
    if steps <= 0:
        return edits
    latest = Window.partitionBy("pattern_id").orderBy(F.desc("edit_seq"))
    cut = (
        edits.select("pattern_id", "edit_seq").withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= steps)
        .groupBy("pattern_id").agg(F.min("edit_seq").alias("_cut"))
    )
    return edits.join(cut, "pattern_id", "left").where(F.col("_cut").isNull() | (F.col("edit_seq") < F.col("_cut"))).drop("_cut")


def apply_edits(cells: DataFrame, edits: DataFrame, undo: int = 0, history: int | None = HISTORY_LIMIT) -> DataFrame:
    """Grid after the edit log, less the last `undo` effective steps; the last write per cell wins."""
    kept = undo_last(effective_edits(cells, edits), undo, history)
    last = kept.groupBy(*CELL).agg(F.max_by(F.struct("color_key", "hex", "is_external"), "edit_seq").alias("_e"))
    return cells.join(last, CELL, "left").select(
        *CELL, *[F.coalesce(F.col(f"_e.{c}"), F.col(c)).alias(c) for c in ("color_key", "hex", "is_external")]
    )


def count_deltas(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Change of the colour counts by an edit log: -1 for what a cell was, +1 for what it became.

    Steps in between cancel out, so only the first and last state of each edited cell count.
    """
    last = normalize_edits(edits).groupBy(*CELL).agg(
        F.max_by(F.struct("color_key", "hex", "is_external"), "edit_seq").alias("_new")
    )
    both = cells.join(last, CELL).select(
        "pattern_id",
        F.explode(
            F.array(
                F.struct(F.col("color_key").alias("k"), F.upper("hex").alias("hex"), F.col("is_external").alias("x"), F.lit(-1).alias("d")),
                F.struct(F.col("_new.color_key").alias("k"), F.upper("_new.hex").alias("hex"), F.col("_new.is_external").alias("x"), F.lit(1).alias("d")),
            )
        ).alias("_s"),
    )
    counted = both.where(~F.col("_s.x") & (F.col("_s.k") != ERASE_KEY))
    return counted.groupBy("pattern_id", F.col("_s.hex").alias("hex")).agg(F.sum("_s.d").alias("delta"))


def counts_after_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Colour counts updated by the deltas; colours that reach zero are dropped."""
    base = color_counts(cells).select("pattern_id", "hex", "count")
    joined = base.join(count_deltas(cells, edits), ["pattern_id", "hex"], "full")
    total = F.coalesce("count", F.lit(0)) + F.coalesce("delta", F.lit(0))
    return joined.select("pattern_id", "hex", total.alias("count")).where(F.col("count") > 0)
