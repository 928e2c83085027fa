"""Counting, replacing and sampling on colour grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import colors
from gridloom.functions.keys import ERASE_HEX, ERASE_KEY
from gridloom.operators.sizing import lookup_side

POSITION = ["row_idx", "col_idx"]


def is_counted() -> Column:
    return ~F.col("is_external") & (F.col("color_key") != ERASE_KEY)


def grid_sizes(cells: DataFrame) -> DataFrame:
    """Rows and columns of every grid."""
    return cells.groupBy("pattern_id").agg(
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols")
    )


def color_counts(cells: DataFrame) -> DataFrame:
    """Cells per pattern and colour; the code is the first one met in scan order."""
    return cells.where(is_counted()).groupBy("pattern_id", F.upper("hex").alias("hex")).agg(
        F.count(F.lit(1)).alias("count"), F.min_by("color_key", F.struct(*POSITION)).alias("color_key")
    )


def bead_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("pattern_id").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_colors"))


def grid_colors(cells: DataFrame) -> DataFrame:
    """The distinct colours of each grid with the code of their first cell."""
    return cells.where(~F.col("is_external")).groupBy("pattern_id", F.upper("hex").alias("hex")).agg(
        F.min_by("color_key", F.struct(*POSITION)).alias("color_key")
    )


def rank_by_hue(df: DataFrame, keys: list[str], hex_col: str = "hex") -> DataFrame:
    """Adds `hue_rank` inside each key; meant for distinct colours, a few hundred per key."""
    w = Window.partitionBy(*keys).orderBy(*colors.hue_order(F.col(hex_col)))
    return df.withColumn("hue_rank", F.row_number().over(w))


def preview_grid(cells: DataFrame, limit: int = 18) -> DataFrame:
    """Every n-th row and column so that at most `limit` of each remain."""
    steps = grid_sizes(cells).select(
        "pattern_id",
        *[F.greatest(F.lit(1), F.ceil(F.col(c) / limit)).alias(s) for c, s in (("n_rows", "_rs"), ("n_cols", "_cs"))],
    )
    return (
        cells.join(steps, "pattern_id")
        .where((F.col("row_idx") % F.col("_rs") == 0) & (F.col("col_idx") % F.col("_cs") == 0))
        .drop("_rs", "_cs")
    )


def border_background_color(cells: DataFrame) -> DataFrame:
    """Most frequent code on the border ring of each grid; ties go to the first in ring order.

    Ring order: top and bottom cell of each column from the left, then left and right
    cell of each inner row from the top.
    """
    row, col = F.col("row_idx"), F.col("col_idx")
    last_row, last_col = F.col("n_rows") - 1, F.col("n_cols") - 1
    ring = F.when(row == 0, col * 2).when(row == last_row, col * 2 + 1).otherwise(
        F.col("n_cols") * 2 + (row - 1) * 2 + F.when(col == 0, 0).otherwise(1)
    )
    border = cells.where(is_counted()).join(grid_sizes(cells), "pattern_id").where(
        (row == 0) | (row == last_row) | (col == 0) | (col == last_col)
    )
    counts = border.groupBy("pattern_id", "color_key").agg(F.count(F.lit(1)).alias("n"), F.min(ring).alias("_at"))
    return counts.groupBy("pattern_id").agg(
        F.min_by(F.struct("color_key", "n"), F.struct(-F.col("n"), F.col("_at"))).alias("_w")
    ).select("pattern_id", "_w.color_key", F.col("_w.n").alias("border_cells"))


def replace_color(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply replacements (pattern_id, source_hex, target_key, target_hex); adds `is_replaced`."""
    swap = rules.select(
        F.col("pattern_id").alias("_pattern"), F.upper("source_hex").alias("_src"), "target_key", "target_hex"
    )
    hit = (F.col("pattern_id") == F.col("_pattern")) & (F.upper("hex") == F.col("_src")) & ~F.col("is_external")
    done = F.col("target_key").isNotNull()
    return cells.join(swap, hit, "left").select(
        "pattern_id", *POSITION,
        F.coalesce("target_key", "color_key").alias("color_key"), F.coalesce("target_hex", "hex").alias("hex"),
        (F.col("is_external") & ~done).alias("is_external"), done.alias("is_replaced"),
    )


def exclusion_targets(initial: DataFrame, requests: DataFrame, excluded: DataFrame, palette: DataFrame) -> DataFrame:
    """Where each excluded colour goes: (pattern_id, hex, target_key, target_hex, reason).

    Targets are the colours the grid started with, less this and all earlier exclusions.
    `reason` is set when the request is refused because no target is left or the colour
    is not in the palette.
    """
    lab = palette.select(
        F.upper("hex").alias("hex"), "ord", "color_key",
        colors.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")).alias("at"),
    )
    lab = lookup_side(lab)
    usable = (
        initial.select("pattern_id", F.upper("hex").alias("hex")).distinct()
        .join(excluded.select("pattern_id", F.upper("hex").alias("hex")), ["pattern_id", "hex"], "left_anti")
        .join(lab, "hex")
        .groupBy("pattern_id")
        .agg(F.collect_list(F.struct("hex", "ord", "color_key", "at")).alias("_targets"))
    )
    asked = requests.select("pattern_id", F.upper("hex").alias("hex")).join(lab.select("hex", "at"), "hex", "left")
    own = F.col("hex")
    others = F.filter("_targets", lambda t: t["hex"] != own)
    best = F.array_min(
        F.transform(
            others,
            lambda t: F.struct(
                colors.oklab_distance_rounded(F.col("at"), t["at"]).alias("d"), t["ord"].alias("ord"),
                t["color_key"].alias("color_key"), t["hex"].alias("hex"),
            ),
        )
    )
    found = asked.join(usable, "pattern_id", "left").withColumn("_best", F.when(F.col("at").isNotNull(), best))
    return found.select(
        "pattern_id", "hex", F.col("_best.color_key").alias("target_key"), F.col("_best.hex").alias("target_hex"),
        F.when(F.coalesce(F.size(others), F.lit(0)) <= 0, "no_target_left").when(F.col("at").isNull(), "unknown_color").alias("reason"),
    )


def exclude_and_remap(
    cells: DataFrame, initial: DataFrame, requests: DataFrame, excluded: DataFrame, palette: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remap one excluded colour per pattern to its nearest remaining colour; refusals come second."""
    targets = exclusion_targets(initial, requests, excluded, palette)
    rules = targets.where("reason is null").withColumnRenamed("hex", "source_hex")
    return replace_color(cells, rules).drop("is_replaced"), targets.where("reason is not null").select("pattern_id", "hex", "reason")


def erase_where(cells: DataFrame, flag: Column) -> DataFrame:
    """Turn the flagged cells transparent."""
    return cells.select(
        "pattern_id", *POSITION,
        F.when(flag, ERASE_KEY).otherwise(F.col("color_key")).alias("color_key"),
        F.when(flag, ERASE_HEX).otherwise(F.col("hex")).alias("hex"),
        (F.col("is_external") | flag).alias("is_external"),
    )
