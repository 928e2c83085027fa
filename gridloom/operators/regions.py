"""Connected regions of equal colour on grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.lineage import cut_lineage
from gridloom.operators.cells import POSITION, border_background_color, erase_where, grid_sizes, is_counted
from gridloom.operators.components import connected_components

# Side of the square tiles labelled inside one task: a bounded group whatever the grid's size.
TILE = 64
# A cell is numbered row · 2^31 + column, which sorts in scan order.
ROW_SHIFT = 31


def cell_number(row: str = "row_idx", col: str = "col_idx"):
    return F.col(row).cast("bigint") * 2**ROW_SHIFT + F.col(col)


def _label_tile(codes: np.ndarray) -> np.ndarray:
    """Smallest cell index of each cell's 4-connected region of equal code; -1 stays -1."""
    h, w = codes.shape
    label = np.where(codes >= 0, np.arange(h * w).reshape(h, w), -1)
    down = (codes[1:] == codes[:-1]) & (codes[1:] >= 0)
    right = (codes[:, 1:] == codes[:, :-1]) & (codes[:, 1:] >= 0)
    inside = codes >= 0
    while True:
        before = label.copy()
        for same, a, b in ((down, label[1:], label[:-1]), (right, label[:, 1:], label[:, :-1])):
            low = np.minimum(a, b)
            # Move the smaller label onto the roots of both cells, then onto the cells.
            flat = label.reshape(-1)
            for side in (a, b):
                np.minimum.at(flat, side[same], low[same])
            a[same] = low[same]
            b[same] = np.minimum(b[same], low[same])
        flat = label.reshape(-1)
        label[inside] = flat[label[inside]]
        if np.array_equal(before, label):
            return label


def _tile_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    r0, c0 = int(pdf["row_idx"].min()), int(pdf["col_idx"].min())
    r, c = pdf["row_idx"].to_numpy() - r0, pdf["col_idx"].to_numpy() - c0
    codes = np.full((r.max() + 1, c.max() + 1), -1, dtype=np.int64)
    codes[r, c] = pd.factorize(pdf["color"])[0]
    label = _label_tile(codes)[r, c]
    w = codes.shape[1]
    out = pdf[["pattern_id", "row_idx", "col_idx", "color"]].copy()
    out["part"] = ((label // w + r0).astype(np.int64) << ROW_SHIFT) + (label % w + c0)
    return out


def label_regions(cells: DataFrame, by: str = "hex") -> DataFrame:
    """Region of every counted cell: (pattern_id, row_idx, col_idx, color, region_id).

    Regions are 4-connected cells of equal `by`; region_id is the number of the region's
    first cell in scan order. Grids are cut into 64 × 64 tiles. A task labels one tile;
    labels that touch across a tile edge are joined by the component routine, which
    therefore sees tile-edge pairs only, not cells.
    """
    kind = cells.schema["pattern_id"].dataType.simpleString()
    tile = [F.floor(F.col(c) / TILE).alias(f"_t{c}") for c in POSITION]
    parts = (
        cells.where(~F.col("is_external"))
        .select("pattern_id", *POSITION, F.col(by).alias("color"))
        .groupBy("pattern_id", *tile)
        .applyInPandas(_tile_labels, f"pattern_id {kind}, row_idx int, col_idx int, color string, part bigint")
    )
    parts = cut_lineage(parts)

    def across(axis: str) -> DataFrame:
        step = {c: (F.col(c) + 1 if c == axis else F.col(c)).alias(c) for c in POSITION}
        near = parts.where(F.col(axis) % TILE == TILE - 1).select("pattern_id", *step.values(), "color", F.col("part").alias("u"))
        far = parts.where((F.col(axis) % TILE == 0) & (F.col(axis) > 0)).select("pattern_id", *POSITION, "color", F.col("part").alias("v"))
        return near.join(far, ["pattern_id", *POSITION, "color"]).select("pattern_id", "u", "v")

    roots = connected_components(across("row_idx").unionAll(across("col_idx")), ["pattern_id"])
    roots = roots.select("pattern_id", F.col("node").alias("part"), "component")
    return parts.join(roots, ["pattern_id", "part"], "left").select(
        "pattern_id", *POSITION, "color", F.coalesce("component", "part").alias("region_id")
    )


def region_summary(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Size, centre and whether a region touches the edge of its grid."""
    edge = (
        (F.col("row_idx") == 0) | (F.col("col_idx") == 0)
        | (F.col("row_idx") == F.col("n_rows") - 1) | (F.col("col_idx") == F.col("n_cols") - 1)
    )
    return labels.join(sizes, "pattern_id").groupBy("pattern_id", "color", "region_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.floor(F.avg("row_idx")).alias("center_row"), F.floor(F.avg("col_idx")).alias("center_col"),
        F.bool_or(edge).alias("touches_edge"),
    )


def flood_region(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Cells of the regions that hold a seed cell; seeds outside or on external cells give none."""
    hit = labels.join(seeds.select("pattern_id", *POSITION), ["pattern_id", *POSITION], "left_semi")
    return labels.join(hit.select("pattern_id", "region_id").distinct(), ["pattern_id", "region_id"], "left_semi")


def flood_erase(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Erase the region of equal code around each seed."""
    gone = flood_region(label_regions(cells, "color_key"), seeds).select("pattern_id", *POSITION, F.lit(True).alias("_gone"))
    return erase_where(cells.join(gone, ["pattern_id", *POSITION], "left"), F.coalesce("_gone", F.lit(False)))


def remove_background(cells: DataFrame) -> DataFrame:
    """Erase the border's main colour wherever it is connected to the border.

    Only cells of that colour are labelled.
    """
    back = border_background_color(cells).select("pattern_id", "color_key")
    candidates = cells.where(is_counted()).join(back, ["pattern_id", "color_key"], "left_semi")
    labels = label_regions(candidates, "color_key")
    touching = region_summary(labels, grid_sizes(cells)).where("touches_edge").select("pattern_id", "region_id")
    gone = labels.join(touching, ["pattern_id", "region_id"], "left_semi").select(
        "pattern_id", *POSITION, F.lit(True).alias("_gone")
    )
    return erase_where(cells.join(gone, ["pattern_id", *POSITION], "left"), F.coalesce("_gone", F.lit(False)))


def region_completion(labels: DataFrame, completed: DataFrame) -> DataFrame:
    """Whether all or any cells of a region are in `completed` (pattern_id, row_idx, col_idx)."""
    done = completed.select("pattern_id", *POSITION).distinct().withColumn("_done", F.lit(True))
    marked = labels.join(done, ["pattern_id", *POSITION], "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    return marked.groupBy("pattern_id", "color", "region_id").agg(
        F.bool_and("_done").alias("all_done"), F.bool_or("_done").alias("any_done")
    )


def recommend_region(
    summary: DataFrame, completion: DataFrame, sizes: DataFrame, mode: str, selected: DataFrame | None = None
) -> DataFrame:
    """Next unfinished region per pattern and colour.

    nearest: closest centre (Manhattan) to the selected cell or the middle of the grid;
    largest: most cells; edge-first: regions at the edge before others. Ties go to the
    region met first in scan order.
    """
    todo = summary.join(completion.where(~F.col("all_done")), ["pattern_id", "color", "region_id"], "left_semi")
    if mode == "nearest":
        start = sizes.select(
            "pattern_id", F.floor(F.col("n_rows") / 2).alias("_r"), F.floor(F.col("n_cols") / 2).alias("_c")
        )
        if selected is not None:
            chosen = selected.select("pattern_id", F.col("row_idx").alias("_sr"), F.col("col_idx").alias("_sc"))
            start = start.join(chosen, "pattern_id", "left").select(
                "pattern_id", F.coalesce("_sr", "_r").alias("_r"), F.coalesce("_sc", "_c").alias("_c")
            )
        todo = todo.join(start, "pattern_id")
        first = F.abs(F.col("center_row") - F.col("_r")) + F.abs(F.col("center_col") - F.col("_c"))
    elif mode == "largest":
        first = -F.col("size")
    elif mode == "edge-first":
        first = F.when(F.col("touches_edge"), 0).otherwise(1)
    else:
        raise ValueError(f"unknown mode {mode}")
    pick = F.struct("region_id", "size", "center_row", "center_col")
    return todo.groupBy("pattern_id", "color").agg(F.min_by(pick, F.struct(first, "region_id")).alias("_p")).select(
        "pattern_id", "color", "_p.*"
    )


def color_progress(cells: DataFrame, completed: DataFrame) -> DataFrame:
    """Total, completed and rounded percent per colour, in order of first appearance."""
    done = completed.select("pattern_id", *POSITION).distinct().withColumn("_done", F.lit(1))
    counted = cells.where(is_counted()).join(done, ["pattern_id", *POSITION], "left")
    by_color = counted.groupBy("pattern_id", "hex").agg(
        F.count(F.lit(1)).alias("total"), F.count("_done").alias("completed"), F.min(cell_number()).alias("_first")
    )
    order = Window.partitionBy("pattern_id").orderBy("_first")
    return by_color.select(
        "pattern_id", "hex", "total", "completed",
        F.floor(F.col("completed") * 100 / F.col("total") + 0.5).alias("percent"),
        (F.row_number().over(order) - 1).alias("color_idx"),
    )


def next_unfinished_color(progress: DataFrame, current: DataFrame) -> DataFrame:
    """The next colour with open cells after the current one, cyclically, and whether all are done."""
    n = progress.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(F.col("completed") >= F.col("total")).alias("all_done")
    )
    at = current.join(progress, ["pattern_id", "hex"]).select("pattern_id", F.col("color_idx").alias("_at")).join(n, "pattern_id")
    steps = progress.join(at, "pattern_id").withColumn("_step", F.pmod(F.col("color_idx") - F.col("_at"), F.col("_n")))
    open_ = (F.col("completed") < F.col("total")) & (F.col("_step") > 0)
    return steps.groupBy("pattern_id").agg(
        F.min_by(F.when(open_, F.col("hex")), F.when(open_, F.col("_step"))).alias("next_hex"),
        F.first("all_done").alias("all_done"),
    )
