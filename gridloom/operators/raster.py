"""Raster to colour grid: cell assignment, representative colours, mapping, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import colors
from gridloom.functions.keys import ERASE_HEX, ERASE_KEY
from gridloom.operators.palette import nearest_palette_color
from gridloom.operators.sizing import lookup_side

OPAQUE_ALPHA = 128


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _cells_of(pos: str, extent: Column, parts: Column) -> Column:
    """Indices of the cells along one axis that contain a pixel position.

    Cell i spans [floor(i·e/n), min(e, ceil((i+1)·e/n))), so neighbours overlap when e/n
    is not whole. Only the few indices around pos·n/e can match.
    """
    step = extent / parts
    p = F.col(pos)
    near = F.sequence(
        F.greatest(F.lit(0).cast("bigint"), F.floor(p / step) - 1),
        F.least(parts.cast("bigint") - 1, F.floor((p + 1) / step) + 1),
    )

    def holds(i: Column) -> Column:
        start = F.floor(i * step)
        stop = F.least(extent.cast("bigint"), F.ceil((i + 1) * step))
        return (p >= start) & (p < F.greatest(stop, start + 1))

    return F.filter(near, holds)


def assign_cells(pixels: DataFrame, columns: int, sizes: DataFrame | None = None) -> DataFrame:
    """One row per (pixel, cell) pair with row_idx and col_idx; rows follow the aspect ratio."""
    sizes = sizes if sizes is not None else image_sizes(pixels)
    n = F.lit(columns)
    m = F.greatest(F.lit(1), colors.round_half_up(n * F.col("height") / F.col("width")))
    return (
        pixels.join(sizes.select("image_id", "width", "height", m.alias("_rows")), "image_id")
        .withColumn("row_idx", F.explode(_cells_of("y", F.col("height"), F.col("_rows"))))
        .withColumn("col_idx", F.explode(_cells_of("x", F.col("width"), n)))
        .withColumns({"row_idx": F.col("row_idx").cast("int"), "col_idx": F.col("col_idx").cast("int")})
        .drop("_rows")
    )


def average_color(assigned: DataFrame) -> DataFrame:
    """Mean colour of each cell's opaque pixels; NULL when there is none."""
    opaque = F.col("a") >= OPAQUE_ALPHA
    means = [colors.round_half_up(F.avg(F.when(opaque, F.col(c)))).cast("int").alias(c) for c in "rgb"]
    return assigned.groupBy("image_id", "row_idx", "col_idx").agg(*means)


def dominant_color(assigned: DataFrame) -> DataFrame:
    """Most frequent opaque colour of each cell; NULL when there is none.

    Among equally frequent colours the one that reached the count first wins: its last
    occurrence comes earliest in scan order.
    """
    cell = ["image_id", "row_idx", "col_idx"]
    opaque = F.col("a") >= OPAQUE_ALPHA
    rgb = F.when(opaque, F.struct("r", "g", "b"))
    counts = assigned.groupBy(*cell, rgb.alias("_rgb")).agg(
        F.count(rgb).alias("_n"),
        F.max(F.struct("y", "x")).alias("_last"),
    )
    winner = F.min_by("_rgb", F.struct(-F.col("_n"), F.col("_last"))).alias("_rgb")
    return counts.groupBy(*cell).agg(winner).select(*cell, "_rgb.r", "_rgb.g", "_rgb.b")


def pixelate(
    pixels: DataFrame, image_palettes: DataFrame, palette: DataFrame, columns: int, mode: str = "dominant",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Images to colour grids of `columns` cells per row.

    `image_palettes` (image_id, palette_name) says which palette each image is mapped to;
    `palette` holds all of them. Cells without an opaque pixel become external.
    """
    represent = {"dominant": dominant_color, "average": average_color}[mode]
    grid = represent(assign_cells(pixels, columns, sizes)).join(image_palettes, "image_id")
    return _to_cells(nearest_palette_color(grid, palette, ["palette_name"]))


def _to_cells(matched: DataFrame) -> DataFrame:
    empty = F.col("r").isNull()
    return matched.select(
        F.col("image_id").alias("pattern_id"), "row_idx", "col_idx",
        F.when(empty, ERASE_KEY).otherwise(F.col("match_key")).alias("color_key"),
        F.when(empty, ERASE_HEX).otherwise(F.col("match_hex")).alias("hex"),
        empty.alias("is_external"),
    )


def _entries(cells: DataFrame, palette: DataFrame, image_palettes: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cells and palette with the columns that join them, one palette row for each.

    With `image_palettes` (image_id, palette_name) every image uses its own palette. Without, a key means one colour,
    and of several palettes that have it the first counts.
    """
    if image_palettes is None:
        rest = [c for c in palette.columns if c != "color_key"]
        one = palette.groupBy("color_key").agg(F.min(F.struct(*sorted(rest, key=lambda c: (c != "palette_name", c)))).alias("_p"))
        return cells, one.select("color_key", "_p.*"), ["color_key"]
    named = image_palettes.select(F.col("image_id").alias("pattern_id"), "palette_name").distinct()
    return cells.join(lookup_side(named), "pattern_id", "left"), palette, ["palette_name", "color_key"]


def color_leaders(cells: DataFrame, palette: DataFrame, threshold: float, image_palettes: DataFrame | None = None) -> DataFrame:
    """For every colour of a pattern the colour that stands for it: (pattern_id, color_key, leader).

    Colours are taken by falling count, ties in scan order. Each joins the first earlier
    colour that still stands and is strictly closer than `threshold`, else it stands
    itself. Only the pattern's counted colours are folded, at most one per palette entry.
    """
    cells, palette, on = _entries(cells, palette, image_palettes)
    used = cells.where(~F.col("is_external") & (F.col("color_key") != ERASE_KEY))
    counts = used.groupBy("pattern_id", *on).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("row_idx", "col_idx")).alias("_seen")
    )
    lab = palette.select(*on, colors.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")).alias("at"))
    ranked = (
        counts.join(lookup_side(lab), on)
        .groupBy("pattern_id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), "_seen", "color_key", "at"))).alias("_colors"))
    )

    def place(done: Column, c: Column) -> Column:
        close = F.filter(
            done,
            lambda x: (x["leader"] == x["color_key"]) & (colors.oklab_distance_rounded(x["at"], c["at"]) < threshold),
        )
        leader = F.coalesce(F.get(close, F.lit(0))["color_key"], c["color_key"])
        return F.concat(done, F.array(F.struct(c["color_key"].alias("color_key"), leader.alias("leader"), c["at"].alias("at"))))

    start = F.expr("cast(array() as array<struct<color_key:string,leader:string,at:struct<l:double,a:double,b:double>>>)")
    return ranked.select("pattern_id", F.explode(F.aggregate("_colors", start, place)).alias("_c")).select(
        "pattern_id", "_c.color_key", "_c.leader"
    )


def merge_similar_colors(cells: DataFrame, palette: DataFrame, threshold: float = 30.0, image_palettes: DataFrame | None = None) -> DataFrame:
    """Replace every colour by its leader, within each image's own palette if `image_palettes` is given.

    Positions play no role, and every cell stays one row.
    """
    moved = color_leaders(cells, palette, threshold, image_palettes).where("leader <> color_key")
    if image_palettes is not None:
        moved = moved.join(image_palettes.select(F.col("image_id").alias("pattern_id"), "palette_name").distinct(), "pattern_id")
    _, entries, on = _entries(cells, palette, image_palettes)
    hexes = entries.select(*on, F.col("hex").alias("_hex")).withColumnRenamed("color_key", "leader")
    swap = moved.join(lookup_side(hexes), [*on[:-1], "leader"]).select("pattern_id", "color_key", "leader", "_hex")
    joined = cells.join(swap, ["pattern_id", "color_key"], "left")
    return joined.select(
        "pattern_id", "row_idx", "col_idx",
        F.coalesce("leader", "color_key").alias("color_key"), F.coalesce("_hex", "hex").alias("hex"),
        (F.col("is_external") & F.col("leader").isNull()).alias("is_external"),
    )
