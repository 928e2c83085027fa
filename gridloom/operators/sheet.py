"""Pattern sheets: lattice lines to cells, cell colours, review state, validation.

A sheet row has image_id, the crop (left, top, right, bottom) and its lattice (center_x,
center_y, pitch_x, pitch_y, center_is_cell_center). Analysed cells extend grid cells with
confidence, uncertainty, status, visibility and recommended codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import colors
from gridloom.functions.keys import ERASE_HEX, ERASE_KEY, trim_all
from gridloom.operators.cells import POSITION, color_counts, is_counted
from gridloom.operators.palette import RGB, nearest_k_colors, nearest_palette_color
from gridloom.operators.raster import image_sizes
from gridloom.operators.sizing import lookup_side

# Fixed values of the analysis.
CROP_INSET = 0.16
MINIMUM_VISIBLE = 0.5
FULLY_VISIBLE = 0.98
LINE_TOLERANCE = 0.01
SAMPLES_PER_AXIS = 18
SAMPLE_ALPHA = 32
INK_LUMA = 35
BUCKET_WIDTH = 16
CONFIRMED_FROM = 0.82
REVIEW_SAMPLE = 120
USELESS_LABEL = "无用"


# --- lattice lines and cells ------------------------------------------------

def _distinct_lines(lines: Column) -> Column:
    """Sorted lines without those closer than the tolerance to the last one kept."""
    none = F.expr("cast(array() as array<double>)")
    return F.aggregate(
        F.array_sort(lines), none,
        lambda kept, v: F.when(
            (F.size(kept) == 0) | (F.abs(v - F.try_element_at(kept, F.lit(-1))) > LINE_TOLERANCE), F.concat(kept, F.array(v))
        ).otherwise(kept),
    )


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def axis_boundaries(start: Column, end: Column, center: Column, pitch: Column, centered: Column) -> Column:
    """Lattice lines inside a crop plus both crop ends."""
    start, end, center, pitch = [c.cast("double") for c in (start, end, center, pitch)]
    anchor = F.when(centered, center - pitch / 2).otherwise(center)
    steps = F.sequence(F.floor((start - anchor) / pitch) - 1, F.ceil((end - anchor) / pitch) + 1)
    lines = F.filter(F.transform(steps, lambda k: anchor + k * pitch), lambda v: (v > start) & (v < end))
    empty_crop = ~(_finite(start) & _finite(end)) | (end <= start)
    no_lattice = ~(_finite(center) & _finite(pitch)) | (pitch <= 0)
    return (
        F.when(F.coalesce(empty_crop, F.lit(True)), F.array(F.lit(0.0), F.lit(1.0)))
        .when(F.coalesce(no_lattice, F.lit(True)), F.array(start, end))
        .otherwise(_distinct_lines(F.concat(F.array(start), lines, F.array(end))))
    )


def fixed_boundaries(center: Column, pitch: Column, size: int, centered: Column) -> Column:
    """size + 1 lines of a board from its anchor."""
    anchor = F.when(centered, center - pitch / 2).otherwise(center)
    return _distinct_lines(F.transform(F.sequence(F.lit(0), F.lit(size)), lambda k: anchor + k * pitch))


def normalize_bounds(left: Column, top: Column, right: Column, bottom: Column) -> dict[str, Column]:
    """Bounds with missing starts at 0 and ends at least one further."""
    lo = {"left": F.when(_finite(left), left).otherwise(F.lit(0.0)), "top": F.when(_finite(top), top).otherwise(F.lit(0.0))}
    keep = lambda end, start: F.when(_finite(end) & (end > start), end).otherwise(start + 1)
    return {**lo, "right": keep(right, lo["left"]), "bottom": keep(bottom, lo["top"])}


def clamp_bounds(b: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Whole-pixel bounds inside the image."""
    left = colors.clamp(F.floor(b["left"]), 0, width - 1)
    top = colors.clamp(F.floor(b["top"]), 0, height - 1)
    return {
        "left": left, "top": top,
        "right": colors.clamp(F.ceil(b["right"]), left + 1, width),
        "bottom": colors.clamp(F.ceil(b["bottom"]), top + 1, height),
    }


def clamp_sheets(sheets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sheets whose crop is sanitised and cut to the image."""
    names = ["left", "top", "right", "bottom"]
    normal = normalize_bounds(*[F.col(n).cast("double") for n in names])
    joined = sheets.join(sizes, "image_id")
    # Two steps, so that the clamped columns are not recomputed inside each other.
    joined = joined.withColumns(normal)
    return joined.withColumns(clamp_bounds({n: F.col(n) for n in names}, F.col("width"), F.col("height"))).drop("width", "height")


def manual_sheets(bounds: DataFrame, cols: str = "n_cols", rows: str = "n_rows") -> DataFrame:
    """Lattice that divides given bounds into columns and rows."""
    pitch = lambda lo, hi, n: F.greatest(F.lit(1.0), (F.col(hi) - F.col(lo)) / F.greatest(F.lit(1), F.col(n)))
    return bounds.withColumns(
        {
            "center_x": F.col("left").cast("double"), "center_y": F.col("top").cast("double"),
            "pitch_x": pitch("left", "right", cols), "pitch_y": pitch("top", "bottom", rows),
            "center_is_cell_center": F.lit(False),
        }
    )


def sheet_lines(sheets: DataFrame) -> DataFrame:
    c = F.col
    return sheets.withColumns(
        {
            "x_lines": axis_boundaries(c("left"), c("right"), c("center_x"), c("pitch_x"), c("center_is_cell_center")),
            "y_lines": axis_boundaries(c("top"), c("bottom"), c("center_y"), c("pitch_y"), c("center_is_cell_center")),
        }
    )


def _spans(lines: str) -> Column:
    """Consecutive pairs of lines."""
    c = F.col(lines)
    return F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("a"), F.slice(c, F.lit(2), F.size(c) - 1).alias("b"))


def generate_cells(sheets: DataFrame, explicit_lines: bool = False) -> DataFrame:
    """Cells between the lines x_lines and y_lines, with inset crop and visibility.

    The visible share is measured against the lattice pitch, or, for explicit lines,
    against the crop.
    """
    spans = (
        sheets.select("*", F.posexplode(_spans("y_lines")).alias("row_idx", "_v"))
        .select("*", F.posexplode(_spans("x_lines")).alias("col_idx", "_h"))
        .withColumns({"x": F.col("_h.a"), "y": F.col("_v.a"), "w": F.col("_h.b") - F.col("_h.a"), "h": F.col("_v.b") - F.col("_v.a")})
    )
    c = F.col
    if explicit_lines:
        overlap = lambda lo, size, a, b: F.greatest(F.lit(0.0), F.least(c(lo) + c(size), c(b)) - F.greatest(c(lo), c(a)))
        seen = overlap("x", "w", "left", "right") * overlap("y", "h", "top", "bottom") / F.greatest(F.lit(1.0), c("w") * c("h"))
    else:
        seen = F.least(c("w") / F.greatest(F.lit(1.0), c("pitch_x")), c("h") / F.greatest(F.lit(1.0), c("pitch_y")))
    inset = lambda size: F.greatest(F.lit(0.0), c(size) * CROP_INSET)
    crops = {
        "crop_x": F.floor(c("x") + inset("w")), "crop_y": F.floor(c("y") + inset("h")),
        "crop_w": F.greatest(F.lit(1), F.floor(c("w") - inset("w") * 2)), "crop_h": F.greatest(F.lit(1), F.floor(c("h") - inset("h") * 2)),
    }
    out = spans.withColumns({**crops, "visible_ratio": colors.clamp(seen, 0.0, 1.0)})
    return out.select(
        "image_id", *POSITION, "x", "y", c("w").alias("cell_w"), c("h").alias("cell_h"), *crops, "visible_ratio",
        F.when(c("visible_ratio") < MINIMUM_VISIBLE, "partial").otherwise("full").alias("visibility"),
    )


# --- cell colours -----------------------------------------------------------

def _sample_positions(start: str, size: str, extent: str) -> Column:
    lo = colors.clamp(F.col(start), 0, F.col(extent) - 1)
    hi = colors.clamp(F.col(start) + F.col(size), 0, F.col(extent))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor((hi - lo) / SAMPLES_PER_AXIS))
    return F.when(hi > lo, F.sequence(lo, hi - 1, step))


def sample_dominant_color(pixels: DataFrame, crops: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Main colour of each crop: (image_id, row_idx, col_idx, r, g, b).

    A crop is sampled at a stride; samples fall into 16-wide RGB buckets, dark ones with
    less weight, and the heaviest bucket's mean is taken, ties to the bucket met first.
    Sample points meet the pixels by position, so each pixel is shuffled once. Weights
    are whole hundredths, which keeps ties exact.
    """
    sizes = sizes if sizes is not None else image_sizes(pixels)
    points = (
        crops.join(sizes, "image_id")
        .select("image_id", *POSITION, "crop_x", "crop_w", "width", F.explode(_sample_positions("crop_y", "crop_h", "height")).alias("y"))
        .select("image_id", *POSITION, "y", F.explode(_sample_positions("crop_x", "crop_w", "width")).alias("x"))
        .withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})
    )
    weight = F.when(colors.luma(F.col("r"), F.col("g"), F.col("b")) < INK_LUMA, 35).otherwise(100).cast("bigint")
    bucket = [colors.round_half_up(F.col(c) / BUCKET_WIDTH).alias(f"_b{c}") for c in "rgb"]
    cell = ["image_id", *POSITION]
    heavy = (
        points.join(pixels.where(F.col("a") >= SAMPLE_ALPHA), ["image_id", "x", "y"])
        .withColumn("_w", weight)
        .groupBy(*cell, *bucket)
        .agg(
            F.sum("_w").alias("_n"), *[F.sum(F.col(c) * F.col("_w")).alias(f"_{c}") for c in "rgb"],
            F.min(F.struct("y", "x")).alias("_at"),
        )
    )
    mean = F.struct(*[colors.round_half_up(F.col(f"_{c}") / F.col("_n")).cast("int").alias(c) for c in "rgb"])
    return heavy.groupBy(*cell).agg(F.min_by(mean, F.struct(-F.col("_n"), F.col("_at"))).alias("_c")).select(*cell, "_c.*")


def analyze_sheet(
    pixels: DataFrame, sheets: DataFrame, palette: DataFrame, near_white_is_empty: bool = False, white_from: int = 246
) -> DataFrame:
    """Sheets to analysed cells. A sheet names its palette in palette_name."""
    sizes = image_sizes(pixels)
    grid = generate_cells(sheet_lines(clamp_sheets(sheets, sizes)))
    sampled = sample_dominant_color(pixels, grid.where("visibility = 'full'"), sizes)
    cell = ["image_id", *POSITION]
    known = grid.join(sampled, cell, "left").join(sheets.select("image_id", "palette_name"), "image_id")
    ranked = nearest_k_colors(known, palette, ["palette_name"], 5)
    near = F.get("nearest", F.lit(0))
    unsampled = F.col("r").isNull()
    white = F.lit(near_white_is_empty) & colors.is_near_white(*[F.col(c) for c in RGB], white_from)
    empty = unsampled | F.coalesce(white, F.lit(False))
    confidence = F.when(unsampled, 1.0).when(empty, 0.7).otherwise(colors.distance_to_confidence(near["distance"]))
    scored = ranked.withColumns({"is_external": empty, "confidence": confidence, "_near": near})
    sure = F.col("confidence") >= CONFIRMED_FROM
    return scored.select(
        F.col("image_id").alias("pattern_id"), *POSITION,
        F.when(empty, ERASE_KEY).otherwise(F.col("_near.color_key")).alias("color_key"),
        F.when(empty, ERASE_HEX).otherwise(F.upper("_near.hex")).alias("hex"), "is_external", "confidence",
        F.when(unsampled, 0.0).when(empty, 0.3).otherwise(1 - F.col("confidence")).alias("uncertainty"),
        F.when(empty, "transparent").when(sure, "confirmed").otherwise("pending").alias("status"),
        "visibility", "visible_ratio",
        F.when(~empty, F.transform("nearest", lambda n: n["color_key"])).alias("recommended_keys"),
    )


# --- palette compliance -----------------------------------------------------

def annotate_extra_colors(counts: DataFrame, palette: DataFrame) -> DataFrame:
    """Adds is_extra and, for colours outside the palette, the recommended replacement.

    `counts` names each pattern's palette in palette_name; without such a palette nothing
    is extra.
    """
    members = palette.select("palette_name", F.upper("color_key").alias("_key")).distinct().withColumn("_in", F.lit(True))
    named = palette.select("palette_name").distinct().withColumn("_named", F.lit(True))
    judged = (
        counts.withColumn("_key", F.upper("color_key"))
        .join(lookup_side(members), ["palette_name", "_key"], "left").join(lookup_side(named), "palette_name", "left")
        .withColumn("is_extra", F.col("_named").isNotNull() & F.col("_in").isNull()).drop("_key", "_in", "_named")
    )
    channels = {c: F.when(F.col("is_extra"), colors.hex_channel(F.col("hex"), i)) for i, c in enumerate(RGB)}
    matched = nearest_palette_color(judged.withColumns(channels), palette, ["palette_name"])
    return matched.select(
        *counts.columns, "is_extra", F.col("match_key").alias("recommended_key"), F.upper("match_hex").alias("recommended_hex")
    )


def palette_issues(counts: DataFrame, palette: DataFrame) -> DataFrame:
    """Colours outside the palette that have a replacement."""
    return annotate_extra_colors(counts, palette).where(F.col("is_extra") & F.col("recommended_key").isNotNull()).drop("is_extra")


def remap_to_palette(analyzed: DataFrame, palette: DataFrame) -> DataFrame:
    """Replace every cell colour outside the pattern's palette (palette_name) by its recommendation.

    Recommendations are worked out once per distinct colour and joined to the cells.
    """
    used = analyzed.where(is_counted()).select("palette_name", "color_key", "hex").distinct()
    swap = palette_issues(used, palette)
    on = ["palette_name", "color_key", "hex"]
    joined = analyzed.join(swap, on, "left")
    hit = is_counted() & F.col("recommended_key").isNotNull()
    return joined.select(
        "pattern_id", *POSITION, F.when(hit, F.col("recommended_key")).otherwise(F.col("color_key")).alias("color_key"),
        F.when(hit, F.col("recommended_hex")).otherwise(F.col("hex")).alias("hex"), "is_external",
        F.when(hit, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.least("uncertainty", F.lit(0.1))).otherwise(F.col("uncertainty")).alias("uncertainty"),
        F.when(hit, "changed").otherwise(F.col("status")).alias("status"), "visibility", "visible_ratio",
        F.when(hit, F.array("recommended_key")).otherwise(F.col("recommended_keys")).alias("recommended_keys"),
    )


# --- corrections and review -------------------------------------------------

def _corrected(joined: DataFrame, hit: Column, columns: list[str]) -> DataFrame:
    """Apply a manual correction (target_key NULL means transparent) to the hit rows."""
    clear = hit & F.col("target_key").isNull()
    paint = hit & F.col("target_key").isNotNull()
    new = {
        "color_key": F.when(clear, ERASE_KEY).when(paint, F.col("target_key")).otherwise(F.col("color_key")),
        "hex": F.when(clear, ERASE_HEX).when(paint, F.upper("target_hex")).otherwise(F.col("hex")),
        "is_external": F.when(clear, True).when(paint, False).otherwise(F.col("is_external")),
        "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
        "uncertainty": F.when(hit, 0.0).otherwise(F.col("uncertainty")),
        "status": F.when(clear, "transparent").when(paint, "changed").otherwise(F.col("status")),
    }
    return joined.select(*[new[c].alias(c) if c in new else c for c in columns])


def update_cells(analyzed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Set single cells (pattern_id, row_idx, col_idx, target_key, target_hex)."""
    cell = ["pattern_id", *POSITION]
    marked = corrections.select(*cell, "target_key", "target_hex", F.lit(True).alias("_hit"))
    return _corrected(analyzed.join(marked, cell, "left"), F.coalesce("_hit", F.lit(False)), analyzed.columns)


def update_color_groups(analyzed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Set all cells of a code (pattern_id, color_key, target_key, target_hex)."""
    marked = corrections.select("pattern_id", "color_key", "target_key", "target_hex", F.lit(True).alias("_hit"))
    joined = analyzed.join(marked, ["pattern_id", "color_key"], "left")
    return _corrected(joined, F.coalesce("_hit", F.lit(False)) & ~F.col("is_external"), analyzed.columns)


def is_useless_cell() -> Column:
    return (
        (F.col("status") == "transparent") | (F.col("visibility") == "partial")
        | (F.coalesce("visible_ratio", F.lit(1.0)) < FULLY_VISIBLE)
    )


def color_review_summary(analyzed: DataFrame) -> DataFrame:
    """Cells, pending and changed cells per colour, and one row for the useless cells."""
    by_key = analyzed.where(~F.col("is_external")).groupBy("pattern_id", "color_key").agg(
        F.count_if(F.col("status") == "pending").alias("pending_count"), F.count_if(F.col("status") == "changed").alias("changed_count")
    )
    normal = color_counts(analyzed).join(by_key, ["pattern_id", "color_key"]).withColumn("is_useless", F.lit(False))
    useless = analyzed.where(is_useless_cell()).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("status") == "changed").alias("changed_count")
    ).select(
        "pattern_id", F.lit(ERASE_KEY).alias("color_key"), F.lit(ERASE_HEX).alias("hex"), "count",
        F.lit(0).cast("bigint").alias("pending_count"), "changed_count", F.lit(True).alias("is_useless"),
    )
    return normal.unionByName(useless)


def color_family_rollup(summary: DataFrame) -> DataFrame:
    """Cells per family and colour with family totals (NULL code) and pattern totals (NULL family)."""
    letters = F.upper(F.regexp_extract("color_key", r"^[A-Za-z]+", 0))
    family = F.when(F.col("color_key") == ERASE_KEY, USELESS_LABEL).when(letters != "", letters).otherwise("#")
    levels = summary.withColumn("family", family).rollup("pattern_id", "family", "color_key")
    # 7 marks the total over all patterns; a pattern without id is a pattern like others
    return levels.agg(F.sum("count").alias("count"), F.grouping_id().alias("_level")).where("_level < 7").drop("_level")


def review_cells(analyzed: DataFrame, sample: int | None = REVIEW_SAMPLE, partial: bool = False) -> DataFrame:
    """Cells to look at per colour, most uncertain first; fully visible ones if there are any.

    `sample` is the number per colour (None: all); `partial` keeps partly visible cells beside full ones. Useless cells form the group of the erase code. Ranking with the visible ones first
    keeps the row limit inside the window, which prunes before the shuffle.
    """
    normal = analyzed.where(~F.col("is_external")).withColumn("review_key", F.col("color_key"))
    useless = analyzed.where(is_useless_cell()).withColumn("review_key", F.lit(ERASE_KEY))
    full = (F.col("visibility") != "partial") & (F.coalesce("visible_ratio", F.lit(1.0)) >= FULLY_VISIBLE)
    order = Window.partitionBy("pattern_id", "review_key").orderBy(F.desc("_full"), F.desc("uncertainty"), *POSITION)
    top = normal.unionByName(useless).withColumn("_full", full).withColumn("review_rank", F.row_number().over(order)).where(
        F.lit(True) if sample is None else F.col("review_rank") <= sample
    )
    if partial:
        return top.drop("_full")
    group = Window.partitionBy("pattern_id", "review_key")
    return top.withColumn("_any", F.bool_or("_full").over(group)).where(F.col("_full") | ~F.col("_any")).drop("_full", "_any")


def validate_pattern(patterns: DataFrame, cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Violations (pattern_id, rule, n) of patterns (pattern_id, n_rows, n_cols, total); never raises."""
    row_sizes = cells.groupBy("pattern_id", "row_idx").agg(F.count(F.lit(1)).alias("_len"))
    shape = row_sizes.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_len").alias("_hi"), F.min("_len").alias("_lo")
    )
    bad_key = F.coalesce(trim_all(F.col("color_key")) == "", F.lit(True))
    bad_hex = ~F.coalesce(F.col("hex").rlike(colors.STRICT_HEX_PATTERN), F.lit(False))
    content = cells.groupBy("pattern_id").agg(
        F.count_if(bad_key).alias("_keys"), F.count_if(bad_hex).alias("_hexes"), F.count_if(is_counted()).alias("_beads")
    )
    bad_count = ~F.coalesce(F.col("count") > 0, F.lit(False))
    listed = counts.groupBy("pattern_id").agg(
        F.count_if(bad_key).alias("_ckeys"), F.count_if(bad_hex).alias("_chexes"), F.count_if(bad_count).alias("_ccounts"),
        F.sum("count").alias("_sum"),
    )
    facts = patterns.join(shape, "pattern_id", "left").join(content, "pattern_id", "left").join(listed, "pattern_id", "left")
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    flag = lambda cond: F.when(F.coalesce(cond, F.lit(True)), 1).otherwise(0).cast("bigint")
    rules = {
        "dimensions": flag(~(positive("n_rows") & positive("n_cols"))),
        "row_count": flag(F.col("_rows") != F.col("n_rows")),
        "column_count": flag((F.col("_hi") != F.col("n_cols")) | (F.col("_lo") != F.col("n_cols"))),
        "cell_key": F.coalesce("_keys", F.lit(0)), "cell_hex": F.coalesce("_hexes", F.lit(0)),
        "color_counts": flag(F.col("_sum").isNull()),
        "total": flag(~F.coalesce(F.col("total") >= 0, F.lit(False))),
        "total_of_cells": flag(F.col("_beads") != F.col("total")),
        "count_hex": F.coalesce("_chexes", F.lit(0)), "count_value": F.coalesce("_ccounts", F.lit(0)),
        "count_key": F.coalesce("_ckeys", F.lit(0)), "total_of_counts": flag(F.col("_sum") != F.col("total")),
    }
    listed_rules = F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("bigint").alias("n")) for k, v in rules.items()])
    return facts.select("pattern_id", F.explode(F.filter(listed_rules, lambda r: r["n"] > 0)).alias("_v")).select("pattern_id", "_v.*")


def pattern_save_metrics(analyzed: DataFrame, annotated: DataFrame) -> DataFrame:
    """Pending cells and, from annotated counts, extra colours and beads per pattern."""
    pending = analyzed.groupBy("pattern_id").agg(F.count_if(F.col("status") == "pending").alias("pending_cells"))
    extra = annotated.where("is_extra").groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("extra_colors"), F.sum("count").alias("extra_beads")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pending.join(extra, "pattern_id", "left").select("pattern_id", "pending_cells", zero("extra_colors"), zero("extra_beads"))
