import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as cell_ops
from gridloom.operators import raster
from gridloom.operators.palette import nearest_k_colors, nearest_palette_color
from helpers import draw, grid, palette

PIXELS = "image_id int, x int, y int, r int, g int, b int, a int"


def image(spark, text, image_id=1):
    data = [(image_id, x, y, ord(ch), 0, 0, 0 if ch == "." else 255) for y, line in enumerate(text.split()) for x, ch in enumerate(line)]
    return spark.createDataFrame(data, PIXELS)


def test_dominant_tie_goes_to_the_colour_that_reached_the_count_first(spark, rows):
    one = raster.dominant_color(raster.assign_cells(image(spark, "AB BA"), 1))
    assert rows(one, "r") == [(ord("B"),)]


def test_overlapping_windows(spark, rows):
    cells = raster.assign_cells(image(spark, "ABCDEFGHIJ"), 3).groupBy("col_idx").agg(F.min("x"), F.max("x"))
    assert rows(cells) == [(0, 0, 3), (1, 3, 6), (2, 6, 9)]


@pytest.mark.parametrize("width, height, n", [(21, 13, 8), (7, 9, 7), (3, 2, 5), (10, 1, 3)])
def test_cells_match_brute_force(spark, rows, width, height, n):
    rnd = random.Random(width)
    px = {(x, y): rnd.choice([10, 20, 30, None]) for x in range(width) for y in range(height)}
    df = spark.createDataFrame([(1, x, y, v or 0, 0, 0, 0 if v is None else 255) for (x, y), v in px.items()], PIXELS)
    m = max(1, math.floor(n * height / width + 0.5))
    dominant, average = {}, {}
    for j in range(m):
        for i in range(n):
            x0, y0 = math.floor(i * (width / n)), math.floor(j * (height / m))
            x1 = x0 + max(1, min(width, math.ceil((i + 1) * (width / n))) - x0)
            y1 = y0 + max(1, min(height, math.ceil((j + 1) * (height / m))) - y0)
            seen = [px[x, y] for y in range(y0, y1) for x in range(x0, x1) if px[x, y] is not None]
            count, best = {}, None
            for v in seen:
                count[v] = count.get(v, 0) + 1
                if best is None or count[v] > count[best]:
                    best = v
            dominant[j, i] = best
            average[j, i] = math.floor(sum(seen) / len(seen) + 0.5) if seen else None
    assigned = raster.assign_cells(df, n)
    for fn, want in ((raster.dominant_color, dominant), (raster.average_color, average)):
        assert {(r.row_idx, r.col_idx): r.r for r in fn(assigned).collect()} == want


def test_pixelate_marks_empty_cells(spark):
    pal = palette(spark, [("A1", "#410000"), ("B1", "#420000")])
    use = spark.createDataFrame([(1, "p")], "image_id int, palette_name string")
    out = raster.pixelate(image(spark, "AA.. BB.."), use, pal, 2)
    assert {(r.row_idx, r.col_idx, r.color_key, r.is_external) for r in out.collect()} == {(0, 0, "A1", False), (0, 1, "ERASE", True)}


def test_nearest_prefers_palette_order_and_handles_an_unknown_palette(spark, rows):
    pal = palette(spark, [("X", "#000000"), ("Y", "#000000"), ("Z", "#FFFFFF")])
    asked = spark.createDataFrame([("p", 1, 1, 1), ("none", 9, 9, 9), ("p", None, None, None)], "palette_name string, r int, g int, b int")
    assert rows(nearest_palette_color(asked, pal, ["palette_name"]), "palette_name", "match_key") == [("none", "ERR"), ("p", "X"), ("p", None)]
    top = nearest_k_colors(asked.where("r = 1"), pal, ["palette_name"], 2).first()["nearest"]
    assert [n.color_key for n in top] == ["X", "Y"]


def merged(spark, text, colors_, threshold):
    pal = palette(spark, colors_)
    cells = grid(spark, text).drop("hex").join(pal.select("color_key", "hex"), "color_key", "left").na.fill({"hex": "#FFFFFF"})
    return draw(raster.merge_similar_colors(cells, pal, threshold))


GREYS = [("a", "#000000"), ("b", "#202020"), ("c", "#404040")]


def gap(spark, a, b):
    from gridloom.functions.colors import rgb_to_oklab

    lab = palette(spark, [("a", a), ("b", b)]).select("ord", rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")).alias("at"))
    first, second = [r["at"] for r in lab.orderBy("ord").collect()]
    return math.dist(first, second) * 100


def test_merge_joins_leaders_only(spark):
    # b is close to a and c is close to b, but c is not close to a; b leads nobody once it has joined a.
    ab, bc, ac = gap(spark, "#000000", "#202020"), gap(spark, "#202020", "#404040"), gap(spark, "#000000", "#404040")
    threshold = max(ab, bc) + 0.01
    assert threshold < ac
    assert merged(spark, "aaa bbc", GREYS, threshold) == "aaa aac"


def test_merge_is_idempotent_at_zero_and_total_at_large(spark):
    assert merged(spark, "aab ccb", GREYS, 0.0) == "aab ccb"
    assert merged(spark, "aab .cb", GREYS, 1000.0) == "aaa .aa"


def test_merge_threshold_is_strict(spark):
    at = round(gap(spark, "#000000", "#202020"), 6)
    assert merged(spark, "aab", GREYS, at) == "aab"
    assert merged(spark, "aab", GREYS, at + 1e-6) == "aaa"


def test_counts_and_replacement(spark, rows):
    cells = grid(spark, "aab .ab")
    counts = cell_ops.color_counts(cells)
    assert rows(counts, "color_key", "count") == [("a", 3), ("b", 2)]
    assert rows(cell_ops.bead_totals(counts)) == [(1, 5, 2)]
    rule = spark.createDataFrame([(1, "#610000", "z", "#7A0000")], "pattern_id int, source_hex string, target_key string, target_hex string")
    out = cell_ops.replace_color(cells, rule)
    assert draw(out) == "zzb .zb"
    assert out.where("is_replaced").count() == 3


def test_exclusion_is_refused_when_no_colour_is_left(spark, rows):
    pal = palette(spark, [("a", "#610000"), ("b", "#620000")])
    cells = grid(spark, "aab")
    initial = cell_ops.color_counts(cells)
    ask = spark.createDataFrame([(1, "#610000")], "pattern_id int, hex string")
    none = ask.limit(0)
    out, refused = cell_ops.exclude_and_remap(cells, initial, ask, none, pal)
    assert draw(out) == "bbb" and refused.count() == 0
    earlier = spark.createDataFrame([(1, "#620000")], "pattern_id int, hex string")
    out, refused = cell_ops.exclude_and_remap(cells, initial, ask, earlier, pal)
    assert draw(out) == "aab"
    assert rows(refused, "reason") == [("no_target_left",)]


def test_preview_keeps_every_nth(spark):
    wide = grid(spark, "a" * 40)
    assert [r.col_idx for r in cell_ops.preview_grid(wide).orderBy("col_idx").collect()] == list(range(0, 40, 3))


def test_merging_within_each_image_palette(spark):
    """Keys mean different colours in different palettes, and every cell stays one row."""
    entry = lambda name, ord_, key, r: (name, ord_, key, f"#{r:02X}0000", r, 0, 0)
    palettes = spark.createDataFrame([entry("p", 0, "A", 250), entry("p", 1, "B", 240), entry("q", 0, "A", 250), entry("q", 1, "B", 10)], "palette_name string, ord int, color_key string, hex string, r int, g int, b int")
    cells = spark.createDataFrame([(i, 0, c, k, "#000000", False) for i in (1, 2) for c, k in enumerate("AAB")], "pattern_id int, row_idx int, col_idx int, color_key string, hex string, is_external boolean")
    named = spark.createDataFrame([(1, "p"), (2, "q")], "image_id int, palette_name string")
    got = sorted((r.pattern_id, r.col_idx, r.color_key) for r in raster.merge_similar_colors(cells, palettes, 30.0, named).collect())
    assert got == [(1, 0, "A"), (1, 1, "A"), (1, 2, "A"), (2, 0, "A"), (2, 1, "A"), (2, 2, "B")]
    assert raster.merge_similar_colors(cells, palettes, 30.0).count() == 6
