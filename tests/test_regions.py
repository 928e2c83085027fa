import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as cell_ops
from gridloom.operators import edits, regions
from gridloom.operators.components import connected_components
from helpers import draw, grid


def flood(lines):
    """Region number of every cell: row · 2^31 + column of the region's first cell."""
    label = {}
    for r, line in enumerate(lines):
        for c, ch in enumerate(line):
            if ch == "." or (r, c) in label:
                continue
            first, stack = r * 2**31 + c, [(r, c)]
            label[r, c] = first
            while stack:
                y, x = stack.pop()
                for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= ny < len(lines) and 0 <= nx < len(lines[0]) and lines[ny][nx] == ch and (ny, nx) not in label:
                        label[ny, nx] = first
                        stack.append((ny, nx))
    return label


def serpentine(height, width):
    out = []
    for r in range(height):
        if r % 2 == 0:
            out.append("a" * width)
        else:
            out.append("b" * (width - 1) + "a" if r % 4 == 1 else "a" + "b" * (width - 1))
    return out


def noise(height, width, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aab.") for _ in range(width)) for _ in range(height)]


@pytest.mark.parametrize("lines", [noise(150, 90, 1), serpentine(80, 70), ["aba"], ["a", "a", "b"], ["..", ".."], ["aaa", "aba", "a.a"]])
def test_regions_match_flood_fill(spark, lines):
    labels = regions.label_regions(grid(spark, " ".join(lines)))
    assert {(r.row_idx, r.col_idx): r.region_id for r in labels.collect()} == flood(lines)


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    pairs = [(s, rnd.randrange(60), rnd.randrange(60)) for s in (1, 2) for _ in range(35)] + [(3, i, i + 1) for i in range(50)]
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for s, a, b in pairs:
        if a != b:
            x, y = sorted([root((s, a)), root((s, b))])
            parent[y] = x
    want = {n: root(n)[1] for n in parent}
    edges = spark.createDataFrame(pairs, "scope int, u bigint, v bigint")
    got = connected_components(edges, ["scope"])
    assert {(r.scope, r.node): r.component for r in got.collect()} == want


def test_summary_of_a_u_shape(spark):
    cells = grid(spark, "aba aba aaa")
    labels = regions.label_regions(cells)
    rows = {r.color: r for r in regions.region_summary(labels, cell_ops.grid_sizes(cells)).collect()}
    u = rows["#610000"]
    assert (u.size, u.center_row, u.center_col, u.touches_edge) == (7, 1, 1, True)
    assert rows["#620000"].size == 2


def test_regions_partition_the_cells(spark):
    cells = grid(spark, " ".join(noise(30, 30, 5)))
    summary = regions.region_summary(regions.label_regions(cells), cell_ops.grid_sizes(cells))
    assert summary.agg(F.sum("size")).first()[0] == cells.where("not is_external").count()


@pytest.mark.parametrize(
    "text, key, n",
    [
        ("ab ba", "a", 2),  # equal counts: the first of the top/bottom scan
        ("ba ab", "b", 2),
        ("abc", "a", 1), ("a b a", "a", 2), ("bbb baa bbb", "b", 7),
    ],
)
def test_border_colour(spark, rows, text, key, n):
    assert rows(cell_ops.border_background_color(grid(spark, text)), "color_key", "border_cells") == [(key, n)]


def test_background_is_erased_only_where_it_reaches_the_border(spark):
    assert draw(regions.remove_background(grid(spark, "bbbbb baaab babab baaab bbbbb"))) == "..... .aaa. .aba. .aaa. ....."
    assert draw(regions.remove_background(grid(spark, ".. .."))) == ".. .."


def test_flood_and_erase(spark):
    cells = grid(spark, "aab bba aaa")
    seed = lambda r, c: spark.createDataFrame([(1, r, c)], "pattern_id int, row_idx int, col_idx int")
    assert draw(regions.flood_erase(cells, seed(2, 0))) == "aab bb. ..."
    assert regions.flood_region(regions.label_regions(cells), seed(9, 9)).count() == 0
    assert regions.flood_region(regions.label_regions(grid(spark, "a.")), seed(0, 1)).count() == 0


def test_recommendations(spark):
    cells = grid(spark, "abbbb bbbbb bbaab bbaab bbbbb")
    sizes, labels = cell_ops.grid_sizes(cells), regions.label_regions(cells)
    summary = regions.region_summary(labels, sizes)
    done = cells.limit(0).select("pattern_id", "row_idx", "col_idx")
    pick = lambda mode, chosen=None: regions.recommend_region(summary, regions.region_completion(labels, done), sizes, mode, chosen).where("color = '#610000'").first()
    assert pick("nearest").region_id == 2 * 2**31 + 2
    at = spark.createDataFrame([(1, 0, 0)], "pattern_id int, row_idx int, col_idx int")
    assert pick("nearest", at).region_id == 0
    assert pick("largest").size == 4
    assert pick("edge-first").region_id == 0


def test_progress_and_next_colour(spark, rows):
    cells = grid(spark, "aab bcc")
    done = cells.where("color_key = 'b'").select("pattern_id", "row_idx", "col_idx")
    progress = regions.color_progress(cells, done)
    assert rows(progress, "hex", "total", "completed", "percent", "color_idx") == [("#610000", 2, 0, 0, 0), ("#620000", 2, 2, 100, 1), ("#630000", 2, 0, 0, 2)]
    now = lambda h: spark.createDataFrame([(1, h)], "pattern_id int, hex string")
    assert rows(regions.next_unfinished_color(progress, now("#610000")), "next_hex", "all_done") == [("#630000", False)]
    assert rows(regions.next_unfinished_color(progress, now("#630000")), "next_hex") == [("#610000",)]


EDITS = "pattern_id int, row_idx int, col_idx int, edit_seq bigint, color_key string, hex string"


def test_edit_log_and_undo(spark, rows):
    cells = grid(spark, "aab")
    log = spark.createDataFrame(
        [(1, 0, 0, 1, "b", "#620000"), (1, 0, 0, 2, "b", "#620000"), (1, 0, 1, 3, "ERASE", ""), (1, 0, 0, 4, "a", "#610000"), (1, 5, 5, 5, "b", "#620000")], EDITS
    )
    assert [r.edit_seq for r in edits.effective_edits(cells, log).orderBy("edit_seq").collect()] == [1, 3, 4]
    assert draw(edits.apply_edits(cells, log)) == "a.b"
    assert draw(edits.apply_edits(cells, log, undo=1)) == "b.b"
    assert draw(edits.apply_edits(cells, log, undo=2)) == "bab"
    assert rows(edits.counts_after_edits(cells, log), "hex", "count") == [("#610000", 1), ("#620000", 1)]
