import random

import pytest

from gridloom.operators import lattice

POINTS = "image_id int, idx int, x double, y double, width int, height int, score double"


@pytest.fixture(scope="module")
def board(spark):
    """Two boards with known pitch; a third image has too few points."""
    rnd = random.Random(1)
    data = []
    for image, (pitch, ox, oy) in {1: (20.0, 14.0, 11.0), 2: (17.5, 40.0, 33.0)}.items():
        cells = rnd.sample([(r, c) for r in range(52) for c in range(52)], 700)
        for r, c in cells:
            data.append((image, len(data), ox + c * pitch + rnd.uniform(-0.6, 0.6), oy + r * pitch + rnd.uniform(-0.6, 0.6), 8, 9, rnd.uniform(30, 90)))
        data += [(image, len(data) + i, rnd.uniform(0, 1000), rnd.uniform(0, 1000), 8, 9, 20.0) for i in range(40)]
    data += [(3, 9000 + i, 5.0 * i, 5.0, 8, 9, 50.0) for i in range(4)]
    images = spark.createDataFrame([(1, 1060, 1060), (2, 1000, 990), (3, 500, 500)], "image_id int, width int, height int")
    return spark.createDataFrame(data, POINTS), images


def test_lattice_is_recovered(board):
    points, images = board
    fits, failed = lattice.fit_lattice(points, images, 52)
    got = {r.image_id: r for r in fits.collect()}
    for image, pitch, ox, oy in ((1, 20.0, 14.0, 11.0), (2, 17.5, 40.0, 33.0)):
        r = got[image]
        assert abs(r.pitch - pitch) < 0.02 and abs(r.origin_x - ox) < 0.5 and abs(r.origin_y - oy) < 0.5
        assert r.matched >= 690 and r.confidence > 0.85
    assert [(r.image_id, r.reason) for r in failed.collect()] == [(3, "too_few_points")]


def test_scored_lattice_is_recovered(board):
    points, images = board
    got = {r.image_id: r for r in lattice.fit_scored_lattice(points, images, 52).collect()}
    for image, pitch, ox, oy in ((1, 20.0, 14.0, 11.0), (2, 17.5, 40.0, 33.0)):
        r = got[image]
        assert abs(r.pitch - pitch) < 0.1 and abs(r.offset_x - ox) < 2 and abs(r.offset_y - oy) < 2
        assert r.inliers > 600 and r.direct > 300


def test_copies_of_points_do_not_change_the_pitch(board):
    points, images = board
    once = lattice.estimate_pitch(points, images, 52)
    many = lattice.estimate_pitch(points.unionAll(points).unionAll(points), images, 52)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in many.collect()}


def test_window_prefers_the_first_start(spark, rows):
    counts = spark.createDataFrame([(1, "x", 0, 3), (1, "x", 4, 3), (1, "x", 9, 2)], "image_id int, axis string, k bigint, n bigint")
    assert rows(lattice.best_window(counts, 5)) == [(1, "x", 0, 6)]
    assert rows(lattice.best_window(counts, 3)) == [(1, "x", -2, 3)]


@pytest.mark.parametrize("limit", [5, 50])
def test_top_candidates(spark, limit):
    rnd = random.Random(3)
    data = [(1, i, float(rnd.randrange(40)), float(rnd.randrange(40)), 1, 1, float(rnd.randrange(9))) for i in range(200)]
    got = lattice.top_candidates(spark.createDataFrame(data, POINTS), limit).orderBy("cand_idx").collect()
    best = sorted(data, key=lambda p: (-p[6], p[1]))[:limit]
    assert [r.idx for r in got] == [p[1] for p in sorted(best, key=lambda p: (p[3], p[2]))]


def test_components_keep_large_two_dimensional_parts(spark, rows):
    block = [(r, c) for r in range(6) for c in range(6)]
    other = [(r, c) for r in range(20, 24) for c in range(20, 24)]
    line = [(40, c) for c in range(9)]
    cells = [(1, 1, *p) for p in block + other + line] + [(1, 2, 0, 0), (1, 2, 9, 9)]
    df = spark.createDataFrame(cells, "image_id int, place int, row_idx int, col_idx int")
    kept = lattice.filter_lattice_components(df)
    assert {tuple(r) for r in kept.where("place = 1").select("row_idx", "col_idx").collect()} == set(block + other)
    assert kept.where("place = 2").count() == 2


def test_fits_are_broadcast_and_points_are_not(spark):
    from gridloom.operators import lattice as ops

    points = spark.range(400).selectExpr("1 image_id", "id idx", "10D + id % 20 * 20 x", "10D + floor(id / 20) * 20 y")
    start = spark.createDataFrame([(1, 10.5, 9.5, 20.0)], "image_id int, origin_x double, origin_y double, pitch double")
    fits = ops.refine_lattice(points, start, 20, 1)
    assert "strategy=broadcast" in fits._jdf.queryExecution().analyzed().toString()
    r = fits.first()
    assert (round(r.origin_x, 6), round(r.origin_y, 6), round(r.pitch, 6)) == (10.0, 10.0, 20.0)
