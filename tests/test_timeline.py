"""Joins and windows along time against loops, with a hot key, ties, nulls and spans from seconds to years."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators import timeline

START = datetime(2024, 1, 1)


def at(s):
    return None if s is None else START + timedelta(seconds=s)


def test_as_of_with_a_hot_key(spark, rows):
    rnd = random.Random(1)
    key = lambda: None if rnd.random() < 0.05 else ("hot" if rnd.random() < 0.9 else rnd.choice("ab"))
    facts = [(key(), at(rnd.randrange(3000)) if rnd.random() > 0.03 else None, i, None if i % 7 == 0 else i * 10) for i in range(2000)]
    asks = [(i, key(), at(rnd.randrange(-50, 3000)) if rnd.random() > 0.03 else None) for i in range(800)] + [(900, "none", at(5)), (1, "hot", at(10)), (1, "hot", at(10))]
    left = spark.createDataFrame(asks, "id int, w string, t timestamp").repartition(5)
    right = spark.createDataFrame(facts, "w string, u timestamp, seq int, stock int").repartition(5)
    got = timeline.as_of(left, right, ["w"], "t", "u", "seq", ["seq", "stock"])
    want = []
    for i, w, t in asks:
        fit = [(u, s, v) for k, u, s, v in facts if k is not None and k == w and t is not None and u is not None and u <= t]
        want.append((i, w, t, *(max(fit)[1:] if fit else (None, None))))
    assert got.columns == ["id", "w", "t", "as_of_seq", "as_of_stock"]
    assert rows(got) == sorted(want, key=repr)
    assert timeline.as_of(left.limit(0), right, ["w"], "t", "u", "seq", ["stock"]).count() == 0
    assert {r.as_of_stock for r in timeline.as_of(left, right.limit(0), ["w"], "t", "u", "seq", ["stock"]).collect()} == {None}


@pytest.mark.parametrize("reach", [1, 50, 40_000_000])
def test_overlaps_of_seconds_and_years(spark, rows, reach):
    rnd = random.Random(reach)

    def span(i):
        a = rnd.randrange(-3000, 3000)
        return (a, a + rnd.choice([-1, 0, 1, 2, 3, rnd.randrange(1, 400), rnd.randrange(1, reach + 1)]))

    side = lambda n: [(rnd.choice(["hot", "hot", "hot", "x", None]), i, *span(i)) for i in range(n)]
    a, b = [*side(120), ("hot", 500, None, 5)], side(150)
    left = spark.createDataFrame(a, "w string, i int, a long, b long")
    right = spark.createDataFrame(b, "w string, j int, c long, d long")
    want = sorted((w, i, x, y, j, c, d) for w, i, x, y in a for v, j, c, d in b if w and w == v and x is not None and x < y and c < d and x < d and c < y)
    got = timeline.overlaps(left, right, ["w"], ("a", "b"), ("c", "d"))
    assert sorted(tuple(r) for r in got.collect()) == want and want
    assert timeline.overlaps(left.limit(0), right, ["w"], ("a", "b"), ("c", "d")).count() == 0
    cells = left.where("a < b").select(timeline._cells("a", "b").alias("c"), "a", "b").collect()
    for r in cells:
        assert sum(2**c.level for c in r.c) == r.b - r.a and len(r.c) <= 2 * (r.b - r.a).bit_length()


@pytest.mark.parametrize("n", [0, 1, 300])
def test_overlap_totals_are_those_of_the_pairs(spark, rows, n):
    """Spans that touch, nest and repeat, probes at one time, a hot key, nulls and empty spans."""
    rnd = random.Random(n)

    def span():
        a = rnd.randrange(-60, 60)
        return rnd.choice([(a, a + rnd.choice([-1, 0, 1, 5, 100])), (a, a + rnd.randrange(1, 9)), (0, 30), (None, 5), (5, None)])

    key = lambda: (rnd.choice(["hot", "hot", "hot", "x", None]), rnd.choice([1, 1, 2]))
    a = [(*key(), rnd.randrange(90) if i % 9 else None, *span()) for i in range(n)]
    b = [(*key(), *span()) for _ in range(n)]
    left = spark.createDataFrame(a, "w string, o int, i int, a long, b long").repartition(5)
    right = spark.createDataFrame(b, "w string, o int, c long, d long").repartition(3)
    want = {}
    for w, o, i, x, y in a:
        for v, p, c, d in b:
            if w and (w, o) == (v, p) and None not in (x, y, c, d) and x < y and c < d and x < d and c < y:
                count, shared = want.get((i, w), (0, 0))
                want[i, w] = (count + 1, shared + min(y, d) - max(x, c))
    got = timeline.overlap_totals(left, right, ["w", "o"], ("a", "b"), ("c", "d"), ["i", "w"])
    assert got.columns == ["i", "w", "n", "shared"]
    assert rows(got) == sorted(((*k, *v) for k, v in want.items()), key=repr) and (want or n < 2)


def test_overlap_totals_make_no_pairs(spark):
    """All of 60 000 spans lie over all of 60 000 others: 3.6e9 pairs."""
    spans = spark.range(60_000).select(F.lit("w").alias("w"), "id", F.lit(0).alias("a"), (F.col("id") + 1).alias("b"))
    got = timeline.overlap_totals(spans, spans.toDF("w", "j", "c", "d"), ["w"], ("a", "b"), ("c", "d"), ["w"]).collect()
    n = 60_000
    assert [tuple(r) for r in got] == [("w", n * n, n * (n + 1) * (2 * n + 1) // 6)]


def test_cells_of_long_spans_are_not_broadcast(spark):
    """A span becomes many cells, but Spark guesses their size from the spans."""
    left = spark.range(50).select(F.lit("w").alias("w"), F.col("id").alias("i"), F.lit(1).alias("a"), F.lit(2**39 - 1).alias("b"))
    plan = timeline.overlaps(left, left.toDF("w", "j", "c", "d"), ["w"], ("a", "b"), ("c", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_overlaps_refuse_what_they_cannot_tell_apart(spark):
    left = spark.createDataFrame([("w", 0, 2**41)], "w string, a long, b long")
    with pytest.raises(ValueError):
        timeline.overlaps(left, left, ["w"], ("a", "b"), ("a", "b"))
    with pytest.raises(Exception, match="longer than"):
        timeline.overlaps(left, left.toDF("w", "c", "d"), ["w"], ("a", "b"), ("c", "d")).collect()


@pytest.mark.parametrize("gap", [0, 3, 30])
def test_sessions_over_borders(spark, rows, gap):
    rnd = random.Random(gap)
    data = [("hot" if rnd.random() < 0.9 else rnd.choice(["a", None]), rnd.randrange(5000) if rnd.random() > 0.02 else None, rnd.randrange(-5, 9)) for _ in range(1500)]
    got = timeline.sessions(spark.createDataFrame([(k, at(t), v) for k, t, v in data], "k string, t timestamp, v long").repartition(6), ["k"], "t", gap, ["v"])
    want = []
    for k in {d[0] for d in data}:
        run = []
        for t, v in sorted((t, v) for kk, t, v in data if kk == k and t is not None):
            if run and t - run[-1][0] > gap:
                want.append((k, at(run[0][0]), at(run[-1][0]), len(run), sum(x[1] for x in run)))
                run = []
            run.append((t, v))
        if run:
            want.append((k, at(run[0][0]), at(run[-1][0]), len(run), sum(x[1] for x in run)))
    assert rows(got) == sorted(want, key=repr)
