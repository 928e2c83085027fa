"""Grains, multisets and sketches against plain counting."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gridloom.operators import rollups


def test_grains_keep_nulls_apart_in_one_scan(spark, rows):
    data = [("a", None, 1), ("a", "x", 2), (None, "x", 4), (None, None, 8), ("a", "x", 16)]
    facts = spark.createDataFrame(data, "w string, c string, n long")
    got = rollups.grains(facts, [["w", "c"], ["c"], ["c", "w"], []], [F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")])
    want = [("a", None, 0, 1, 1), ("a", "x", 0, 18, 2), (None, "x", 0, 4, 1), (None, None, 0, 8, 1), (None, None, 2, 9, 2), (None, "x", 2, 22, 3), (None, None, 3, 31, 5)]
    assert rows(got) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == plan.count("Expand") == plan.count("Aggregate") == 1


def test_multisets_with_a_row_of_many_copies(spark, rows):
    rnd = random.Random(1)
    draw = lambda n: [(rnd.choice(["hot"] * 30 + ["a", "b", None]), rnd.choice([1, 1, 1, None])) for _ in range(n)]
    before, after = draw(900), draw(1100)
    schema = "w string, n int"
    a, b = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    got = rollups.compared(a, b)
    x, y = Counter(before), Counter(after)
    assert rows(got) == sorted(((*k, x[k], y[k], min(x[k], y[k]), max(0, x[k] - y[k]), max(0, y[k] - x[k])) for k in x | y), key=repr)
    assert got.agg(F.sum("n_lost"), F.sum("n_gained"), F.sum("n_common")).first()[:] == (a.exceptAll(b).count(), b.exceptAll(a).count(), a.intersectAll(b).count())
    assert rollups.compared(a.limit(0), b.limit(0)).count() == 0


def test_sketches_merge_in_any_order(spark):
    facts = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") * 7919 % 5003).alias("who"), (F.col("id") % 1000).alias("v"))
    days = rollups.day_sketches(facts, F.col("day"), "who", "v").collect()
    schema = rollups.day_sketches(facts, F.col("day"), "who", "v").schema
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(days)
        merged = rollups.merged_sketches(spark.createDataFrame(days, schema).repartition(3)).select("n", "n_distinct", rollups.quantile(0.5).alias("median")).first()
        assert merged.n == 60_000 and abs(merged.median - 500) <= 1000 * rollups.RANK_ERROR
        seen.add(merged.n_distinct)
    assert len(seen) == 1 and abs(seen.pop() / 5003 - 1) <= rollups.DISTINCT_ERROR
