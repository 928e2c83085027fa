import pytest
from pyspark.sql import functions as F

from gridloom.operators import projects

ITEMS = "warehouse_id int, item_idx int, color_key string, hex string, owned bigint"


@pytest.fixture
def tables(spark):
    patterns = spark.createDataFrame(
        [(1, 7, 1, "draft"), (2, 7, 1, "completed"), (3, 7, 1, "in_progress"), (4, 8, 1, "completed")],
        "pattern_id int, project_id int, warehouse_id int, status string",
    )
    key_counts = spark.createDataFrame([(1, "a1", 5), (1, "H7", 2), (1, "A1", 0), (2, "A1", 99)], "pattern_id int, color_key string, count bigint")
    grid_counts = spark.createDataFrame([(3, "#aa0000", "A1", 4), (1, "#AA0000", "A1", 50), (3, "#BB0000", "", 3)], "pattern_id int, hex string, color_key string, count bigint")
    items = spark.createDataFrame([(1, 0, "A1", "#AA0000", 6), (1, 1, "B1", "#BB0000", 1), (1, 2, "B2", "#BB0000", 2)], ITEMS)
    return patterns, key_counts, grid_counts, items


def test_demand_and_requirements(spark, tables, rows):
    patterns, key_counts, grid_counts, items = tables
    demand = projects.project_demand(patterns, key_counts, grid_counts, items)
    assert rows(demand) == [(7, "#0008EF", "H7", 2), (7, "#AA0000", "A1", 4), (7, "#AA0000", "a1", 5), (7, "#BB0000", "", 3)]
    heads = spark.createDataFrame([(7, 1), (8, 1)], "project_id int, warehouse_id int")
    need = projects.requirements(demand, heads, items)
    assert rows(need, "color_key", "needed", "owned", "missing", "remaining") == [
        ("A1", 4, 6, 0, 2), ("B2", 3, 2, 1, -1), ("H7", 2, 0, 2, -2), ("a1", 5, 6, 0, 1),
    ]
    assert rows(projects.requirement_summary(need)) == [(7, 14, 11, 3, 4, 2)]
    assert [r.color_key for r in projects.missing_items(need).collect()] == ["H7", "B2"]


def test_demand_by_hex_takes_the_first_code(spark, rows):
    patterns = spark.createDataFrame([(1, 7, "draft"), (2, 7, "draft")], "pattern_id int, project_id int, status string")
    counts = spark.createDataFrame([(1, "#aa0000", "", 1), (2, "#AA0000", "Z", 2), (2, "#BB0000", "", 2)], "pattern_id int, hex string, color_key string, count bigint")
    assert rows(projects.project_demand_by_hex(patterns, counts)) == [(7, "#AA0000", 3, "Z"), (7, "#BB0000", 2, "")]


def test_status(spark, rows):
    heads = spark.createDataFrame([(1,), (2,), (3,), (4,)], "project_id int")
    patterns = spark.createDataFrame([(2, "completed"), (2, "completed"), (3, "completed"), (3, "in_progress"), (4, "completed"), (4, "draft")], "project_id int, status string")
    assert rows(projects.derive_status(heads, patterns)) == [(1, "draft"), (2, "completed"), (3, "in_progress"), (4, "draft")]


def test_adding_patterns(spark, rows):
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "pattern_id int")
    assigned = spark.createDataFrame([(1, 8)], "pattern_id int, project_id int")
    members = spark.createDataFrame([(2, 7), (1, 8)], "pattern_id int, project_id int")
    ask = spark.createDataFrame([(7, 2), (7, 3), (8, 4), (8, 99), (9, 1), (10, 5), (11, 5), (12, 2)], "project_id int, pattern_id int")
    accepted, bad = projects.add_patterns(ask, ids, assigned, members)
    assert rows(accepted) == [(10, 5, "draft"), (7, 3, "draft")]
    assert rows(bad) == [(11, 5, "assigned_elsewhere"), (12, 2, "not_available"), (8, 99, "not_available"), (9, 1, "assigned_elsewhere")]


MEMBERS = "pattern_id int, project_id int, status string, is_deducted boolean, completed_at timestamp"


def test_moving_and_removing(spark, rows):
    members = spark.createDataFrame(
        [(1, 7, "draft", False, None), (2, 7, "completed", True, None), (3, 8, "completed", False, None), (4, 9, "draft", False, None)], MEMBERS
    ).withColumn("completed_at", F.when(F.col("status") == "completed", F.lit("2020-01-01").cast("timestamp")))
    move = spark.createDataFrame([(7, 1, "completed"), (7, 2, "draft"), (8, 3, "draft"), (9, 4, "completed"), (5, 1, "draft")], "project_id int, pattern_id int, target string")
    new, bad = projects.move_patterns(move, members, F.lit("2021-01-01").cast("timestamp"))
    assert rows(new.select("pattern_id", "status", F.year("completed_at"))) == [(1, "draft", None), (2, "completed", 2020), (3, "draft", None), (4, "completed", 2021)]
    assert rows(bad) == [(5, 1, "no_pattern_found"), (7, 2, "stock_deducted")]
    drop = spark.createDataFrame([(7, 1), (7, 2), (9, 4), (9, 50)], "project_id int, pattern_id int")
    assigned = spark.createDataFrame([(4, 9), (50, 9), (1, 7)], "pattern_id int, project_id int")
    left, free, bad = projects.remove_patterns(drop, members, assigned)
    assert rows(left, "pattern_id") == [(1,), (2,), (3,)]
    assert rows(free, "pattern_id", "project_id") == [(1, 7)]
    assert rows(bad) == [(7, 2, "not_draft")]
