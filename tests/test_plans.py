"""Plan shapes that must hold at scale."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.operators import cells, grouping, ledger, lattice, raster

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize(
    "name",
    ["requirement_summary", "pixelate", "merge_similar_colors", "sample_dominant_color", "count_below_circle", "replace_color", "match_palette_lab",
     "local_pairs", "similar_hashes", "warehouse_demand", "nearest_palette_color", "estimate_pitch"],
)
def test_no_products_even_without_broadcasts(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()[name](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@needs_data
def test_scans_read_only_what_they_need(spark):
    text = plan(entry.queries()["project_demand"](spark, DATA))
    assert "p_partkey" in text and "p_name" not in text and "p_retailprice" not in text
    assert "l_quantity" in text and "l_extendedprice" not in text and "o_totalprice" not in text


def test_top_n_is_cut_before_the_shuffle(spark):
    txns = spark.range(100).select((F.col("id") % 3).alias("warehouse_id"), F.col("id").alias("txn_id"), F.col("id").alias("seq"))
    text = plan(ledger.recent_transactions(txns))
    assert text.count("WindowGroupLimit") == 2


def test_counting_aggregates_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("1 pattern_id", "0 row_idx", "cast(id as int) col_idx", "'A' color_key", "'#AA0000' hex", "false is_external")
    text = plan(cells.color_counts(df))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_lookup_side_is_broadcast_only_when_small(spark):
    from gridloom.operators.sizing import lookup_side

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big, small = spark.range(1000), spark.range(50)
        assert "BroadcastHashJoin" in plan(big.join(lookup_side(small, limit=60), "id"))
        assert "BroadcastHashJoin" not in plan(big.join(lookup_side(small, limit=40), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neighbour_joins_are_equi_joins(spark):
    points = spark.createDataFrame([(1, 0, 1.0, 2.0)], "image_id int, idx int, x double, y double")
    images = spark.createDataFrame([(1, 100, 100)], "image_id int, width int, height int")
    text = plan(lattice.estimate_pitch(points, images, 10))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    features = spark.createDataFrame([(1,)], "phash bigint")
    assert "NestedLoop" not in plan(grouping.similar_hashes(features))


def test_pixel_cells_need_no_range_join(spark):
    px = spark.createDataFrame([(1, 0, 0, 1, 1, 1, 255)], "image_id int, x int, y int, r int, g int, b int, a int")
    text = plan(raster.dominant_color(raster.assign_cells(px, 3)))
    assert "NestedLoop" not in text and "Generate explode" in text
