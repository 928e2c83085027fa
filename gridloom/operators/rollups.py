"""Several grains in one pass, multiset comparison of snapshots, and sketches that are stored per day and merged on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a distinct-count sketch (4096 registers) and of a quantile sketch, and what their estimates keep to.
DISTINCT_BITS, DISTINCT_ERROR = 12, 0.05
QUANTILE_K, RANK_ERROR = 400, 0.02


def grains(facts: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """The measures at every grain of `sets`, from one scan and one aggregation, with `grain`.

    `grain` is the grouping id over the columns in the order in which `sets` first names them: a 1 bit for a column that
    the grain leaves out. So a null of the data (bit 0) and a column left out (bit 1) stay apart. Repeated sets count once.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    distinct = [s for i, s in enumerate(sets) if set(s) not in [set(t) for t in sets[:i]]]
    grouped = facts.groupingSets([[F.col(c) for c in s] for s in distinct], *columns)
    return grouped.agg(F.grouping_id().alias("grain"), *measures)


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two snapshots as multisets: every distinct row with n_before, n_after, n_common, n_lost and n_gained.

    One aggregation over both; rows are equal if all columns are, nulls included. A row with a million copies is one row.
    """
    columns = before.columns
    sides = before.select(*columns, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(*columns, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    counted = sides.groupBy(*columns).agg(F.sum("_b").alias("n_before"), F.sum("_a").alias("n_after"))
    return counted.select(
        *columns, "n_before", "n_after", F.least("n_before", "n_after").alias("n_common"),
        F.greatest(F.lit(0), F.col("n_before") - F.col("n_after")).alias("n_lost"), F.greatest(F.lit(0), F.col("n_after") - F.col("n_before")).alias("n_gained"),
    )


def day_sketches(facts: DataFrame, day: Column, distinct: str, value: str) -> DataFrame:
    """Per day: n, a sketch of the distinct values of one column and one of the quantiles of another (bigint).

    Small binaries to be stored; days are merged in any order. Nulls of either column are left out of its sketch.
    """
    return facts.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_bigint(value, F.lit(QUANTILE_K)).alias("quantile_sketch"),
    )


def merged_sketches(days: DataFrame, *keys: str) -> DataFrame:
    """The sketches of all days of each group of `keys` (of all, without keys) as one: n, n_distinct and the merged sketches."""
    merged = days.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("quantile_sketch").alias("quantile_sketch")
    )
    return merged.withColumn("n_distinct", F.hll_sketch_estimate("distinct_sketch"))


def quantile(share: float) -> Column:
    """The value at a share of a merged table's quantile sketch."""
    return F.kll_sketch_get_quantile_bigint("quantile_sketch", F.lit(share))
