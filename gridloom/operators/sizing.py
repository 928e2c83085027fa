"""Helpers that keep joins and ordered scans safe when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A lookup side is broadcast only after its row count was seen to be at most this.
LOOKUP_ROW_LIMIT = 20_000
# Rows per block when an ordered scan over one key is split up.
BLOCK_ROWS = 65_536


def lookup_side(df: DataFrame, probe: DataFrame | None = None, limit: int = LOOKUP_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast if `df` is proven small; otherwise leave the join to AQE.

    `probe` is a cheaper relation with at least as many rows, to be counted instead.
    """
    if (df if probe is None else probe).limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block))


def rank_in_blocks(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK_ROWS) -> DataFrame:
    """0-based position of each row within `keys`, ordered by a unique integer column.

    The scan is cut into blocks of the order column: rows are ranked inside their
    block and shifted by the number of rows in earlier blocks, so a key with most of
    the rows is spread over many tasks.
    """
    tagged = df.withColumn("_blk", _block(order, block))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    return (
        tagged.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_blk"])
        .withColumn(out, (F.col("_start") + F.col("_pos")).cast("bigint"))
        .drop("_blk", "_pos", "_start")
    )


def running_sum_in_blocks(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running total of `value` per key, blocked like `rank_in_blocks`."""
    tagged = df.withColumn("_blk", _block(order, block))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(*keys, "_blk").agg(F.sum(value).alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.withColumn("_part", F.sum(value).over(inside))
        .join(starts, [*keys, "_blk"])
        .withColumn(out, F.col("_start") + F.col("_part"))
        .drop("_blk", "_part", "_start")
    )


def first_by(order: list, *cols: str) -> list[Column]:
    """Aggregates giving `cols` of the row with the smallest `order` tuple (partial on the map side)."""
    key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return [F.min_by(F.col(c), key).alias(c) for c in cols]


def previous_in_blocks(
    df: DataFrame, keys: list[str], order: str, cols: list[str], block: int = BLOCK_ROWS
) -> DataFrame:
    """Adds prev_<col>: the values of the row before, per key and integer order; blocked like the others."""
    tagged = df.withColumn("_blk", _block(order, block))
    now = F.struct(*cols)
    lasts = tagged.groupBy(*keys, "_blk").agg(F.max_by(now, F.col(order)).alias("_end"))
    lasts = lasts.withColumn("_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_blk"))).drop("_end")
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    joined = tagged.withColumn("_lag", F.lag(now).over(inside)).join(lasts, [*keys, "_blk"])
    before = F.coalesce("_lag", "_carry")
    return joined.select(*df.columns, *[before[c].alias(f"prev_{c}") for c in cols])
