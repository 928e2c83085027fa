"""Helpers shared by the operators: names that cannot clash, scratch tables, checked broadcasts, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.lineage import scratch_path

SPACES = " \t\n\x0b\x0c\r"
#: Rows that one sorted range should hold when positions are counted.
RANK_ROWS = 500_000


def free_name(taken: list[str], stem: str) -> str:
    """`stem`, lengthened until no column has it (names compare without case)."""
    used = {c.lower() for c in taken}
    while stem.lower() in used:
        stem += "_"
    return stem


def words(text: Column) -> Column:
    """The runs of characters other than the six ASCII spaces, in order; no words for null."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]+", " "), " "), "")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder, so that lost executors cost a reread and no job runs twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of a narrow table after counting that it has at most `max_rows`; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, rows: int) -> DataFrame:
    """Adds `out`: a gapless position from 0 within `keys` (not null) in the total order `order`. `df` has `rows` rows.

    One shuffle deals the rows into ranges of (keys, order), so a key with most rows is many ranges. A row's place in
    its sorted range, less the range's first place of the key, is shifted by the key's rows in earlier ranges; those
    counts are at most one row per key and range.
    """
    place, part, first, n = (free_name([*df.columns, out], s) for s in ("sorted_place", "range_no", "range_first", "range_rows"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANK_ROWS))
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id())
    dealt = written(dealt.withColumn(part, F.shiftright(place, 33)), "ranges")
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, part).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(n))
    starts = starts.select(*keys, part, (F.coalesce(F.sum(n).over(earlier), F.lit(0)) - F.col(first)).alias(first))
    return dealt.join(starts, [*keys, part]).withColumn(out, F.col(place) + F.col(first)).drop(part, place, first)
