"""Joins and windows along time that hold when one key has most of the rows.

The as-of join, overlap totals and sessions deal rows into ranges of (key, time), work inside a range, and carry what a
range leaves to the next ones by one row per key and range. Pairs of overlapping intervals meet at cells of a dyadic grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.lineage import cut_lineage

#: Sides of cells run from 1 to 2 to this power; intervals are of whole units, such as seconds.
LEVELS = 40


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` in ranges of a total order, stored, with _range: the number of the range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(max(parts, df.rdd.getNumPartitions()), *order).withColumn("_range", F.spark_partition_id()))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: str, values: list[str]) -> DataFrame:
    """`left`, all rows and columns, with as_of_<value>: the values of the last row of `right` of the same keys at or before left_time.

    Of rows at the same time the one with the largest `order` is last; that column makes rows of `right` distinct. Rows
    with a null key or time match nothing, on either side. No value of `right` is looked at twice, and a key may hold most
    rows of both sides: what one range ends with is carried on.
    """
    whole = lambda time: F.expr(" and ".join(f"{k} is not null" for k in [*keys, time]))
    told = F.struct(*[F.col(v).alias(v) for v in values])
    facts = right.where(whole(right_time)).select(*keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.col(order).alias("_order"), told.alias("_told"))
    none = F.lit(None).cast(facts.schema["_told"].dataType)
    asked = left.withColumn("_row", F.struct(*left.columns))
    probes = asked.where(whole(left_time)).select(
        *keys, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(facts.schema["_order"].dataType).alias("_order"), none.alias("_told"), "_row"
    )
    line = facts.withColumn("_row", F.lit(None).cast(probes.schema["_row"].dataType)).unionByName(probes)
    by = ["_at", "_side", "_order"]
    dealt = _ranges(line, [F.col(c) for c in [*keys, *by]])
    inside = Window.partitionBy(*keys, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.where("_side = 0").groupBy(*keys, "_range").agg(F.max_by("_told", F.struct(*by)).alias("_end"))
    every = dealt.select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "left")
    carried = every.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    # within a struct a value may be null, but a struct of a fact is not
    known = dealt.withColumn("_known", F.last("_told", ignorenulls=True).over(inside)).where("_side = 1").join(carried, [*keys, "_range"], "left")
    last = F.coalesce("_known", "_carry")
    found = known.select("_row.*", *[last[v].alias(f"as_of_{v}") for v in values])
    lost = left.where(~whole(left_time)).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"as_of_{v}") for v in values])
    return found.unionByName(lost)


def _cells(start: str, end: str) -> Column:
    """The fewest aligned cells that make up [start, end): at most two a level."""
    low, high = f"-shiftright(-{start}, l)", f"shiftright({end}, l) - 1"
    up_low, up_high = f"-shiftright(-{start}, l + 1)", f"shiftright({end}, l + 1) - 1"
    ends = f"filter(array_distinct(array({low}, {high})), i -> i between {low} and {high} and not shiftright(i, 1) between {up_low} and {up_high})"
    return F.expr(f"flatten(transform(sequence(0, {LEVELS}), l -> transform({ends}, i -> struct(l as level, i as cell))))")


def _path(at: str, levels: list[int]) -> Column:
    """The cells of some levels that hold a point."""
    return F.array(*[F.struct(F.lit(l).alias("level"), F.shiftright(F.col(at).cast("long"), l).alias("cell")) for l in levels])


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of the same keys whose spans [start, end) of whole numbers share a point, each pair once.

    Two spans overlap if one's start lies in the other. A span is written as at most two cells a level and a start as the
    cell of each level in use, so long spans cost as little as short ones and all pairs come from an equi-join. Empty
    spans, and null keys or ends, meet nothing. Columns but the keys must differ; spans over 2^40 units are refused.
    """
    both = {c.lower() for c in left.columns if c not in keys} & {c.lower() for c in right.columns if c not in keys}
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")

    def covered(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, end = span
        sound = F.raise_error(F.lit("a span is longer than 2^40 units")).isNull()
        rows = df.where(F.col(start) < F.col(end)).where(F.when(F.col(end) - F.col(start) < 2**LEVELS, True).otherwise(sound))
        rows = rows.select("*", F.explode(_cells(f"cast({start} as bigint)", f"cast({end} as bigint)")).alias("_c"))
        return rows.select("*", F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).drop("_c")

    def pairs(spans: DataFrame, points: DataFrame, start: str, end: str) -> DataFrame:
        levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # at most LEVELS + 1
        if not levels:
            return spans.join(points, keys).where("false")
        at = points.where(F.col(start) < F.col(end)).select("*", F.explode(_path(start, levels)).alias("_c"))
        at = at.select("*", F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).drop("_c")
        # Spark guesses the cells at the size of the spans they come from, so it would broadcast them
        return spans.hint("merge").join(at, [*keys, "_level", "_cell"])

    order = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    first = pairs(cut_lineage(covered(left, left_span)), right, *right_span).select(*order)
    second = pairs(cut_lineage(covered(right, right_span)), left, *left_span).where(F.col(left_span[0]) > F.col(right_span[0])).select(*order)
    return first.unionByName(second)


def overlap_totals(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], by: list[str]) -> DataFrame:
    """Per `by` of `left`: n pairs with rows of `right` as in `overlaps`, and shared, the sum of what each pair shares.

    No pair is made, so that many spans over one another cost as much as few. A span of `left` meets the spans that start
    before its end less those that ended by its start, and what it shares with them is the growth, from its start to its
    end, of the running total of time under spans. Rows of `by` without a pair are left out. Empty spans, and null keys
    or ends, meet nothing.
    """
    sound = lambda span: F.expr(" and ".join([*[f"{k} is not null" for k in keys], f"{span[0]} < {span[1]}"]))
    at = lambda name, side: F.struct(F.col(name).cast("bigint").alias("_at"), F.lit(side).alias("_side"))
    marks = right.where(sound(right_span)).select(*keys, F.explode(F.array(at(right_span[0], 2), at(right_span[1], 0))).alias("_m"))
    marks = marks.groupBy(*keys, "_m._at", "_m._side").agg(F.count(F.lit(1)).alias("_n"))
    asked = left.where(sound(left_span)).withColumn("_by", F.struct(*by))
    ends = F.array(*[F.struct(F.col(name).cast("bigint").alias("_at"), F.lit(sign).cast("bigint").alias("_n")) for name, sign in zip(left_span, (-1, 1))])
    probes = asked.select(*keys, F.explode(ends).alias("_m"), "_by").select(*keys, "_m._at", F.lit(1).alias("_side"), "_m._n", "_by")
    line = marks.withColumn("_by", F.lit(None).cast(probes.schema["_by"].dataType)).unionByName(probes)
    dealt = _ranges(line, [F.col(c) for c in [*keys, "_at", "_side", "_by"]])
    begun, over = F.col("_side") == 2, F.col("_side") == 0
    moves = {
        "_begun": F.when(begun, F.col("_n")).otherwise(0), "_over": F.when(over, F.col("_n")).otherwise(0),
        "_time": F.when(begun, F.col("_n") * F.col("_at")).when(over, -F.col("_n") * F.col("_at")).otherwise(0),
    }
    inside = Window.partitionBy(*keys, "_range").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(n) for n, c in moves.items()])
    carried = sums.select(*keys, "_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry{n}") for n in moves])
    known = dealt.withColumns({n: F.sum(c).over(inside) for n, c in moves.items()}).where("_side = 1").join(carried, [*keys, "_range"])
    total = {n: F.col(n) + F.col(f"_carry{n}") for n in moves}
    under = F.col("_at") * (total["_begun"] - total["_over"]) - total["_time"]
    met = F.when(F.col("_n") > 0, total["_begun"]).otherwise(-total["_over"])
    out = known.select("_by.*", met.alias("_met"), (F.col("_n") * under).alias("_under"))
    return out.groupBy(*by).agg(F.sum("_met").alias("n"), F.sum("_under").alias("shared")).where("n > 0")


def sessions(events: DataFrame, keys: list[str], time: str, gap_s: float, sums: list[str]) -> DataFrame:
    """One row per session: keys, started_at, ended_at, n_events and the sums. A pause longer than `gap_s` seconds ends one.

    Rows without time are left out; a null key is a key. A key's rows are dealt into ranges of time: a session that runs
    over the border of ranges is put together from one row per range.
    """
    rows = events.where(F.col(time).isNotNull())
    dealt = _ranges(rows, [F.col(c) for c in [*keys, time]])
    inside = Window.partitionBy(*keys, "_range").orderBy(time)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    apart = lambda now, before: F.coalesce(micros(now) - micros(before) > int(gap_s * 1_000_000), F.lit(True))
    tagged = dealt.withColumn("_new", apart(F.col(time), F.lag(time).over(inside)).cast("int"))
    tagged = tagged.withColumn("_piece", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = tagged.groupBy(*keys, "_range", "_piece").agg(F.min(time).alias("a"), F.max(time).alias("e"), F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])
    # only a range's first piece can go on with what came before; pieces within it are whole but for the last
    edge = pieces.groupBy(*keys, "_range").agg(F.min("a").alias("first"), F.max("e").alias("last"), F.max("_piece").alias("pieces"))
    along = Window.partitionBy(*keys).orderBy("_range")
    edge = edge.withColumn("_apart", apart(F.col("first"), F.lag("last").over(along)))
    starts = F.col("pieces") + F.col("_apart").cast("int") - 1
    edge = edge.withColumn("_before", F.sum(starts).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("pieces"))
    edge = edge.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_of"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = pieces.join(edge, [*same, F.col("_range") == F.col("_of")]).withColumn("_session", F.col("_before") + F.col("_piece"))
    out = joined.groupBy(*keys, "_session").agg(F.min("a").alias("started_at"), F.max("e").alias("ended_at"), F.sum("n").alias("n_events"), *[F.sum(s).alias(s) for s in sums])
    return out.drop("_session")
