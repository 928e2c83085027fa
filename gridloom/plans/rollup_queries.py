"""Grains of the ledger and the demand, snapshots compared as multisets, sketches by day."""

from pyspark.sql import functions as F

from gridloom.functions import keys
from gridloom.lineage import cut_lineage
from gridloom.operators import rollups as ops
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import query


@query("movement_grains", """
with f as (select warehouse_id, case when ord%13=0 then null else ord end ord, cast(created_at as date) "day", delta from fx_ledger)
select warehouse_id, ord, "day", cast(grouping_id(warehouse_id, ord, "day") as bigint) grain, count(*) n_moves, cast(sum(delta) as bigint) delta, cast(sum(greatest(delta, 0)) as bigint) gained
  from f group by grouping sets ((warehouse_id, ord), (warehouse_id, "day"), (ord), ("day"), ())
""")
def movement_grains(spark, d):
    facts = fx.ledger(spark, d).select(
        "warehouse_id", F.when(F.col("ord") % 13 != 0, F.col("ord")).alias("ord"), F.to_date(F.col("created_at")).alias("day"), "delta"
    )
    sums = [F.count(F.lit(1)).alias("n_moves"), F.sum("delta").alias("delta"), F.sum(F.greatest("delta", F.lit(0))).alias("gained")]
    return ops.grains(facts, [["warehouse_id", "ord"], ["warehouse_id", "day"], ["ord"], ["day"], []], sums)


@query("demand_cube", """
select p.warehouse_id, p.status, c.color_key[1] series, cast(grouping_id(p.warehouse_id, p.status, c.color_key[1]) as bigint) grain, cast(sum(cnt) as bigint) needed, count(*) n_colors
  from fx_counted c join fx_patterns p using (pattern_id) group by cube (p.warehouse_id, p.status, c.color_key[1])
""")
def demand_cube(spark, d):
    facts = fx.counted(spark, d).join(fx.patterns(spark, d), "pattern_id").withColumn("series", keys.series_prefix(F.col("color_key")))
    every = [["warehouse_id", "status", "series"], ["warehouse_id", "status"], ["warehouse_id", "series"], ["status", "series"], ["warehouse_id"], ["status"], ["series"], []]
    return ops.grains(facts, every, [F.sum("cnt").alias("needed"), F.count(F.lit(1)).alias("n_colors")])


@query("snapshot_reconciliation", """
with before as (select warehouse_id, floor(sum(delta)/100) hundreds from fx_ledger where created_at < timestamp '2024-01-16' group by warehouse_id, ord),
after as (select warehouse_id, floor(sum(delta)/100) hundreds from fx_ledger group by warehouse_id, ord),
lost as (select warehouse_id, hundreds, count(*) n from (select * from before except all select * from after) group by 1, 2),
gained as (select warehouse_id, hundreds, count(*) n from (select * from after except all select * from before) group by 1, 2),
same as (select warehouse_id, hundreds, count(*) n from (select * from before intersect all select * from after) group by 1, 2),
every as (select warehouse_id, hundreds from before union select warehouse_id, hundreds from after)
select warehouse_id, cast(hundreds as bigint) hundreds, coalesce(s.n, 0) n_common, coalesce(l.n, 0) n_lost, coalesce(g.n, 0) n_gained
  from every left join same s using (warehouse_id, hundreds) left join lost l using (warehouse_id, hundreds) left join gained g using (warehouse_id, hundreds)
""")
def snapshot_reconciliation(spark, d):
    ledger = fx.ledger(spark, d)
    sizes = lambda df: df.groupBy("warehouse_id", "ord").agg(F.sum("delta").alias("s")).select("warehouse_id", F.floor(F.col("s") / 100).alias("hundreds"))
    return ops.compared(sizes(ledger.where(F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz"))), sizes(ledger)).drop("n_before", "n_after")


@query("sketches_by_day", """
with days as (select distinct cast(ts as date) "day" from events),
known as (select d."day", e.user_id, cast(floor(e.value) as bigint) v from days d join events e on cast(e.ts as date) <= d."day"),
counted as (select "day", count(distinct user_id) n_users, count(*) n from known group by 1)
select "day", n, n_users, true distinct_holds, true median_holds from counted
""")
def sketches_by_day(spark, d):
    """From stored sketches, what was known by the end of every day, beside the exact numbers and whether the bounds hold."""
    facts = fx.table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id", F.floor("value").alias("v"))
    days = cut_lineage(ops.day_sketches(facts, F.col("day"), "user_id", "v"))
    upto = days.select(F.col("day").alias("upto")).join(days, F.col("day") <= F.col("upto"))  # a row a day, not the events
    told = ops.merged_sketches(upto, "upto").withColumn("median", ops.quantile(0.5))
    first = facts.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("fresh"))
    sizes = facts.groupBy("day", "v").agg(F.count(F.lit(1)).alias("c"))
    fresh = days.select(F.col("day").alias("upto")).join(first, F.col("day") <= F.col("upto")).groupBy("upto").agg(F.sum("fresh").alias("n_users"))
    ranks = told.select("upto", "median").join(sizes, F.col("day") <= F.col("upto")).groupBy("upto").agg(
        F.sum(F.when(F.col("v") < F.col("median"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("median"), F.col("c")).otherwise(0)).alias("upto_it")
    )
    share = lambda c: F.col(c) / F.col("n")
    return told.join(fresh, "upto").join(ranks, "upto").select(
        F.col("upto").alias("day"), "n", "n_users", (F.abs(F.col("n_distinct") / F.col("n_users") - 1) <= ops.DISTINCT_ERROR).alias("distinct_holds"),
        ((share("below") <= 0.5 + ops.RANK_ERROR) & (share("upto_it") >= 0.5 - ops.RANK_ERROR)).alias("median_holds"),
    )
