"""Queries along time: stock as of a request, requests that meet stock-outs, sessions of stock movements."""

from pyspark.sql import functions as F

from gridloom.operators import timeline as ops
from gridloom.operators.sizing import previous_in_blocks, running_sum_in_blocks
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

# Every project asks for its stock once: the order dates, laid over the month of the ledger at 18 minutes a day.
FIXTURE_SQL["fx_requests"] = """
select o_orderkey pattern_id, o_custkey%10 warehouse_id, cast(o_custkey%96 as int) ord,
       timestamp '2024-01-01' + to_minutes(cast(18*date_diff('day', timestamp '1995-01-01', o_orderdate) as bigint)) requested_at,
       cast(floor(o_totalprice) as bigint)%400000 needed_s
  from orders
"""
FIXTURE_SQL["fx_running"] = """
select seq, warehouse_id, ord, created_at, cast(sum(delta) over (partition by warehouse_id, ord order by seq) as bigint) balance from fx_ledger
"""
FIXTURE_SQL["fx_outages"] = """
select warehouse_id, ord, seq, cast(floor(epoch(created_at)) as bigint) out_from,
       cast(coalesce(floor(epoch(lead(created_at) over (partition by warehouse_id, ord order by seq))), epoch(timestamp '2024-02-01')) as bigint) out_to, balance
  from fx_running
"""


def requests(spark, d):
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pattern_id"), (F.col("o_custkey") % 10).alias("warehouse_id"), (F.col("o_custkey") % 96).cast("int").alias("ord"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=18 * days)).alias("requested_at"), (F.floor("o_totalprice").cast("bigint") % 400000).alias("needed_s"),
    )


def running(spark, d):
    ledger = fx.ledger(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return running_sum_in_blocks(ledger, ["warehouse_id", "ord"], "seq", "delta", "balance").select("seq", "warehouse_id", "ord", "created_at", "balance")


def outages(spark, d):
    """Spans in whole seconds in which a warehouse has nothing of a colour."""
    back = previous_in_blocks(running(spark, d).withColumn("_back", -F.col("seq")), ["warehouse_id", "ord"], "_back", ["created_at"])
    second = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    until = F.coalesce(second(F.col("prev_created_at")), F.lit(1706745600))
    return back.where("balance <= 0").select("warehouse_id", "ord", "seq", second(F.col("created_at")).alias("out_from"), until.cast("bigint").alias("out_to"), "balance")


@query("stock_as_of_request", """
with facts as (select * from fx_running qualify row_number() over (partition by warehouse_id, ord, created_at order by seq desc) = 1)
select r.pattern_id, r.warehouse_id, r.ord, r.requested_at, f.seq as_of_seq, f.balance as_of_balance
  from fx_requests r asof left join facts f on r.warehouse_id = f.warehouse_id and r.ord = f.ord and r.requested_at >= f.created_at
""")
def stock_as_of_request(spark, d):
    asked = requests(spark, d).drop("needed_s")
    return ops.as_of(asked, running(spark, d), ["warehouse_id", "ord"], "requested_at", "created_at", "seq", ["seq", "balance"])


@query("requests_in_outages", """
with life as (select pattern_id, warehouse_id, ord, cast(epoch(requested_at) as bigint) live_from, cast(epoch(requested_at) as bigint) + needed_s live_to from fx_requests)
select pattern_id, l.warehouse_id, count(*) n_outages, cast(sum(least(live_to, out_to) - greatest(live_from, out_from)) as bigint) seconds_out
  from life l join fx_outages o on l.warehouse_id = o.warehouse_id and l.ord = o.ord and o.balance <= 0 and o.out_from < o.out_to and live_from < live_to
   and live_from < out_to and out_from < live_to group by 1, 2
""")
def requests_in_outages(spark, d):
    start = F.unix_seconds(F.col("requested_at").cast("timestamp"))
    life = requests(spark, d).select("pattern_id", "warehouse_id", "ord", start.alias("live_from"), (start + F.col("needed_s")).alias("live_to"))
    met = ops.overlap_totals(life, outages(spark, d), ["warehouse_id", "ord"], ("live_from", "live_to"), ("out_from", "out_to"), ["pattern_id", "warehouse_id"])
    return met.withColumnsRenamed({"n": "n_outages", "shared": "seconds_out"})


@query("movement_sessions", """
with marked as (select *, case when created_at - lag(created_at) over (partition by warehouse_id order by created_at) <= interval 2 hour then 0 else 1 end fresh from fx_ledger),
numbered as (select *, sum(fresh) over (partition by warehouse_id order by created_at rows unbounded preceding) n from marked)
select warehouse_id, min(created_at) started_at, max(created_at) ended_at, count(*) n_events, cast(sum(delta) as bigint) delta from numbered group by warehouse_id, n
""")
def movement_sessions(spark, d):
    ledger = fx.ledger(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return ops.sessions(ledger, ["warehouse_id"], "created_at", 2 * 3600, ["delta"])
