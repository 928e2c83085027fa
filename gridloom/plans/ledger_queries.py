"""Stock ledger queries."""

from pyspark.sql import functions as F

from gridloom.operators import ledger as ops
from gridloom.plans import fixtures as fx
from gridloom.plans import project_queries as pq
from gridloom.plans.registry import FIXTURE_SQL, query

# Every supplier asks for a warehouse; some requests are unusable.
FIXTURE_SQL["fx_warehouse_requests"] = """
select s_suppkey warehouse_id, case when s_suppkey%11=0 then '  ' else s_name end as "name",
       case s_suppkey%4 when 0 then '96' when 1 then '144' when 2 then '291' else '24' end palette_name, cast(floor(s_acctbal/100) as bigint) owned_count from supplier
"""


def warehouse_requests(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(
        k.alias("warehouse_id"), F.when(k % 11 == 0, "  ").otherwise(F.col("s_name")).alias("name"),
        F.when(k % 4 == 0, "96").when(k % 4 == 1, "144").when(k % 4 == 2, "291").otherwise("24").alias("palette_name"),
        F.floor(F.col("s_acctbal") / 100).alias("owned_count"),
    )


_REASON = "case when trim(name)='' then 'empty_name' when palette_name not in ('96','144','291') then 'unknown_palette' when owned_count<0 then 'bad_count' end"


@query("create_warehouses", f"""
select r.warehouse_id, p.ord item_idx, p.color_key, p.hex, r.owned_count owned, false is_extra from fx_warehouse_requests r
  join fx_palette_sets p on p.palette_name=r.palette_name where {_REASON.replace('palette_name', 'r.palette_name')} is null
""")
def create_warehouses(spark, d):
    return ops.create_warehouses(warehouse_requests(spark, d), fx.palette_sets(spark, d))[0]


@query("refused_warehouses", f"select warehouse_id, {_REASON} reason from fx_warehouse_requests where {_REASON} is not null")
def refused_warehouses(spark, d):
    return ops.create_warehouses(warehouse_requests(spark, d), fx.palette_sets(spark, d))[1]


@query("upsert_warehouses", """
with old as (select c_custkey warehouse_id, c_name "name", cast(c_custkey as bigint) created_at from customer),
     new as (select s_suppkey*20 warehouse_id, s_name "name", cast(999999 as bigint) created_at from supplier)
select warehouse_id, name, created_at from old where warehouse_id not in (select warehouse_id from new)
union all select n.warehouse_id, n.name, coalesce(o.created_at, n.created_at) from new n left join old o on o.warehouse_id=n.warehouse_id
""")
def upsert_warehouses(spark, d):
    old = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("warehouse_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("created_at")
    )
    new = fx.table(spark, d, "supplier").select(
        (F.col("s_suppkey") * 20).alias("warehouse_id"), F.col("s_name").alias("name"), F.lit(999999).cast("bigint").alias("created_at")
    )
    return ops.upsert_warehouses(old, new)


# One adjustment per warehouse and colour: the quantity a supplier's parts show; some are invalid.
FIXTURE_SQL["fx_adjustments"] = """
select cast(l_suppkey%12 as bigint) warehouse_id, lower(p.color_key) color_key, max(case when l_suppkey%50=7 then l_quantity+0.5 when l_suppkey%50=8 then -l_quantity else floor(l_quantity/5) end) owned_count
  from lineitem join fx_palette p on p.ord=l_partkey%97 group by 1,2
"""


def adjustments(spark, d):
    pal = ops.lookup_side(fx.palette(spark, d).select(F.col("ord").cast("bigint").alias("ord"), "color_key"))
    s, q = F.col("l_suppkey"), F.col("l_quantity")
    value = F.when(s % 50 == 7, q + 0.5).when(s % 50 == 8, -q).otherwise(F.floor(q / 5).cast("double"))
    return fx.table(spark, d, "lineitem").groupBy((s % 12).alias("warehouse_id"), (F.col("l_partkey") % 97).alias("ord")).agg(
        F.max(value).alias("owned_count")
    ).join(pal, "ord").select("warehouse_id", F.lower("color_key").alias("color_key"), "owned_count")


_ADJUST = """
with a as (select a.warehouse_id, upper(a.color_key) color_key, a.owned_count n, i.owned, i.hex,
  case when not (a.owned_count>=0 and a.owned_count=floor(a.owned_count)) then 'bad_count' when i.owned is null then 'unknown_item' end reason
  from fx_adjustments a left join fx_items i on i.warehouse_id=a.warehouse_id and i.color_key=upper(a.color_key))
"""


@query("adjust_stock", _ADJUST + """
select i.warehouse_id, i.item_idx, i.color_key, i.hex, coalesce(cast(a.n as bigint),i.owned) owned, i.is_extra from fx_items i
  left join a on a.warehouse_id=i.warehouse_id and a.color_key=i.color_key and a.reason is null
""")
def adjust_stock(spark, d):
    return ops.adjust_stock(fx.items(spark, d), adjustments(spark, d))[0]


@query("adjust_stock_entries", _ADJUST + """
select warehouse_id, color_key, hex, cast(n as bigint)-owned delta, owned "before", cast(n as bigint) "after" from a where reason is null and cast(n as bigint)<>owned
""")
def adjust_stock_entries(spark, d):
    return ops.adjust_stock(fx.items(spark, d), adjustments(spark, d))[1]


@query("adjust_stock_violations", _ADJUST + "select warehouse_id, color_key, reason from a where reason is not null")
def adjust_stock_violations(spark, d):
    return ops.adjust_stock(fx.items(spark, d), adjustments(spark, d))[2]


# --- restocking -------------------------------------------------------------

FIXTURE_SQL["fx_preview_lines"] = """
select warehouse_id, line_no doc_id, unnest([1,3]) line_number, trim(line) line, color_key, cnt, flat from fx_parsed_lines
"""
FIXTURE_SQL["fx_preview"] = """
select l.*, p.hex, case when l.color_key is null then 'unreadable' when cnt<=0 then 'count_not_positive' when p.hex is null then 'unknown_color' end reason
  from fx_preview_lines l left join fx_palette p on p.color_key=l.color_key
"""
FIXTURE_SQL["fx_preview_entries"] = """
select e.warehouse_id, e.color_key, e.cnt as "count", e.hex, e.n line_count, i.color_key is not null already_in_warehouse, coalesce(i.is_extra,true) is_extra
  from (select warehouse_id, color_key, hex, cast(sum(cnt) as bigint) cnt, count(*) n from fx_preview where reason is null group by 1,2,3) e
  left join fx_items i on i.warehouse_id=e.warehouse_id and i.color_key=e.color_key
"""


def preview(spark, d):
    lines = fx.replenish(spark, d)
    texts = lines.select("warehouse_id", F.col("line_no").alias("doc_id"), F.concat("line", F.lit("\r\n \n"), "line").alias("text"))
    return ops.replenish_preview(texts, fx.items(spark, d), fx.palette(spark, d))


@query("replenish_preview", "select * from fx_preview_entries")
def replenish_preview(spark, d):
    return preview(spark, d)[0]


@query("replenish_errors", "select warehouse_id, doc_id, line_number, line, reason from fx_preview where reason is not null")
def replenish_errors(spark, d):
    return preview(spark, d)[1]


# Requests: one per part for its line; codes as typed.
FIXTURE_SQL["fx_entries"] = """
select l_orderkey warehouse_id, case when l_partkey%50=0 then '  ' else ' '||lower(p.color_key)||' ' end color_key, case when l_suppkey%40=0 then 0 else cast(l_quantity as bigint) end cnt
  from lineitem join fx_palette p on p.ord=l_partkey%291
"""


def entries(spark, d):
    pal = ops.lookup_side(fx.palette(spark, d).select(F.col("ord").cast("bigint").alias("ord"), "color_key"))
    p = F.col("l_partkey")
    return fx.table(spark, d, "lineitem").withColumn("ord", p % 291).join(pal, "ord").select(
        F.col("l_orderkey").alias("warehouse_id"),
        F.when(p % 50 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("color_key"), F.lit(" "))).alias("color_key"),
        F.when(F.col("l_suppkey") % 40 == 0, 0).otherwise(F.col("l_quantity").cast("bigint")).alias("count"),
    )


@query("merge_replenish", """
select warehouse_id, upper(trim(color_key)) color_key, cast(sum(cnt) as bigint) "count" from fx_entries where trim(color_key)<>'' and warehouse_id not in
  (select warehouse_id from fx_entries where trim(color_key)<>'' and cnt<=0) group by 1,2
""")
def merge_replenish(spark, d):
    return ops.merge_replenish(entries(spark, d))[0]


@query("merge_replenish_violations", """
select distinct warehouse_id, upper(trim(color_key)) color_key, 'bad_count' reason from fx_entries where trim(color_key)<>'' and cnt<=0
union all select warehouse_id, '', 'nothing_to_import' from fx_entries group by 1 having bool_and(trim(color_key)='')
""")
def merge_replenish_violations(spark, d):
    return ops.merge_replenish(entries(spark, d))[1]


_MERGED = """
with m as (select warehouse_id, color_key, "count" from fx_preview_entries union all select 3, 'QQ1', 4)
, bad as (select warehouse_id from m where color_key not in (select color_key from fx_palette)), good as (select * from m where warehouse_id not in (select * from bad))
"""


def _restocked(spark, d):
    merged = preview(spark, d)[0].select("warehouse_id", "color_key", "count")
    wrong = merged.where("warehouse_id = 3").select("warehouse_id").distinct().select(
        "warehouse_id", F.lit("QQ1").alias("color_key"), F.lit(4).cast("bigint").alias("count")
    )
    stock = fx.items(spark, d).where("item_idx % 9 <> 1")
    return ops.replenish(stock, merged.unionByName(wrong), fx.palette(spark, d))


@query("replenish", _MERGED + """
, s as (select * from fx_items where item_idx%9<>1), l as (select warehouse_id, max(item_idx) last from s group by 1)
select coalesce(s.warehouse_id,g.warehouse_id) warehouse_id, coalesce(s.item_idx, l.last+1+p.ord) item_idx, coalesce(s.color_key,g.color_key) color_key,
       coalesce(s.hex,p.hex) hex, coalesce(s.owned,0)+coalesce(g."count",0) owned, coalesce(s.is_extra,true) is_extra
  from s full join good g on g.warehouse_id=s.warehouse_id and g.color_key=s.color_key left join fx_palette p on p.color_key=g.color_key
  left join l on l.warehouse_id=coalesce(s.warehouse_id,g.warehouse_id)
""")
def replenish(spark, d):
    return _restocked(spark, d)[0]


@query("replenish_entries", _MERGED + """
, s as (select * from fx_items where item_idx%9<>1)
select cast(g.warehouse_id as bigint) warehouse_id, g.color_key, p.hex, g."count" delta, coalesce(s.owned,0) "before", coalesce(s.owned,0)+g."count" "after"
  from good g join fx_palette p on p.color_key=g.color_key left join s on g.warehouse_id=s.warehouse_id and g.color_key=s.color_key
""")
def replenish_entries(spark, d):
    return _restocked(spark, d)[1]


@query("replenish_violations", _MERGED + "select warehouse_id, color_key, 'unknown_color' reason from m where color_key not in (select color_key from fx_palette)")
def replenish_violations(spark, d):
    return _restocked(spark, d)[2]


# --- rollback and deletion --------------------------------------------------

# Twenty events form one transaction of the warehouse that holds the first of them.
FIXTURE_SQL["fx_txn_entries"] = """
select cast(floor(seq/20) as bigint) txn_id, p.color_key, delta from fx_ledger l join fx_palette p on p.ord=l.ord
"""
FIXTURE_SQL["fx_txns"] = """
select cast(floor(seq/20) as bigint) txn_id, arg_min(warehouse_id, seq) warehouse_id, min(seq) seq from fx_ledger group by 1
"""


def transactions(spark, d):
    led = fx.ledger(spark, d)
    pal = ops.lookup_side(fx.palette(spark, d).select("ord", "color_key"))
    txn = F.floor(F.col("seq") / 20).alias("txn_id")
    heads = led.groupBy(txn).agg(F.min_by("warehouse_id", "seq").alias("warehouse_id"), F.min("seq").alias("seq"))
    return heads, led.join(pal, "ord").select(txn, "color_key", "delta")


FIXTURE_SQL["fx_rollback_requests"] = """
select case when warehouse_id%4=3 then warehouse_id+1 else warehouse_id end warehouse_id, case when warehouse_id=5 then -1 else txn_id end txn_id from
  (select warehouse_id, max(txn_id) txn_id from fx_txns group by 1)
"""


def _rolled_back(spark, d):
    txns, rows = transactions(spark, d)
    w = F.col("warehouse_id")
    latest = txns.groupBy("warehouse_id").agg(F.max("txn_id").alias("txn_id"))
    asked = latest.select(
        F.when(w % 4 == 3, w + 1).otherwise(w).alias("warehouse_id"), F.when(w == 5, F.lit(-1)).otherwise(F.col("txn_id")).alias("txn_id")
    )
    return ops.rollback_transactions(fx.items(spark, d), txns, rows, asked)


_ROLLBACK = """
with r as (select q.*, t.warehouse_id as owner_id, count(*) over (partition by q.warehouse_id) n from fx_rollback_requests q left join fx_txns t on t.txn_id=q.txn_id),
 r1 as (select *, case when n>1 then 'several_requests' when owner_id is null then 'unknown_transaction' when owner_id<>warehouse_id then 'other_warehouse' end reason from r),
 mv as (select r1.warehouse_id, r1.txn_id, e.color_key, sum(e.delta) delta, any_value(i.owned) owned from r1 join fx_txn_entries e on e.txn_id=r1.txn_id and e.delta<>0
        left join fx_items i on i.warehouse_id=r1.warehouse_id and i.color_key=e.color_key where r1.reason is null group by 1,2,3),
 bad as (select warehouse_id, txn_id, max(case when owned is null then 'unknown_color' when owned-delta<0 then 'negative_stock' end) reason from mv group by 1,2)
"""


@query("rollback_transactions", _ROLLBACK + """
select i.warehouse_id, i.item_idx, i.color_key, i.hex, cast(i.owned-coalesce(m.delta,0) as bigint) owned, i.is_extra from fx_items i
  left join (select mv.* from mv join bad using (warehouse_id, txn_id) where bad.reason is null) m on m.warehouse_id=i.warehouse_id and m.color_key=i.color_key
""")
def rollback_transactions(spark, d):
    return _rolled_back(spark, d)[0]


@query("rollback_remaining", _ROLLBACK + """
select t.txn_id, t.warehouse_id, t.seq from fx_txns t where txn_id not in (select r1.txn_id from r1 left join bad using (warehouse_id, txn_id) where r1.reason is null and bad.reason is null)
""")
def rollback_remaining(spark, d):
    return _rolled_back(spark, d)[1]


@query("rollback_violations", _ROLLBACK + """
select warehouse_id, txn_id, reason from r1 where reason is not null union all select warehouse_id, txn_id, reason from bad where reason is not null
""")
def rollback_violations(spark, d):
    return _rolled_back(spark, d)[2]


# Warehouses here are nations; customers are projects bound to them unless they hold an account in the black.
_DELETE = """
with w as (select n_nationkey warehouse_id, n_name "name" from nation), p as (select c_nationkey warehouse_id, c_custkey project_id from customer where c_nationkey%3<>0),
 q as (select distinct cast(s_nationkey+case when s_suppkey%30=0 then 100 else 0 end as int) warehouse_id from supplier where s_suppkey%2=0),
 b as (select warehouse_id, count(*) n from p group by 1), c as (select q.warehouse_id, case when w.warehouse_id is null then 'unknown_warehouse' when b.n>0 then 'bound_to_project' end reason, coalesce(b.n,0) n_projects
   from q left join w using (warehouse_id) left join b using (warehouse_id))
"""


def _deleted(spark, d):
    w = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("warehouse_id"), F.col("n_name").alias("name"))
    p = fx.table(spark, d, "customer").where("c_nationkey % 3 <> 0").select(F.col("c_nationkey").alias("warehouse_id"), F.col("c_custkey").alias("project_id"))
    asked = fx.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(
        (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 30 == 0, 100).otherwise(0)).alias("warehouse_id")
    )
    rows = fx.table(spark, d, "lineitem").select((F.col("l_partkey") % 25).cast("int").alias("warehouse_id"), F.col("l_orderkey").alias("txn_id"))
    return ops.delete_warehouses(w, rows.distinct(), rows, p, asked)


@query("delete_warehouses", _DELETE + "select warehouse_id, name from w where warehouse_id not in (select warehouse_id from c where reason is null)")
def delete_warehouses(spark, d):
    return _deleted(spark, d)[0]


@query("delete_warehouse_transactions", _DELETE + """
select cast(l_partkey%25 as int) warehouse_id, count(*) n from lineitem where cast(l_partkey%25 as int) not in (select warehouse_id from c where reason is null) group by 1
""")
def delete_warehouse_transactions(spark, d):
    return _deleted(spark, d)[2].groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("n"))


@query("delete_violations", _DELETE + "select * from c where reason is not null")
def delete_violations(spark, d):
    return _deleted(spark, d)[3]


# --- views ------------------------------------------------------------------

@query("running_balance", """
select seq, warehouse_id, ord, delta, cast(sum(delta) over (partition by warehouse_id, ord order by seq) as bigint) "after",
       cast(sum(delta) over (partition by warehouse_id, ord order by seq)-delta as bigint) "before" from fx_ledger
""")
def running_balance(spark, d):
    led = fx.ledger(spark, d).select("seq", "warehouse_id", F.col("ord").alias("color_key"), "delta")
    return ops.running_balance(led).withColumnRenamed("color_key", "ord").select("seq", "warehouse_id", "ord", "delta", "after", "before")


@query("recent_transactions", """
select txn_id, warehouse_id, seq, cast(rn as int) recency from (select *, row_number() over (partition by warehouse_id order by seq desc) rn from fx_txns) where rn<=5
""")
def recent_transactions(spark, d):
    return ops.recent_transactions(transactions(spark, d)[0])


@query("net_change", "select txn_id, cast(sum(delta) as bigint) net_change, count(*) n_entries from fx_txn_entries group by 1")
def net_change(spark, d):
    return ops.net_change(transactions(spark, d)[1])


@query("stock_totals", """
select warehouse_id, cast(sum(owned) as bigint) total_owned, count(*) n_colors, count(*) filter (where is_extra) n_extra from fx_items group by 1
""")
def stock_totals(spark, d):
    return ops.stock_totals(fx.items(spark, d))


@query("color_series_counts", "select warehouse_id, color_key[1] prefix, count(*) n_colors from fx_items group by 1,2")
def color_series_counts(spark, d):
    return ops.color_series_counts(fx.items(spark, d))


FIXTURE_SQL["fx_wh_demand"] = """
select d.warehouse_id, d.color_key, d.hex, d.needed, coalesce(i.owned,0) owned, greatest(0,d.needed-coalesce(i.owned,0)) missing from
  (select warehouse_id, color_key, arg_min(hex,{'a':project_id,'b':hex}) hex, cast(sum(needed) as bigint) needed from fx_required group by 1,2) d
  left join fx_items i on i.warehouse_id=d.warehouse_id and i.color_key=d.color_key
"""


@query("warehouse_demand", "select * from fx_wh_demand")
def warehouse_demand(spark, d):
    return ops.warehouse_demand(pq.required(spark, d), fx.items(spark, d))


@query("warehouse_health", """
select w.warehouse_id, case when n is null then 'none' when short=0 then 'ok' when empty_ or short>n*0.5 then 'severe' else 'needs' end health,
       coalesce(short,0) n_missing, cast(coalesce(needed,0) as bigint) total_needed, cast(coalesce(missing,0) as bigint) total_missing
  from (select distinct s_suppkey%14 warehouse_id from supplier) w left join (select warehouse_id, count(*) n, count(*) filter (where missing>0) short,
     bool_or(missing>0 and owned=0) empty_, sum(needed) needed, sum(missing) missing from fx_wh_demand group by 1) d using (warehouse_id)
""")
def warehouse_health(spark, d):
    houses = fx.table(spark, d, "supplier").select((F.col("s_suppkey") % 14).alias("warehouse_id")).distinct()
    return ops.warehouse_health(houses, ops.warehouse_demand(pq.required(spark, d), fx.items(spark, d)))
