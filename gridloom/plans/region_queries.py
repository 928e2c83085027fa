"""Connected regions and what is built on them."""

from pyspark.sql import functions as F

from gridloom.operators import cells as cell_ops
from gridloom.operators import regions as ops
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

# Regions in SQL: runs along rows, edges between overlapping runs, smallest reachable run.
FIXTURE_SQL["fx_run_cells"] = """
select *, sum(brk) over (partition by pattern_id,row_idx order by col_idx rows unbounded preceding) run from (
  select *, case when lag(color_key) over w is not distinct from color_key and lag(col_idx) over w=col_idx-1 then 0 else 1 end brk
    from fx_cells where not is_external window w as (partition by pattern_id,row_idx order by col_idx))
"""
FIXTURE_SQL["fx_runs"] = """
select pattern_id, row_idx, color_key, run, min(col_idx) c0, max(col_idx) c1, cast(row_idx as bigint)*2147483648+min(col_idx) id from fx_run_cells group by 1,2,3,4
"""
FIXTURE_SQL["fx_run_edges"] = """
select a.pattern_id, a.id lo, b.id hi from fx_runs a join fx_runs b on a.pattern_id=b.pattern_id and b.row_idx=a.row_idx+1 and a.color_key=b.color_key and a.c0<=b.c1 and b.c0<=a.c1
"""
_REACH = """with recursive sym as (select pattern_id, lo u, hi v from fx_run_edges union all select pattern_id, hi, lo from fx_run_edges),
 reach(pattern_id, id, label) as (select pattern_id, id, id from fx_runs union select r.pattern_id, s.v, r.label from reach r join sym s on s.pattern_id=r.pattern_id and s.u=r.id where s.v>r.label),
 lab as (select pattern_id, id, min(label) region_id from reach group by 1,2),
 reg as (select c.pattern_id, c.row_idx, c.col_idx, c.hex color, c.color_key, l.region_id from fx_run_cells c join fx_runs r on r.pattern_id=c.pattern_id and r.row_idx=c.row_idx and r.run=c.run
   join lab l on l.pattern_id=r.pattern_id and l.id=r.id)
"""
_SUMMARY = """, dims as (select pattern_id, max(row_idx)+1 m, max(col_idx)+1 n from fx_cells group by 1),
 summ as (select pattern_id, color, region_id, count(*) size, cast(floor(avg(row_idx)) as bigint) center_row, cast(floor(avg(col_idx)) as bigint) center_col,
   bool_or(row_idx=0 or col_idx=0 or row_idx=m-1 or col_idx=n-1) touches_edge from reg join dims using (pattern_id) group by 1,2,3)
"""
_COMPLETION = """, comp as (select pattern_id, color, region_id, bool_and((row_idx*7+col_idx)%5<3) all_done, bool_or((row_idx*7+col_idx)%5<3) any_done from reg group by 1,2,3)
"""


def labels(spark, d, by="hex"):
    return ops.label_regions(fx.cells(spark, d), by)


def completed(spark, d):
    return fx.cells(spark, d).where("(row_idx * 7 + col_idx) % 5 < 3").select("pattern_id", "row_idx", "col_idx")


@query("connected_regions", _REACH + "select pattern_id, row_idx, col_idx, color, region_id from reg")
def connected_regions(spark, d):
    return labels(spark, d)


@query("region_summary", _REACH + _SUMMARY + "select * from summ")
def region_summary(spark, d):
    return ops.region_summary(labels(spark, d), cell_ops.grid_sizes(fx.cells(spark, d)))


def seeds(spark, d):
    return fx.cells(spark, d).where("row_idx = 5 and col_idx % 9 = 4").select("pattern_id", "row_idx", "col_idx")


@query("flood_region", _REACH + """select pattern_id, row_idx, col_idx, color, region_id from reg
 where (pattern_id, region_id) in (select (pattern_id, region_id) from reg where row_idx=5 and col_idx%9=4)""")
def flood_region(spark, d):
    found = ops.flood_region(labels(spark, d), seeds(spark, d))
    return found.select("pattern_id", "row_idx", "col_idx", "color", "region_id")


@query("flood_erase", _REACH + """, gone as (select pattern_id, row_idx, col_idx from reg where (pattern_id, region_id) in (select (pattern_id, region_id) from reg where row_idx=5 and col_idx%9=4))
select c.pattern_id, c.row_idx, c.col_idx, case when g.row_idx is null then c.color_key else 'ERASE' end color_key, case when g.row_idx is null then c.hex else '#FFFFFF' end hex,
       c.is_external or g.row_idx is not null is_external from fx_cells c left join gone g on g.pattern_id=c.pattern_id and g.row_idx=c.row_idx and g.col_idx=c.col_idx""")
def flood_erase(spark, d):
    return ops.flood_erase(fx.cells(spark, d), seeds(spark, d))


@query("remove_background", _REACH + _SUMMARY + """, gone as (select r.pattern_id, r.row_idx, r.col_idx from reg r join fx_background b on b.pattern_id=r.pattern_id and b.color_key=r.color_key
   join summ s on s.pattern_id=r.pattern_id and s.region_id=r.region_id where s.touches_edge)
select c.pattern_id, c.row_idx, c.col_idx, case when g.row_idx is null then c.color_key else 'ERASE' end color_key, case when g.row_idx is null then c.hex else '#FFFFFF' end hex,
       c.is_external or g.row_idx is not null is_external from fx_cells c left join gone g on g.pattern_id=c.pattern_id and g.row_idx=c.row_idx and g.col_idx=c.col_idx""")
def remove_background(spark, d):
    return ops.remove_background(fx.cells(spark, d))


@query("region_completion", _REACH + _COMPLETION + "select * from comp")
def region_completion(spark, d):
    return ops.region_completion(labels(spark, d), completed(spark, d))


def _recommend(spark, d, mode):
    from gridloom.lineage import cut_lineage

    grid = fx.cells(spark, d)
    sizes = cell_ops.grid_sizes(grid)
    lab = cut_lineage(labels(spark, d))
    picked = grid.where("row_idx = 7 and col_idx = 11 and pattern_id % 2 = 0")
    return ops.recommend_region(
        ops.region_summary(lab, sizes), ops.region_completion(lab, completed(spark, d)), sizes, mode, picked
    )


def _recommend_sql(order: str) -> str:
    return _REACH + _SUMMARY + _COMPLETION + f"""
select pattern_id, color, region_id, size, center_row, center_col from (
  select s.*, row_number() over (partition by s.pattern_id, s.color order by {order}, s.region_id) rn from summ s join comp c using (pattern_id, color, region_id) join dims d using (pattern_id) where not c.all_done) where rn=1"""


@query("recommend_nearest_region", _recommend_sql("""abs(center_row-case when pattern_id%2=0 then 7 else floor(d.m/2) end)+abs(center_col-case when pattern_id%2=0 then 11 else floor(d.n/2) end)"""))
def recommend_nearest_region(spark, d):
    return _recommend(spark, d, "nearest")


@query("recommend_largest_region", _recommend_sql("size desc"))
def recommend_largest_region(spark, d):
    return _recommend(spark, d, "largest")


@query("recommend_edge_region", _recommend_sql("case when touches_edge then 0 else 1 end"))
def recommend_edge_region(spark, d):
    return _recommend(spark, d, "edge-first")


FIXTURE_SQL["fx_progress"] = """
select pattern_id, hex, count(*) total, count(*) filter (where (row_idx*7+col_idx)%5<3) completed,
       cast(floor(count(*) filter (where (row_idx*7+col_idx)%5<3)*100/count(*)+0.5) as bigint) percent,
       cast(row_number() over (partition by pattern_id order by min(row_idx*100000+col_idx))-1 as int) color_idx from fx_cells where not is_external group by 1,2
"""


@query("color_progress", "select * from fx_progress")
def color_progress(spark, d):
    return ops.color_progress(fx.cells(spark, d), completed(spark, d))


@query("next_unfinished_color", """
with n as (select pattern_id, count(*) n, bool_and(completed>=total) all_done from fx_progress group by 1),
     cur as (select pattern_id, max(color_idx) at_ from fx_progress group by 1)
select n.pattern_id, arg_min(p.hex,(p.color_idx-at_+n.n)%n.n) filter (where completed<total and color_idx<>at_) next_hex, any_value(all_done) all_done
  from fx_progress p join n using (pattern_id) join cur using (pattern_id) group by 1
""")
def next_unfinished_color(spark, d):
    progress = ops.color_progress(fx.cells(spark, d), completed(spark, d))
    current = progress.groupBy("pattern_id").agg(F.max_by("hex", "color_idx").alias("hex"))
    return ops.next_unfinished_color(progress, current)
