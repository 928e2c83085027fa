"""Raster to grid, colour merging, counting and replacing."""

from pyspark.sql import functions as F

from gridloom.operators import cells as ops
from gridloom.operators import raster
from gridloom.operators.palette import display_color_key
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query


def _assigned_sql(n: int) -> str:
    return f"""
select p.*, r.i row_idx, c.i col_idx from fx_pixels p join fx_sizes s on s.image_id=p.image_id
  join (select unnest(range(0,20000)) i) r on r.i < s.m_{n} and p.y >= floor(r.i*(s.h/s.m_{n})) and p.y < greatest(floor(r.i*(s.h/s.m_{n}))+1, least(s.h, ceil((r.i+1)*(s.h/s.m_{n}))))
  join (select unnest(range(0,{n})) i) c on p.x >= floor(c.i*(s.w/{n})) and p.x < greatest(floor(c.i*(s.w/{n}))+1, least(s.w, ceil((c.i+1)*(s.w/{n}))))
"""


FIXTURE_SQL["fx_sizes"] = """
select image_id, w, h, cast(greatest(1,floor(7*h/w+0.5)) as bigint) m_7, cast(greatest(1,floor(8*h/w+0.5)) as bigint) m_8
  from (select image_id, cast(max(x)+1 as double) w, cast(max(y)+1 as double) h from fx_pixels group by 1)
"""
FIXTURE_SQL["fx_assigned7"] = _assigned_sql(7)
FIXTURE_SQL["fx_assigned8"] = _assigned_sql(8)


@query("pixel_cells", "select image_id, row_idx::int row_idx, col_idx::int col_idx, count(*) n, cast(sum(x+1000*y) as bigint) checksum from fx_assigned8 group by 1,2,3")
def pixel_cells(spark, d):
    return raster.assign_cells(fx.pixels(spark, d), 8).groupBy("image_id", "row_idx", "col_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x") + 1000 * F.col("y")).alias("checksum")
    )


@query("average_color_cells", """
select image_id, row_idx::int row_idx, col_idx::int col_idx, cast(floor(avg(r) filter (where a>=128)+0.5) as int) r, cast(floor(avg(g) filter (where a>=128)+0.5) as int) g,
       cast(floor(avg(b) filter (where a>=128)+0.5) as int) b from fx_assigned8 group by 1,2,3
""")
def average_color_cells(spark, d):
    return raster.average_color(raster.assign_cells(fx.pixels(spark, d), 8))


def _dominant_sql(n: int) -> str:
    return f"""
select image_id, row_idx::int row_idx, col_idx::int col_idx, r, g, b from (
  select *, row_number() over (partition by image_id,row_idx,col_idx order by k desc, last) rn from (
    select image_id,row_idx,col_idx, case when a>=128 then r end r, case when a>=128 then g end g, case when a>=128 then b end b,
           count(*) filter (where a>=128) k, max(y*100000+x) last from fx_assigned{n} group by 1,2,3,4,5,6)) where rn=1
"""


FIXTURE_SQL["fx_dominant7"] = _dominant_sql(7)
FIXTURE_SQL["fx_dominant8"] = _dominant_sql(8)


@query("dominant_color_cells", "select * from fx_dominant7")
def dominant_color_cells(spark, d):
    return raster.dominant_color(raster.assign_cells(fx.pixels(spark, d), 7))


FIXTURE_SQL["fx_dominant8_hues"] = "select distinct r, g, b from fx_dominant8 where r is not null"
FIXTURE_SQL["fx_dominant8_ok"] = fx.oklab_sql("fx_dominant8_hues")
FIXTURE_SQL["fx_dominant8_match"] = f"""
select r, g, b, palette_name, color_key, hex from (
  select d.r, d.g, d.b, p.palette_name, p.color_key, p.hex,
         row_number() over (partition by d.r,d.g,d.b,p.palette_name order by {fx.distance_sql('d', 'p')}, p.ord) rn
    from fx_dominant8_ok d, fx_sets_ok p) where rn=1
"""
FIXTURE_SQL["fx_pixelated"] = """
select c.image_id pattern_id, c.row_idx, c.col_idx, coalesce(m.color_key,'ERASE') color_key, coalesce(m.hex,'#FFFFFF') hex, c.r is null is_external
  from fx_dominant8 c left join fx_dominant8_match m on m.r=c.r and m.g=c.g and m.b=c.b
   and m.palette_name=case c.image_id%3 when 0 then '96' when 1 then '144' else '291' end
"""


def image_palettes(pixels):
    m = F.col("image_id") % 3
    return pixels.select("image_id").distinct().withColumn(
        "palette_name", F.when(m == 0, "96").when(m == 1, "144").otherwise("291")
    )


def pixelated(spark, d):
    px = fx.pixels(spark, d)
    return raster.pixelate(px, image_palettes(px), fx.palette_sets(spark, d), 8)


@query("pixelate", "select * from fx_pixelated")
def pixelate(spark, d):
    return pixelated(spark, d)


FIXTURE_SQL["fx_merge_colors"] = """
select *, row_number() over (partition by pattern_id order by n desc, seen) rk from (
  select pattern_id, color_key, count(*) n, min(row_idx*100000+col_idx) seen from fx_cells where not is_external group by 1,2)
"""
FIXTURE_SQL["fx_merge_pairs"] = f"""
select a.pattern_id, a.rk lo, b.rk hi, {fx.distance_sql('pa', 'pb')} dist from fx_merge_colors a join fx_merge_colors b on a.pattern_id=b.pattern_id and a.rk<b.rk
  join fx_palette_ok pa on pa.color_key=a.color_key join fx_palette_ok pb on pb.color_key=b.color_key
"""


def _merged_sql(threshold: int) -> str:
    """Leader clustering for the fixture's twelve colours, one rank after another."""
    ranks = ["select pattern_id, rk, rk lead from fx_merge_colors where rk=1"]
    steps = ["l1 as (select pattern_id, rk, rk lead from fx_merge_colors where rk=1)"]
    for k in range(2, 13):
        steps.append(
            f"l{k} as (select * from l{k-1} union all select c.pattern_id, c.rk, coalesce((select min(l.rk) from l{k-1} l join fx_merge_pairs p "
            f"on p.pattern_id=l.pattern_id and p.lo=l.rk and p.hi={k} where l.pattern_id=c.pattern_id and l.lead=l.rk and p.dist<{threshold}),c.rk) "
            f"from fx_merge_colors c where c.rk={k})"
        )
    del ranks
    return "with " + ",\n".join(steps)


@query("color_leaders", _merged_sql(30) + """
select c.pattern_id, c.color_key, t.color_key leader from l12 join fx_merge_colors c on c.pattern_id=l12.pattern_id and c.rk=l12.rk
  join fx_merge_colors t on t.pattern_id=l12.pattern_id and t.rk=l12.lead
""")
def color_leaders(spark, d):
    return raster.color_leaders(fx.cells(spark, d), fx.palette(spark, d), 30.0)


@query("merge_similar_colors", _merged_sql(30) + """,
lead as (select c.pattern_id, c.color_key, t.color_key leader, p.hex from l12 join fx_merge_colors c on c.pattern_id=l12.pattern_id and c.rk=l12.rk
  join fx_merge_colors t on t.pattern_id=l12.pattern_id and t.rk=l12.lead join fx_palette p on p.color_key=t.color_key)
select c.pattern_id, c.row_idx, c.col_idx, coalesce(m.leader,c.color_key) color_key, coalesce(m.hex,c.hex) hex, c.is_external
  from fx_cells c left join lead m on m.pattern_id=c.pattern_id and m.color_key=c.color_key
""")
def merge_similar_colors(spark, d):
    return raster.merge_similar_colors(fx.cells(spark, d), fx.palette(spark, d), 30.0)


@query("color_counts", """
select pattern_id, upper(hex) hex, count(*) "count", arg_min(color_key, row_idx*100000+col_idx) color_key from fx_cells
 where not is_external and color_key<>'ERASE' group by 1,2
""")
def color_counts(spark, d):
    return ops.color_counts(fx.cells(spark, d))


@query("bead_totals", "select pattern_id, count(*) total, count(distinct hex) n_colors from fx_cells where not is_external group by 1")
def bead_totals(spark, d):
    return ops.bead_totals(ops.color_counts(fx.cells(spark, d)))


@query("grid_colors_by_hue", """
with g as (select pattern_id, hex, arg_min(color_key,row_idx*100000+col_idx) color_key from fx_cells where not is_external group by 1,2),
     c as (select distinct hex, cast('0x'||substr(hex,2,2) as int)/255e0 r1, cast('0x'||substr(hex,4,2) as int)/255e0 g1, cast('0x'||substr(hex,6,2) as int)/255e0 b1 from g),
     m as (select *, greatest(r1,g1,b1) mx, least(r1,g1,b1) mn from c),
     q as (select hex, case when mx=mn then 0e0 when mx=r1 then ((g1-b1)/(mx-mn)+case when g1<b1 then 6 else 0 end)/6 when mx=g1 then ((b1-r1)/(mx-mn)+2)/6 else ((r1-g1)/(mx-mn)+4)/6 end*360 h,
                  case when mx=mn then 0e0 when (mx+mn)/2>0.5 then (mx-mn)/(2e0-mx-mn) else (mx-mn)/(mx+mn) end*100 s, (mx+mn)/2*100 l from m),
     h as (select hex, case when mx=mn then 0e0 when mx=r1 then ((g1-b1)/(mx-mn)+case when g1<b1 then 6 else 0 end)/6 when mx=g1 then ((b1-r1)/(mx-mn)+2)/6 else ((r1-g1)/(mx-mn)+4)/6 end h0 from m)
select g.pattern_id, g.hex, g.color_key, coalesce(s.code,'?') display_key,
       cast(row_number() over (partition by g.pattern_id order by floor(round(h0*360,6)/5), floor(round(q.l,6)/3) desc, round(q.s,6) desc, g.hex) as int) hue_rank
  from g join q on q.hex=g.hex join h on h.hex=g.hex left join fx_systems s on s.hex=g.hex and s.system='numbers'
""")
def grid_colors_by_hue(spark, d):
    shown = display_color_key(ops.grid_colors(fx.cells(spark, d)).withColumn("system", F.lit("numbers")), fx.systems(spark, d))
    return ops.rank_by_hue(shown, ["pattern_id"]).select("pattern_id", "hex", "color_key", "display_key", "hue_rank")


@query("preview_grid", """
with s as (select pattern_id, greatest(1,ceil((max(row_idx)+1)/18)) rs, greatest(1,ceil((max(col_idx)+1)/18)) cs from fx_cells group by 1)
select c.pattern_id, c.row_idx, c.col_idx, c.color_key, c.hex from fx_cells c join s on s.pattern_id=c.pattern_id where c.row_idx%rs=0 and c.col_idx%cs=0
""")
def preview_grid(spark, d):
    return ops.preview_grid(fx.cells(spark, d)).select("pattern_id", "row_idx", "col_idx", "color_key", "hex")


FIXTURE_SQL["fx_background"] = """
select pattern_id, color_key, n border_cells from (
  select *, row_number() over (partition by pattern_id order by n desc, at_) rn from (
    select pattern_id, color_key, count(*) n, min(case when row_idx=0 then 2*col_idx when row_idx=m-1 then 2*col_idx+1 else 2*w+2*(row_idx-1)+case when col_idx=0 then 0 else 1 end end) at_
      from (select c.*, max(row_idx) over (partition by pattern_id)+1 m, max(col_idx) over (partition by pattern_id)+1 w from fx_cells c)
     where not is_external and (row_idx=0 or col_idx=0 or row_idx=m-1 or col_idx=w-1) group by 1,2)) where rn=1
"""


@query("border_background_color", "select * from fx_background")
def border_background_color(spark, d):
    return ops.border_background_color(fx.cells(spark, d))


FIXTURE_SQL["fx_rules"] = """
select distinct pattern_id, (select lower(hex) from fx_palette where ord=case when pattern_id%2=0 then 22 else 33 end) source_hex,
       (select color_key from fx_palette where ord=77) target_key, (select hex from fx_palette where ord=77) target_hex from fx_cells
"""


def _rules(spark, d):
    pal = fx.palette(spark, d)
    p = F.col("pattern_id")
    pats = fx.cells(spark, d).select("pattern_id").distinct().withColumns(
        {"_from": F.when(p % 2 == 0, 22).otherwise(33), "_to": F.when(p >= 0, 77)}
    )
    source = ops.lookup_side(pal.select(F.col("ord").alias("_from"), F.lower("hex").alias("source_hex")))
    target = ops.lookup_side(pal.select(F.col("ord").alias("_to"), F.col("color_key").alias("target_key"), F.col("hex").alias("target_hex")))
    return pats.join(source, "_from").join(target, "_to").select("pattern_id", "source_hex", "target_key", "target_hex")


@query("replace_color", """
select c.pattern_id, c.row_idx, c.col_idx, case when hit then r.target_key else c.color_key end color_key, case when hit then r.target_hex else c.hex end hex,
       c.is_external, hit is_replaced from (select c.*, not c.is_external and upper(c.hex)=upper(r.source_hex) hit, r from fx_cells c join fx_rules r on r.pattern_id=c.pattern_id) c
""")
def replace_color(spark, d):
    return ops.replace_color(fx.cells(spark, d), _rules(spark, d))


# Each pattern excludes its most used colour; every third one has excluded all others before.
FIXTURE_SQL["fx_exclusions"] = """
select pattern_id, hex, rk=1 asked from (select *, row_number() over (partition by pattern_id order by n desc, hex) rk from
  (select pattern_id, hex, count(*) n from fx_cells where not is_external group by 1,2)) where rk=1 or (pattern_id%3=0) or rk=3
"""
FIXTURE_SQL["fx_exclusion_targets"] = f"""
with used as (select distinct pattern_id, hex from fx_cells where not is_external),
 pairs as (select e.pattern_id, e.hex, b.color_key, b.hex thex, row_number() over (partition by e.pattern_id order by {fx.distance_sql('a', 'b')}, b.ord) rn
   from fx_exclusions e join used u on u.pattern_id=e.pattern_id and u.hex<>e.hex
   join fx_palette_ok a on a.hex=e.hex join fx_palette_ok b on b.hex=u.hex
   where e.asked and not exists (select 1 from fx_exclusions x where x.pattern_id=e.pattern_id and x.hex=u.hex))
select e.pattern_id, e.hex, p.color_key target_key, p.thex target_hex, case when p.thex is null then 'no_target_left' end reason
  from fx_exclusions e left join pairs p on p.pattern_id=e.pattern_id and p.rn=1 where e.asked
"""


def _exclusion_inputs(spark, d):
    from pyspark.sql import Window

    grid = fx.cells(spark, d)
    used = ops.color_counts(grid).withColumn(
        "rk", F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("count"), "hex"))
    )
    earlier = used.where("rk > 1 and (pattern_id % 3 = 0 or rk = 3)").select("pattern_id", "hex")
    return grid, used.select("pattern_id", "hex"), used.where("rk = 1").select("pattern_id", "hex"), earlier, fx.palette(spark, d)


@query("exclusion_targets", "select * from fx_exclusion_targets")
def exclusion_targets(spark, d):
    _, initial, asked, earlier, pal = _exclusion_inputs(spark, d)
    return ops.exclusion_targets(initial, asked, earlier, pal)


@query("exclude_and_remap", """
select c.pattern_id, c.row_idx, c.col_idx, coalesce(t.target_key,c.color_key) color_key, coalesce(t.target_hex,c.hex) hex, c.is_external
  from fx_cells c left join fx_exclusion_targets t on t.pattern_id=c.pattern_id and t.hex=c.hex and not c.is_external and t.reason is null
""")
def exclude_and_remap(spark, d):
    remapped, _refused = ops.exclude_and_remap(*_exclusion_inputs(spark, d))
    return remapped
