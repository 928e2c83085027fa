"""Pattern-sheet analysis queries."""

from pyspark.sql import functions as F

from gridloom.operators import cells as cell_ops
from gridloom.operators import sheet as ops
from gridloom.operators.raster import image_sizes
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

# One sheet per image: crop a little inside, lattice of 3 × 4.5 pixels.
FIXTURE_SQL["fx_sheets"] = """
select image_id, 0.4e0 "left", -0.2e0 top, 20.6e0 "right", max(y)+0.5e0 bottom, 2.5e0+image_id*0.25e0 center_x, 3.25e0 center_y, 3.0e0 pitch_x, 4.5e0 pitch_y,
       image_id%2=0 center_is_cell_center, case image_id%3 when 0 then '96' when 1 then '144' else '291' end palette_name, max(x)+1 width, max(y)+1 height
  from fx_pixels group by 1
"""


def sheets(spark, d):
    i = F.col("image_id")
    return fx.pixels(spark, d).groupBy("image_id").agg((F.max("y") + 0.5).alias("bottom")).select(
        "image_id", F.lit(0.4).alias("left"), F.lit(-0.2).alias("top"), F.lit(20.6).alias("right"), "bottom",
        (F.lit(2.5) + i * F.lit(0.25)).alias("center_x"), F.lit(3.25).alias("center_y"), F.lit(3.0).alias("pitch_x"),
        F.lit(4.5).alias("pitch_y"), (i % 2 == 0).alias("center_is_cell_center"),
        F.when(i % 3 == 0, "96").when(i % 3 == 1, "144").otherwise("291").alias("palette_name"),
    )


def _lines_sql(source: str, lo: str, hi: str, center: str, pitch: str) -> str:
    return f"""
select image_id, v, row_number() over (partition by image_id order by v)-1 idx, lead(v) over (partition by image_id order by v) nxt from (
  select image_id, anchor+k*{pitch} v from (select *, case when center_is_cell_center then {center}-{pitch}/2 else {center} end anchor from {source}), (select unnest(range(-5,100000)) k)
   where k<=ceil(({hi}-anchor)/{pitch})+1 and anchor+k*{pitch}>{lo} and anchor+k*{pitch}<{hi}
  union all select image_id, cast({lo} as double) from {source} union all select image_id, cast({hi} as double) from {source})
"""


FIXTURE_SQL["fx_clamped"] = """
select image_id, greatest(0,floor("left")) "left", greatest(0,floor(top)) top, least(width,ceil("right")) "right", least(height,ceil(bottom)) bottom,
       center_x, center_y, pitch_x, pitch_y, center_is_cell_center, palette_name, width, height from fx_sheets
"""
FIXTURE_SQL["fx_x_lines"] = _lines_sql("fx_clamped", '"left"', '"right"', "center_x", "pitch_x")
FIXTURE_SQL["fx_y_lines"] = _lines_sql("fx_clamped", "top", "bottom", "center_y", "pitch_y")
FIXTURE_SQL["fx_sheet_cells"] = """
select *, case when visible_ratio<0.5 then 'partial' else 'full' end visibility from (
 select s.image_id, cast(b.idx as int) row_idx, cast(a.idx as int) col_idx, a.v x, b.v y, a.nxt-a.v cell_w, b.nxt-b.v cell_h,
       cast(floor(a.v+(a.nxt-a.v)*0.16e0) as bigint) crop_x, cast(floor(b.v+(b.nxt-b.v)*0.16e0) as bigint) crop_y,
       greatest(1,cast(floor((a.nxt-a.v)-(a.nxt-a.v)*0.16e0*2) as bigint)) crop_w, greatest(1,cast(floor((b.nxt-b.v)-(b.nxt-b.v)*0.16e0*2) as bigint)) crop_h,
       least(1e0,greatest(0e0,least((a.nxt-a.v)/pitch_x,(b.nxt-b.v)/pitch_y))) visible_ratio
   from fx_clamped s join fx_x_lines a on a.image_id=s.image_id and a.nxt is not null join fx_y_lines b on b.image_id=s.image_id and b.nxt is not null)
"""


@query("axis_lines", "select image_id, 'x' axis, idx, round(v,6) line from fx_x_lines union all select image_id, 'y', idx, round(v,6) from fx_y_lines")
def axis_lines(spark, d):
    lined = ops.sheet_lines(ops.clamp_sheets(sheets(spark, d), image_sizes(fx.pixels(spark, d))))
    one = lambda axis: lined.select("image_id", F.lit(axis).alias("axis"), F.posexplode(f"{axis}_lines").alias("idx", "line"))
    return one("x").unionByName(one("y")).select("image_id", "axis", F.col("idx").cast("bigint").alias("idx"), F.round("line", 6).alias("line"))


@query("fixed_board_lines", """
select image_id, b idx, round(case when center_is_cell_center then center_x-pitch_x/2 else center_x end+b*pitch_x,6) line from fx_sheets, (select unnest(range(0,53)) b)
""")
def fixed_board_lines(spark, d):
    lines = ops.fixed_boundaries(F.col("center_x"), F.col("pitch_x"), 52, F.col("center_is_cell_center"))
    return sheets(spark, d).select("image_id", F.posexplode(lines).alias("idx", "line")).select(
        "image_id", F.col("idx").cast("bigint").alias("idx"), F.round("line", 6).alias("line")
    )


@query("sheet_cells", "select image_id, row_idx, col_idx, round(x,6) x, round(y,6) y, crop_x, crop_y, crop_w, crop_h, round(visible_ratio,6) visible_ratio, visibility from fx_sheet_cells")
def sheet_cells(spark, d):
    grid = ops.generate_cells(ops.sheet_lines(ops.clamp_sheets(sheets(spark, d), image_sizes(fx.pixels(spark, d)))))
    return grid.select(
        "image_id", "row_idx", "col_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "crop_x", "crop_y", "crop_w", "crop_h",
        F.round("visible_ratio", 6).alias("visible_ratio"), "visibility",
    )


@query("manual_grid_cells", """
with m as (select image_id, 1e0 "left", 2e0 top, cast(width-1 as double) "right", cast(height-3 as double) bottom, greatest(1,(width-2)/6e0) px, greatest(1,(height-5)/9e0) py from fx_sheets)
select image_id, cast(j as int) row_idx, cast(i as int) col_idx, round("left"+i*px,6) x, round(top+j*py,6) y from m, (select unnest(range(0,6)) i), (select unnest(range(0,9)) j)
""")
def manual_grid_cells(spark, d):
    bounds = image_sizes(fx.pixels(spark, d)).select(
        "image_id", F.lit(1.0).alias("left"), F.lit(2.0).alias("top"), (F.col("width") - 1.0).alias("right"),
        (F.col("height") - 3.0).alias("bottom"), F.lit(6).alias("n_cols"), F.lit(9).alias("n_rows"),
    )
    return ops.generate_cells(ops.sheet_lines(ops.manual_sheets(bounds)), explicit_lines=True).select(
        "image_id", "row_idx", "col_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


FIXTURE_SQL["fx_samples"] = """
select c.image_id, c.row_idx, c.col_idx, floor(r/16e0+0.5) br, floor(g/16e0+0.5) bg, floor(b/16e0+0.5) bb, sum(w) n, sum(r*w) sr, sum(g*w) sg, sum(b*w) sb, min(p.y*100000+p.x) seen
  from fx_sheet_cells c join fx_clamped s on s.image_id=c.image_id
  join (select *, case when 0.2126e0*r+0.7152e0*g+0.0722e0*b<35 then 35 else 100 end w from fx_pixels where a>=32) p
    on p.image_id=c.image_id and p.x>=least(s.width-1,greatest(0,crop_x)) and p.x<least(s.width,crop_x+crop_w) and p.y>=least(s.height-1,greatest(0,crop_y)) and p.y<least(s.height,crop_y+crop_h)
 where c.visibility='full' group by 1,2,3,4,5,6
"""
FIXTURE_SQL["fx_sampled"] = """
select image_id, row_idx, col_idx, cast(floor(sr/n+0.5) as int) r, cast(floor(sg/n+0.5) as int) g, cast(floor(sb/n+0.5) as int) b from
  (select *, row_number() over (partition by image_id,row_idx,col_idx order by n desc, seen) rn from fx_samples) where rn=1
"""


@query("sample_dominant_color", "select * from fx_sampled")
def sample_dominant_color(spark, d):
    px = fx.pixels(spark, d)
    grid = ops.generate_cells(ops.sheet_lines(ops.clamp_sheets(sheets(spark, d), image_sizes(px))))
    return ops.sample_dominant_color(px, grid.where("visibility = 'full'"))


FIXTURE_SQL["fx_sampled_hues"] = "select distinct r, g, b from fx_sampled"
FIXTURE_SQL["fx_sampled_ok"] = fx.oklab_sql("fx_sampled_hues")
FIXTURE_SQL["fx_sampled_ranked"] = f"""
select d.r, d.g, d.b, p.palette_name, p.color_key, p.hex, {fx.distance_sql('d', 'p')} dist,
       row_number() over (partition by d.r,d.g,d.b,p.palette_name order by {fx.distance_sql('d', 'p')}, p.ord) rn from fx_sampled_ok d, fx_sets_ok p
"""
FIXTURE_SQL["fx_analyzed"] = """
select c.image_id pattern_id, c.row_idx, c.col_idx, case when e then 'ERASE' else m.color_key end color_key, case when e then '#FFFFFF' else m.hex end hex, e is_external,
       case when s.r is null then 1e0 when e then 0.7e0 else conf end confidence, case when s.r is null then 0e0 when e then 0.3e0 else 1-conf end uncertainty,
       case when e then 'transparent' when conf>=0.82 then 'confirmed' else 'pending' end status, c.visibility, c.visible_ratio, case when not e then m.keys end recommended
  from (select c.*, s.r, s.g, s.b, s.r is null or (s.r>=200 and s.g>=200 and s.b>=200) e from fx_sheet_cells c left join fx_sampled s using (image_id,row_idx,col_idx)) c
  join fx_clamped h on h.image_id=c.image_id left join fx_sampled s on s.image_id=c.image_id and s.row_idx=c.row_idx and s.col_idx=c.col_idx
  left join (select r,g,b,palette_name, any_value(color_key) filter (where rn=1) color_key, any_value(hex) filter (where rn=1) hex, string_agg(color_key,' ' order by rn) keys,
    any_value(least(0.99e0,greatest(0.05e0,1-dist/34))) filter (where rn=1) conf from fx_sampled_ranked where rn<=5 group by 1,2,3,4) m
   on m.r=s.r and m.g=s.g and m.b=s.b and m.palette_name=h.palette_name
"""


def analyzed(spark, d):
    return ops.analyze_sheet(fx.pixels(spark, d), sheets(spark, d), fx.palette_sets(spark, d), True, 200)


@query("analyze_sheet", """
select pattern_id, row_idx, col_idx, color_key, hex, is_external, round(confidence,6) confidence, round(uncertainty,6) uncertainty, status, visibility, recommended from fx_analyzed
""")
def analyze_sheet(spark, d):
    return analyzed(spark, d).select(
        "pattern_id", "row_idx", "col_idx", "color_key", "hex", "is_external", F.round("confidence", 6).alias("confidence"),
        F.round("uncertainty", 6).alias("uncertainty"), "status", "visibility",
        F.when(~F.col("is_external"), F.array_join("recommended_keys", " ")).alias("recommended"),
    )


FIXTURE_SQL["fx_grid_counts"] = "select pattern_id, hex, count(*) cnt, arg_min(color_key,row_idx*100000+col_idx) color_key from fx_cells where not is_external group by 1,2"
# Grids are checked against a palette that lacks half of their colours.
FIXTURE_SQL["fx_even_palette"] = "select * from fx_palette_ok where ord%2=0"
FIXTURE_SQL["fx_annotated"] = f"""
select c.*, e.color_key is null is_extra, case when e.color_key is null then (select arg_min(p.color_key,{{'a':{fx.distance_sql('a', 'p')},'b':p.ord}}) from fx_even_palette p) end recommended_key,
       case when e.color_key is null then (select arg_min(p.hex,{{'a':{fx.distance_sql('a', 'p')},'b':p.ord}}) from fx_even_palette p) end recommended_hex
  from fx_grid_counts c join fx_palette_ok a on a.hex=c.hex left join fx_even_palette e on e.color_key=c.color_key
"""


# The palette name is computed from a column: a literal on both sides would turn the join into a product.
def even_palette(spark, d):
    return fx.palette(spark, d).where("ord % 2 = 0").withColumn("palette_name", F.concat(F.lit("even"), F.col("ord") * 0))


def named(df):
    return df.withColumn("palette_name", F.concat(F.lit("even"), F.col("pattern_id") * 0))


@query("annotate_extra_colors", 'select pattern_id, hex, cnt as "count", color_key, is_extra, recommended_key, recommended_hex from fx_annotated')
def annotate_extra_colors(spark, d):
    return ops.annotate_extra_colors(named(cell_ops.color_counts(fx.cells(spark, d))), even_palette(spark, d)).drop("palette_name")


@query("palette_issues", 'select pattern_id, hex, cnt as "count", color_key, recommended_key, recommended_hex from fx_annotated where is_extra')
def palette_issues(spark, d):
    return ops.palette_issues(named(cell_ops.color_counts(fx.cells(spark, d))), even_palette(spark, d)).drop("palette_name")


# Grid cells with made-up review state, for the review queries.
FIXTURE_SQL["fx_reviewed"] = """
select c.*, round(1-(row_idx*31+col_idx*17)%100/100e0,6) confidence, round((row_idx*31+col_idx*17)%100/100e0,6) uncertainty,
       case when is_external then 'transparent' when (row_idx*31+col_idx*17)%100>70 then 'pending' when (row_idx+col_idx)%7=0 then 'changed' else 'confirmed' end status,
       case when col_idx=0 then 'partial' else 'full' end visibility, case when row_idx%4=1 then 0.9e0 else 1e0 end visible_ratio from fx_cells c
"""


def reviewed(spark, d):
    u = (F.col("row_idx") * 31 + F.col("col_idx") * 17) % 100
    status = (
        F.when(F.col("is_external"), "transparent").when(u > 70, "pending")
        .when((F.col("row_idx") + F.col("col_idx")) % 7 == 0, "changed").otherwise("confirmed")
    )
    return fx.cells(spark, d).withColumns(
        {
            "confidence": F.round(1 - u / 100, 6), "uncertainty": F.round(u / 100, 6), "status": status,
            "visibility": F.when(F.col("col_idx") == 0, "partial").otherwise("full"),
            "visible_ratio": F.when(F.col("row_idx") % 4 == 1, 0.9).otherwise(1.0),
            "recommended_keys": F.array("color_key"),
        }
    )


@query("remap_to_palette", """
select c.pattern_id, c.row_idx, c.col_idx, coalesce(a.recommended_key,c.color_key) color_key, coalesce(a.recommended_hex,c.hex) hex, c.is_external,
       case when a.hex is null then confidence else greatest(confidence,0.9e0) end confidence, case when a.hex is null then uncertainty else least(uncertainty,0.1e0) end uncertainty,
       case when a.hex is null then status else 'changed' end status, visibility, visible_ratio, coalesce(a.recommended_key,c.color_key) recommended
  from fx_reviewed c left join fx_annotated a on a.pattern_id=c.pattern_id and a.hex=c.hex and a.is_extra and not c.is_external
""")
def remap_to_palette(spark, d):
    out = ops.remap_to_palette(named(reviewed(spark, d)), even_palette(spark, d))
    return out.withColumn("recommended", F.array_join("recommended_keys", " ")).drop("recommended_keys")


_NEW = "case when {clear} then 'ERASE' when {hit} then t.color_key else c.color_key end color_key, case when {clear} then '#FFFFFF' when {hit} then t.hex else c.hex end hex, case when {clear} then true when {hit} then false else is_external end is_external, case when {hit} then 1e0 else confidence end confidence, case when {hit} then 0e0 else uncertainty end uncertainty, case when {clear} then 'transparent' when {hit} then 'changed' else status end status"


@query("update_cells", "select c.pattern_id, c.row_idx, c.col_idx, " + _NEW.format(hit="(row_idx%10=3 and col_idx%11=2)", clear="(row_idx%10=3 and col_idx%11=2 and row_idx%20=3)") + ", visibility, visible_ratio from fx_reviewed c, fx_palette t where t.ord=44")
def update_cells(spark, d):
    hit = fx.cells(spark, d).where("row_idx % 10 = 3 and col_idx % 11 = 2").withColumn("ord", F.when(F.col("row_idx") % 20 != 3, 44))
    pal = ops.lookup_side(fx.palette(spark, d).select("ord", F.col("color_key").alias("target_key"), F.col("hex").alias("target_hex")))
    fixes = hit.select("pattern_id", "row_idx", "col_idx", "ord").join(pal, "ord", "left")
    return ops.update_cells(reviewed(spark, d), fixes).drop("recommended_keys")


@query("update_color_groups", "select c.pattern_id, c.row_idx, c.col_idx, " + _NEW.format(
    hit="(not is_external and c.color_key in (select color_key from fx_palette where ord in (11,33)))", clear="(not is_external and c.color_key=(select color_key from fx_palette where ord=33))"
) + ", visibility, visible_ratio from fx_reviewed c, fx_palette t where t.ord=44")
def update_color_groups(spark, d):
    pal = fx.palette(spark, d)
    target = pal.where("ord = 44").select((F.col("ord") - 33).alias("ord"), F.col("color_key").alias("target_key"), F.col("hex").alias("target_hex"))
    rules = pal.where("ord in (11, 33)").select("ord", "color_key").join(target, "ord", "left")
    used = fx.cells(spark, d).select("pattern_id", "color_key").distinct().join(ops.lookup_side(rules), "color_key")
    return ops.update_color_groups(reviewed(spark, d), used).drop("recommended_keys")


_USELESS = "(status='transparent' or visibility='partial' or visible_ratio<0.98)"
FIXTURE_SQL["fx_review_summary"] = f"""
select pattern_id, hex, count(*) cnt, color_key, count(*) filter (where status='pending') pending_count, count(*) filter (where status='changed') changed_count, false is_useless from fx_reviewed where not is_external group by 1,2,4
union all select pattern_id, '#FFFFFF', count(*), 'ERASE', 0, count(*) filter (where status='changed'), true from fx_reviewed where {_USELESS} group by 1
"""


@query("color_review_summary", 'select pattern_id, hex, cnt as "count", color_key, pending_count, changed_count, is_useless from fx_review_summary')
def color_review_summary(spark, d):
    return ops.color_review_summary(reviewed(spark, d))


@query("color_family_rollup", """
select pattern_id, family, color_key, cast(sum(cnt) as bigint) as "count" from (select *, case when color_key='ERASE' then '无用' else color_key[1] end family from fx_review_summary)
 group by rollup (pattern_id, family, color_key) having grouping_id(pattern_id, family, color_key)<7
""")
def color_family_rollup(spark, d):
    return ops.color_family_rollup(ops.color_review_summary(reviewed(spark, d)))


@query("review_cells", f"""
with u as (select *, color_key review_key from fx_reviewed where not is_external union all select *, 'ERASE' from fx_reviewed where {_USELESS}),
 f as (select *, visibility<>'partial' and visible_ratio>=0.98 full_ from u), a as (select *, bool_or(full_) over (partition by pattern_id, review_key) any_ from f)
select pattern_id, review_key, row_idx, col_idx, uncertainty, cast(rn as int) review_rank from (select *, row_number() over (partition by pattern_id, review_key order by uncertainty desc, row_idx, col_idx) rn
  from a where full_ or not any_) where rn<=120
""")
def review_cells(spark, d):
    return ops.review_cells(reviewed(spark, d)).select("pattern_id", "review_key", "row_idx", "col_idx", "uncertainty", "review_rank")


@query("review_all_cells", f"""
with u as (select *, color_key review_key from fx_reviewed where not is_external union all select *, 'ERASE' from fx_reviewed where {_USELESS}),
 f as (select *, visibility<>'partial' and visible_ratio>=0.98 full_ from u)
select pattern_id, review_key, row_idx, col_idx, uncertainty, cast(row_number() over (partition by pattern_id, review_key order by full_ desc, uncertainty desc, row_idx, col_idx) as int) review_rank from f
""")
def review_all_cells(spark, d):
    """No sample, and partly visible cells after the full ones."""
    return ops.review_cells(reviewed(spark, d), sample=None, partial=True).select("pattern_id", "review_key", "row_idx", "col_idx", "uncertainty", "review_rank")


# Saved grids with planted mistakes: a wrong total, a missing cell, an empty code, a broken hex, a zero count.
_BROKEN = """
with c as (select pattern_id, row_idx, col_idx, is_external, case when pattern_id=2 and row_idx=3 and col_idx=3 then ' ' else color_key end color_key,
   case when pattern_id=3 and col_idx=5 then replace(hex,'#','') else hex end hex from fx_cells where not (pattern_id=1 and row_idx=2 and col_idx=4)),
 t as (select pattern_id, max(row_idx)+1 n_rows, case when pattern_id=6 then 0 else max(col_idx)+1 end n_cols, count(*) filter (where not is_external)+case when pattern_id=4 then 1 else 0 end total from fx_cells group by 1),
 k as (select pattern_id, hex, color_key, case when pattern_id=5 then cnt-cnt*(rn=1)::int else cnt end cnt from (select *, row_number() over (partition by pattern_id order by hex) rn from fx_grid_counts)),
 rs as (select pattern_id, row_idx, count(*) len from c group by 1,2), sh as (select pattern_id, count(*) r, max(len) hi, min(len) lo from rs group by 1),
 ct as (select pattern_id, count(*) filter (where trim(color_key)='') bk, count(*) filter (where not regexp_full_match(hex,'#[0-9A-Fa-f]{6}')) bh, count(*) filter (where not is_external and color_key<>'ERASE') beads from c group by 1),
 cs as (select pattern_id, count(*) filter (where cnt<=0) bc, sum(cnt) s from k group by 1),
 v as (select t.pattern_id, unnest([{'rule':'dimensions','n':(n_rows<=0 or n_cols<=0)::bigint},{'rule':'row_count','n':(r<>n_rows)::bigint},{'rule':'column_count','n':(hi<>n_cols or lo<>n_cols)::bigint},
   {'rule':'cell_key','n':bk},{'rule':'cell_hex','n':bh},{'rule':'total_of_cells','n':(beads<>total)::bigint},{'rule':'count_value','n':bc},{'rule':'total_of_counts','n':(s<>total)::bigint}]) x from t join sh using (pattern_id) join ct using (pattern_id) join cs using (pattern_id))
select pattern_id, x.rule rule, x.n n from v where x.n>0
"""


@query("validate_pattern", _BROKEN)
def validate_pattern(spark, d):
    from pyspark.sql import Window

    grid = fx.cells(spark, d)
    p = F.col("pattern_id")
    broken = grid.where("not (pattern_id = 1 and row_idx = 2 and col_idx = 4)").withColumns(
        {
            "color_key": F.when((p == 2) & (F.col("row_idx") == 3) & (F.col("col_idx") == 3), " ").otherwise(F.col("color_key")),
            "hex": F.when((p == 3) & (F.col("col_idx") == 5), F.replace("hex", F.lit("#"), F.lit(""))).otherwise(F.col("hex")),
        }
    )
    heads = grid.groupBy("pattern_id").agg(
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"), F.count_if(~F.col("is_external")).alias("total")
    ).withColumns(
        {"n_cols": F.when(p == 6, 0).otherwise(F.col("n_cols")), "total": F.col("total") + F.when(p == 4, 1).otherwise(0)}
    )
    first = F.row_number().over(Window.partitionBy("pattern_id").orderBy("hex")) == 1
    counts = cell_ops.color_counts(grid).withColumn("_z", first).withColumn(
        "count", F.when((p == 5) & F.col("_z"), 0).otherwise(F.col("count"))
    )
    return ops.validate_pattern(heads, broken, counts)


@query("pattern_save_metrics", """
select pattern_id, pending_cells, coalesce(extra_colors,0) extra_colors, cast(coalesce(extra_beads,0) as bigint) extra_beads from (select pattern_id, count(*) filter (where status='pending') pending_cells from fx_reviewed group by 1)
  left join (select pattern_id, count(*) extra_colors, sum(cnt) extra_beads from fx_annotated where is_extra group by 1) using (pattern_id)
""")
def pattern_save_metrics(spark, d):
    annotated = ops.annotate_extra_colors(named(cell_ops.color_counts(fx.cells(spark, d))), even_palette(spark, d))
    return ops.pattern_save_metrics(reviewed(spark, d), annotated)
