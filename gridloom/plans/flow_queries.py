"""End-to-end flows composed from the operators."""

from pyspark.sql import functions as F

from gridloom.operators import cells as cell_ops
from gridloom.operators import raster, sheet
from gridloom.plans import fixtures as fx
from gridloom.plans import raster_queries as rq
from gridloom.plans import sheet_queries as sq
from gridloom.plans.registry import query


_IMAGE_MERGED = f"""
with recursive used as (select *, case pattern_id%3 when 0 then '96' when 1 then '144' else '291' end palette_name from fx_pixelated),
ranked as (select *, row_number() over (partition by pattern_id order by n desc, seen) rk from (
  select pattern_id, palette_name, color_key, count(*) n, min(row_idx*100000+col_idx) seen from used where not is_external group by 1,2,3)),
placed as (select r.pattern_id, r.rk, p.* from ranked r join fx_sets_ok p using (palette_name, color_key)),
near as (select b.pattern_id, b.rk hi, list(a.rk order by a.rk) los from placed a join placed b on a.pattern_id=b.pattern_id and a.rk<b.rk where {fx.distance_sql('a', 'b')}<12 group by 1,2),
total as (select pattern_id, max(rk) n from ranked group by 1),
steps as (select pattern_id, cast(0 as bigint) k, cast([] as bigint[]) lead from total
  union all select s.pattern_id, s.k+1, list_append(s.lead, coalesce(list_filter(coalesce(e.los,cast([] as bigint[])), lambda x: s.lead[x]=x)[1], s.k+1))
  from steps s join total t on t.pattern_id=s.pattern_id and s.k<t.n left join near e on e.pattern_id=s.pattern_id and e.hi=s.k+1),
leaders as (select s.pattern_id, r.color_key, l.color_key leader, l.hex from steps s join total t on t.pattern_id=s.pattern_id and s.k=t.n
  join ranked r on r.pattern_id=s.pattern_id join placed l on l.pattern_id=s.pattern_id and l.rk=s.lead[r.rk]),
merged as (select c.pattern_id, c.row_idx, c.col_idx, coalesce(l.leader,c.color_key) color_key, coalesce(l.hex,c.hex) hex, c.is_external
  from fx_pixelated c left join leaders l on l.pattern_id=c.pattern_id and l.color_key=c.color_key and not c.is_external)
"""


def _image_merged(spark, d):
    palettes = rq.image_palettes(fx.pixels(spark, d))
    return raster.merge_similar_colors(rq.pixelated(spark, d), fx.palette_sets(spark, d), 12.0, palettes)


@query("image_merged_cells", _IMAGE_MERGED + "select * from merged")
def image_merged_cells(spark, d):
    """Each image merged within its own palette; every cell stays one row."""
    return _image_merged(spark, d)


@query("image_color_counts", _IMAGE_MERGED + """
select pattern_id, upper(hex) hex, count(*) "count", arg_min(color_key, row_idx*100000+col_idx) color_key from merged where not is_external group by 1,2
""")
def image_color_counts(spark, d):
    """Images to counted colours: map, merge similar colours, count."""
    return cell_ops.color_counts(_image_merged(spark, d))


@query("image_bead_totals", "select pattern_id, count(*) total from fx_pixelated where not is_external group by 1")
def image_bead_totals(spark, d):
    """Merging changes no totals."""
    merged = raster.merge_similar_colors(rq.pixelated(spark, d), fx.palette(spark, d), 12.0)
    return cell_ops.bead_totals(cell_ops.color_counts(merged)).select("pattern_id", "total")


@query("sheet_color_counts", """
select pattern_id, hex, count(*) as "count", any_value(color_key) color_key from fx_analyzed where not is_external group by 1,2
""")
def sheet_color_counts(spark, d):
    """Sheets to counted patterns."""
    return cell_ops.color_counts(sq.analyzed(spark, d))


@query("sheet_violations", """
with t as (select pattern_id, count(*) filter (where not is_external) beads from fx_analyzed group by 1)
select pattern_id, unnest(['color_counts','total_of_counts']) rule, cast(1 as bigint) n from t where beads=0
""")
def sheet_violations(spark, d):
    """Counted sheets checked like patterns about to be saved."""
    cells = sq.analyzed(spark, d)
    heads = cell_ops.grid_sizes(cells).join(
        cells.groupBy("pattern_id").agg(F.count_if(~F.col("is_external")).alias("total")), "pattern_id"
    )
    return sheet.validate_pattern(heads, cells, cell_ops.color_counts(cells))
