"""Edit logs derived from events, applied to the grids."""

from pyspark.sql import functions as F

from gridloom.operators import edits as ops
from gridloom.operators.sizing import lookup_side
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

# Every event paints one cell; errors paint with the eraser.
FIXTURE_SQL["fx_edits"] = """
select cast(user_id%10 as int) pattern_id, cast(event_id%53 as int) row_idx, cast((event_id*7)%67 as int) col_idx, event_id edit_seq,
       case when event_type='error' then 'ERASE' else p.color_key end color_key, case when event_type='error' then '#FFFFFF' else p.hex end hex
  from events join fx_palette p on p.ord=event_id%4*11
"""


def edits(spark, d):
    pal = lookup_side(fx.palette(spark, d).select(F.col("ord").cast("bigint").alias("ord"), "color_key", "hex"))
    error = F.col("event_type") == "error"
    e = F.col("event_id")
    return fx.table(spark, d, "events").withColumn("ord", e % 4 * 11).join(pal, "ord").select(
        (F.col("user_id") % 10).cast("int").alias("pattern_id"), (e % 53).cast("int").alias("row_idx"),
        ((e * 7) % 67).cast("int").alias("col_idx"), e.alias("edit_seq"),
        F.when(error, "ERASE").otherwise(F.col("color_key")).alias("color_key"),
        F.when(error, "#FFFFFF").otherwise(F.col("hex")).alias("hex"),
    )


FIXTURE_SQL["fx_effective"] = """
select pattern_id, row_idx, col_idx, edit_seq, color_key, hex, color_key='ERASE' is_external from (
  select e.*, coalesce(lag(e.color_key) over w, c.color_key) pk, coalesce(lag(e.color_key='ERASE') over w, c.is_external) px
    from fx_edits e join fx_cells c on c.pattern_id=e.pattern_id and c.row_idx=e.row_idx and c.col_idx=e.col_idx
  window w as (partition by e.pattern_id,e.row_idx,e.col_idx order by edit_seq)) where pk<>color_key or px<>(color_key='ERASE')
"""


@query("effective_edits", "select * from fx_effective")
def effective_edits(spark, d):
    return ops.effective_edits(fx.cells(spark, d), edits(spark, d))


def _applied_sql(undo: int) -> str:
    return f"""
with kept as (select * from (select *, row_number() over (partition by pattern_id order by edit_seq desc) rn from fx_effective) where rn>{undo}),
 last as (select pattern_id, row_idx, col_idx, arg_max(color_key,edit_seq) color_key, arg_max(hex,edit_seq) hex from kept group by 1,2,3)
select c.pattern_id, c.row_idx, c.col_idx, coalesce(l.color_key,c.color_key) color_key, coalesce(l.hex,c.hex) hex,
       case when l.color_key is null then c.is_external else l.color_key='ERASE' end is_external
  from fx_cells c left join last l on l.pattern_id=c.pattern_id and l.row_idx=c.row_idx and l.col_idx=c.col_idx
"""


@query("apply_edits", _applied_sql(0))
def apply_edits(spark, d):
    return ops.apply_edits(fx.cells(spark, d), edits(spark, d))


@query("apply_edits_with_undo", _applied_sql(50))
def apply_edits_with_undo(spark, d):
    return ops.apply_edits(fx.cells(spark, d), edits(spark, d), undo=80)


FIXTURE_SQL["fx_deltas"] = """
with last as (select pattern_id, row_idx, col_idx, arg_max(color_key,edit_seq) color_key, arg_max(hex,edit_seq) hex from fx_edits group by 1,2,3)
select pattern_id, hex, cast(sum(d) as bigint) delta from (
  select c.pattern_id, c.hex, -1 d from fx_cells c join last l using (pattern_id,row_idx,col_idx) where not c.is_external
  union all select c.pattern_id, l.hex, 1 from fx_cells c join last l using (pattern_id,row_idx,col_idx) where l.color_key<>'ERASE') group by 1,2
"""


@query("count_deltas", "select * from fx_deltas")
def count_deltas(spark, d):
    return ops.count_deltas(fx.cells(spark, d), edits(spark, d))


@query("counts_after_edits", """
select pattern_id, hex, cast(coalesce(n,0)+coalesce(delta,0) as bigint) "count" from (select pattern_id, hex, count(*) n from fx_cells where not is_external group by 1,2)
  full join fx_deltas using (pattern_id, hex) where coalesce(n,0)+coalesce(delta,0)>0
""")
def counts_after_edits(spark, d):
    return ops.counts_after_edits(fx.cells(spark, d), edits(spark, d))


@query("apply_edits_with_full_undo", _applied_sql(80))
def apply_edits_with_full_undo(spark, d):
    """A history that forgets nothing."""
    return ops.apply_edits(fx.cells(spark, d), edits(spark, d), undo=80, history=None)
