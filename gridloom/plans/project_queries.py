"""Project demand, requirements and membership queries."""

from pyspark.sql import functions as F

from gridloom.operators import projects as ops
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

FIXTURE_SQL["fx_demand"] = """
with act as (select * from fx_patterns where status<>'completed'),
 k as (select a.project_id, a.warehouse_id, c.color_key, c.cnt from act a join fx_counted c using (pattern_id) where pattern_id%4<>0),
 h as (select k.project_id, k.color_key, coalesce(i.hex, printf('#%06X', (list_reduce(list_transform(string_split(k.color_key,''), lambda c: cast(unicode(c) as bigint)), lambda acc, c: (acc*31+c)%4294967296, cast(0 as bigint)))%16777216)) hex, cnt
       from k left join fx_items i on i.warehouse_id=k.warehouse_id and i.color_key=k.color_key),
 g as (select a.project_id, c.color_key, c.hex, c.cnt from act a join fx_counted c using (pattern_id) where pattern_id%4=0)
select project_id, hex, color_key, cast(sum(cnt) as bigint) needed from (select project_id, hex, color_key, cnt from h union all select project_id, hex, color_key, cnt from g) group by 1,2,3
"""
FIXTURE_SQL["fx_hex_stock"] = """
select warehouse_id, hex, arg_max(color_key,item_idx) color_key, arg_max(owned,item_idx) owned from fx_items group by 1,2
"""
FIXTURE_SQL["fx_required"] = """
select d.project_id, d.project_id%10 warehouse_id, d.hex, coalesce(nullif(d.color_key,''),s.color_key,'') color_key, d.needed, coalesce(s.owned,0) owned,
       greatest(0,d.needed-coalesce(s.owned,0)) missing, coalesce(s.owned,0)-d.needed remaining
  from fx_demand d left join fx_hex_stock s on s.warehouse_id=d.project_id%10 and s.hex=d.hex
"""
FIXTURE_SQL["fx_summary"] = """
select project_id, cast(sum(needed) as bigint) total_needed, cast(sum(least(needed,owned)) as bigint) total_owned, cast(sum(missing) as bigint) total_missing,
       count(*) colors_needed, count(*) filter (where missing>0) missing_colors from fx_required group by 1
"""


def projects(spark, d):
    c = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(c.alias("project_id"), (c % 10).alias("warehouse_id"), F.col("c_name").alias("name"))


def demand(spark, d):
    counts = fx.counted(spark, d).withColumnRenamed("cnt", "count")
    return ops.project_demand(
        fx.patterns(spark, d), counts.where("pattern_id % 4 <> 0").select("pattern_id", "color_key", "count"),
        counts.where("pattern_id % 4 = 0"), fx.items(spark, d),
    )


def required(spark, d):
    return ops.requirements(demand(spark, d), projects(spark, d), fx.items(spark, d))


@query("project_demand", "select * from fx_demand")
def project_demand(spark, d):
    return demand(spark, d)


@query("project_demand_by_hex", """
select project_id, hex, cast(sum(cnt) as bigint) needed, coalesce(arg_min(nullif(k,''),pattern_id) filter (where k<>''),'') color_key from
  (select a.project_id, a.pattern_id, c.hex, c.cnt, case when a.pattern_id%3=0 then '' else c.color_key end k from fx_patterns a join fx_counted c using (pattern_id) where status<>'completed') group by 1,2
""")
def project_demand_by_hex(spark, d):
    counts = fx.counted(spark, d).select(
        "pattern_id", "hex", F.when(F.col("pattern_id") % 3 == 0, "").otherwise(F.col("color_key")).alias("color_key"), F.col("cnt").alias("count")
    )
    return ops.project_demand_by_hex(fx.patterns(spark, d), counts)


@query("requirements", "select * from fx_required")
def requirements(spark, d):
    return required(spark, d)


@query("requirement_summary", "select * from fx_summary")
def requirement_summary(spark, d):
    return ops.requirement_summary(required(spark, d))


@query("missing_items", "select * from fx_required where missing>0")
def missing_items(spark, d):
    return ops.missing_items(required(spark, d))


@query("derive_status", """
select c_custkey project_id, case when bool_or(p.status='in_progress') then 'in_progress' when count(p.pattern_id)>0 and bool_and(p.status='completed') then 'completed' else 'draft' end status
  from customer left join fx_patterns p on p.project_id=c_custkey group by 1
""")
def derive_status(spark, d):
    return ops.derive_status(projects(spark, d), fx.patterns(spark, d))


FIXTURE_SQL["fx_listed"] = """
select pattern_id, project_id, added_at, cast(floor(o_totalprice) as bigint) bead_total, case when pattern_id%3=0 then 'thumb_'||pattern_id else '' end thumbnail
  from fx_patterns join orders on o_orderkey=pattern_id
"""


@query("project_list", """
with p as (select project_id, count(*) n, sum(bead_total) beads, max(added_at) updated, arg_min(nullif(thumbnail,''), {'a':added_at,'b':pattern_id}) filter (where thumbnail<>'') thumb from fx_listed group by 1)
select c_custkey project_id, c_name "name", p.updated updated_at, coalesce(p.n,0) pattern_count, cast(coalesce(p.beads,0) as bigint) bead_total,
       coalesce(s.total_needed,0) total_needed, coalesce(s.total_missing,0) total_missing, p.thumb thumbnail
  from customer left join p on p.project_id=c_custkey left join fx_summary s on s.project_id=c_custkey
""")
def project_list(spark, d):
    listed = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pattern_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("added_at"),
        F.floor("o_totalprice").alias("bead_total"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("thumb_"), "o_orderkey")).otherwise("").alias("thumbnail"),
    )
    dated = projects(spark, d).join(listed.groupBy("project_id").agg(F.max("added_at").alias("updated_at")), "project_id", "left")
    return ops.project_list(dated, listed, ops.requirement_summary(required(spark, d)))


# Assignments exist for every third pattern, memberships for every fifth.
FIXTURE_SQL["fx_assignments"] = "select pattern_id, project_id from fx_patterns where pattern_id%3=0"
FIXTURE_SQL["fx_members"] = "select pattern_id, project_id, status, is_deducted, case when status='completed' then added_at end completed_at from fx_patterns where pattern_id%5=0"


def assignments(spark, d):
    return fx.patterns(spark, d).where("pattern_id % 3 = 0").select("pattern_id", "project_id")


def members(spark, d):
    return fx.patterns(spark, d).where("pattern_id % 5 = 0").select(
        "pattern_id", "project_id", "status", "is_deducted", F.when(F.col("status") == "completed", F.col("added_at")).alias("completed_at")
    )


@query("available_patterns", "select pattern_id from fx_patterns where pattern_id%3<>0 and pattern_id%5<>0")
def available_patterns(spark, d):
    pats = fx.patterns(spark, d).select("pattern_id")
    return ops.available_patterns(pats, assignments(spark, d), members(spark, d))


@query("available_to_project", "select pattern_id from fx_patterns where (pattern_id%3<>0 or project_id=7) and (pattern_id%5<>0)")
def available_to_project(spark, d):
    pats = fx.patterns(spark, d).select("pattern_id")
    return ops.available_patterns(pats, assignments(spark, d), members(spark, d), 7, hide_own=True)


# Every pattern ending in 1, 5 or 6 is asked for by its customer, one in 50 by the next customer; some are unknown.
FIXTURE_SQL["fx_asked"] = """
select case when pattern_id%50=21 then project_id+1 else project_id end project_id, case when pattern_id%70=1 then -pattern_id else pattern_id end pattern_id from fx_patterns where pattern_id%5 in (0,1)
"""


def asked(spark, d):
    p = F.col("pattern_id")
    return fx.patterns(spark, d).where("pattern_id % 5 in (0, 1)").select(
        F.when(p % 50 == 21, F.col("project_id") + 1).otherwise(F.col("project_id")).alias("project_id"),
        F.when(p % 70 == 1, -p).otherwise(p).alias("pattern_id"),
    )


_ADD = """
with q as (select distinct project_id, pattern_id from fx_asked), f as (select pattern_id, min(project_id) f from q group by 1),
 s as (select q.*, case when a.project_id<>q.project_id then 'assigned_elsewhere' when m.pattern_id is not null and m.project_id=q.project_id then null
   when p.pattern_id is null or a.pattern_id is not null or m.pattern_id is not null then 'not_available' when f.f<>q.project_id then 'assigned_elsewhere' end reason,
   coalesce(m.project_id=q.project_id,false) present
   from q left join fx_assignments a using (pattern_id) left join fx_members m using (pattern_id) left join fx_patterns p using (pattern_id) join f using (pattern_id))
"""


@query("add_patterns", _ADD + """
select project_id, pattern_id, 'draft' status from s where reason is null and not present and project_id not in (select project_id from s where reason is not null)
""")
def add_patterns(spark, d):
    return ops.add_patterns(asked(spark, d), fx.patterns(spark, d), assignments(spark, d), members(spark, d))[0]


@query("add_violations", _ADD + "select project_id, pattern_id, reason from s where reason is not null")
def add_violations(spark, d):
    return ops.add_patterns(asked(spark, d), fx.patterns(spark, d), assignments(spark, d), members(spark, d))[1]


_REMOVE = """
with bad as (select m.project_id, m.pattern_id, 'not_draft' reason from fx_members m join (select distinct * from fx_asked) q using (project_id, pattern_id) where status<>'draft'),
 go as (select distinct project_id, pattern_id from fx_asked where project_id not in (select project_id from bad))
"""


@query("remove_patterns", _REMOVE + "select m.* from fx_members m where (project_id, pattern_id) not in (select (project_id, pattern_id) from go)")
def remove_patterns(spark, d):
    return ops.remove_patterns(asked(spark, d), members(spark, d), assignments(spark, d))[0]


@query("remove_patterns_assignments", _REMOVE + "select a.* from fx_assignments a where (project_id, pattern_id) not in (select (project_id, pattern_id) from go)")
def remove_patterns_assignments(spark, d):
    return ops.remove_patterns(asked(spark, d), members(spark, d), assignments(spark, d))[1]


@query("remove_violations", _REMOVE + "select * from bad")
def remove_violations(spark, d):
    return ops.remove_patterns(asked(spark, d), members(spark, d), assignments(spark, d))[2]


_MOVE = """
with q as (select project_id, pattern_id, case pattern_id%4 when 0 then 'completed' when 1 then 'in_progress' when 2 then 'draft' else 'odd' end target from (select distinct * from fx_asked)),
 t as (select project_id, pattern_id, case when target in ('completed','in_progress') then target else 'draft' end target from q),
 locked as (select t.project_id, t.pattern_id, 'stock_deducted' reason from t join fx_members m using (project_id, pattern_id) where is_deducted and target<>'completed'),
 lost as (select project_id, pattern_id, 'no_pattern_found' reason from t where project_id not in (select project_id from fx_members join t using (project_id, pattern_id)))
"""


def _moved(spark, d):
    p = F.col("pattern_id")
    target = F.when(F.pmod(p, F.lit(4)) == 0, "completed").when(p % 4 == 1, "in_progress").when(p % 4 == 2, "draft").otherwise("odd")
    requests = asked(spark, d).distinct().withColumn("target", target)
    return ops.move_patterns(requests, members(spark, d), F.lit("2030-01-01").cast("timestamp_ntz"))


@query("move_patterns", _MOVE + """
select m.pattern_id, m.project_id, coalesce(t.target,m.status) status, m.is_deducted,
       case when t.target is null then m.completed_at when t.target='completed' then coalesce(m.completed_at, timestamp '2030-01-01') end completed_at
  from fx_members m left join t on t.project_id=m.project_id and t.pattern_id=m.pattern_id and t.project_id not in (select project_id from locked)
""")
def move_patterns(spark, d):
    return _moved(spark, d)[0]


@query("move_violations", _MOVE + "select * from locked union all select * from lost")
def move_violations(spark, d):
    return _moved(spark, d)[1]


@query("patterns_by_status", """
select project_id, count(*) filter (where status='draft') draft, count(*) filter (where status='in_progress') in_progress, count(*) filter (where status='completed') completed from fx_patterns group by 1
""")
def patterns_by_status(spark, d):
    return ops.patterns_by_status(fx.patterns(spark, d))


# --- life cycle -------------------------------------------------------------

def _created(spark, d):
    k = F.col("s_suppkey")
    title = F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" ")))
    requests = fx.table(spark, d, "supplier").select((F.when(k % 7 == 0, 0).otherwise(1_000_000) + k).alias("project_id"), title.alias("name"), (k % 12).alias("warehouse_id"))
    houses = fx.stock(spark, d).select("warehouse_id").distinct().select(
        "warehouse_id", F.concat(F.lit("w"), "warehouse_id").alias("name"), F.lit("MARD").alias("brand"), F.lit("96").alias("palette_name"))
    return ops.create_projects(requests, houses, projects(spark, d), F.lit("2030-01-01").cast("timestamp_ntz"))


_CREATE = """
with q as (select case when s_suppkey%7=0 then 0 else 1000000 end+s_suppkey project_id, case when s_suppkey%5=0 then '' else trim(s_name) end "name", s_suppkey%12 warehouse_id from supplier),
 w as (select distinct warehouse_id from fx_stock),
 c as (select q.*, case when q."name"='' then 'empty_name' when w.warehouse_id is null then 'unknown_warehouse' when p.c_custkey is not null then 'id_taken' end reason
   from q left join w using (warehouse_id) left join customer p on p.c_custkey=q.project_id)
"""


@query("create_projects", _CREATE + """
select project_id, "name", warehouse_id, 'w'||warehouse_id warehouse_name, 'MARD' brand, '96' palette_name, 'draft' status, timestamp '2030-01-01' created_at, timestamp '2030-01-01' updated_at from c where reason is null
""")
def create_projects(spark, d):
    return _created(spark, d)[0]


@query("create_project_violations", _CREATE + "select project_id, reason from c where reason is not null")
def create_project_violations(spark, d):
    return _created(spark, d)[1]


def _renamed(spark, d):
    """Two requests for every third project, empty ones and unknown ids among them."""
    c = F.col("c_custkey")
    asked = fx.table(spark, d, "customer").where(c % 3 == 0).select(
        (c + F.when(c % 7 == 0, 1_000_000).otherwise(0)).alias("project_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("request_seq"), c)
    title = F.when((c + F.col("request_seq")) % 2 == 0, " ").otherwise(F.concat(F.lit(" new "), c, F.lit("-"), "request_seq", F.lit(" ")))
    return ops.rename_projects(asked.select("project_id", "request_seq", title.alias("name")), projects(spark, d), F.lit("2030-01-01").cast("timestamp_ntz"))


_RENAME = """
with q as (select c_custkey+case when c_custkey%7=0 then 1000000 else 0 end project_id, cast(i as int) request_seq, case when (c_custkey+i)%2=0 then '' else 'new '||c_custkey||'-'||i end t
   from customer, (values (1),(2)) s(i) where c_custkey%3=0),
 c as (select q.*, case when t='' then 'empty_name' when p.c_custkey is null then 'unknown_project' end reason from q left join customer p on p.c_custkey=q.project_id),
 l as (select project_id, arg_max(t, request_seq) t from c where reason is null group by 1)
"""


@query("rename_projects", _RENAME + 'select c_custkey project_id, c_custkey%10 warehouse_id, coalesce(t,c_name) "name" from customer left join l on l.project_id=c_custkey')
def rename_projects(spark, d):
    return _renamed(spark, d)[0]


@query("rename_violations", _RENAME + "select project_id, request_seq, reason from c where reason is not null")
def rename_violations(spark, d):
    return _renamed(spark, d)[1]


def _deleted(spark, d):
    c = F.col("c_custkey")
    requests = fx.table(spark, d, "customer").where(c % 4 == 0).select(
        (c + F.when(c % 20 == 0, 1_000_000).otherwise(0)).alias("project_id"), F.when(c % 8 == 0, F.col("c_name")).otherwise("x").alias("confirm_name"))
    return ops.delete_projects(requests, projects(spark, d), members(spark, d), assignments(spark, d))


_DELETE = """
with q as (select c_custkey+case when c_custkey%20=0 then 1000000 else 0 end project_id, case when c_custkey%8=0 then c_name else 'x' end confirm from customer where c_custkey%4=0),
 c as (select q.project_id, case when p.c_custkey is null then 'unknown_project' when confirm<>p.c_name then 'name_mismatch' end reason from q left join customer p on p.c_custkey=q.project_id),
 gone as (select project_id from c where reason is null)
"""


@query("delete_projects", _DELETE + 'select c_custkey project_id, c_custkey%10 warehouse_id, c_name "name" from customer where c_custkey not in (select project_id from gone)')
def delete_projects(spark, d):
    return _deleted(spark, d)[0]


@query("delete_projects_members", _DELETE + "select m.* from fx_members m where project_id not in (select project_id from gone)")
def delete_projects_members(spark, d):
    return _deleted(spark, d)[1]


@query("delete_projects_assignments", _DELETE + "select a.* from fx_assignments a where project_id not in (select project_id from gone)")
def delete_projects_assignments(spark, d):
    return _deleted(spark, d)[2]


@query("delete_project_violations", _DELETE + "select project_id, reason from c where reason is not null")
def delete_project_violations(spark, d):
    return _deleted(spark, d)[3]
