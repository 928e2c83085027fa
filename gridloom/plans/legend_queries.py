"""Legend reconciliation queries over circles, tokens and readings derived from line items."""

from pyspark.sql import functions as F

from gridloom.lineage import cut_lineage
from gridloom.operators import legend as ops
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

FIXTURE_SQL["fx_circle_rows"] = """
select l_orderkey page_id, cast(60*l_linenumber+l_suppkey%3 as int) x, cast(100+90*(l_partkey%4)+l_suppkey%5 as int) y, cast(28+l_partkey%3 as int) radius,
       cast(l_partkey%4 as int) k, l_quantity, l_partkey, l_suppkey from lineitem
"""
FIXTURE_SQL["fx_circles"] = "select distinct page_id, x, y, radius, k, cast(x*100000+y*100+radius as bigint) circle_id from fx_circle_rows"
FIXTURE_SQL["fx_tokens"] = """
select distinct page_id, cast(x-10+l_suppkey%7 as int) x, cast(y+30+l_suppkey%4*8 as int) y, 20 width, 16 height, cast(cast(l_quantity as int) as varchar) text,
       cast((x-10+l_suppkey%7)*10000000+(y+30+l_suppkey%4*8)*1000+cast(l_quantity as int) as bigint) token_id from fx_circle_rows where l_suppkey%6<>0
"""


def _placed(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 60 + s % 3).cast("int").alias("x"),
        (p % 4 * 90 + 100 + s % 5).cast("int").alias("y"), (p % 3 + 28).cast("int").alias("radius"),
        F.col("l_quantity").cast("int").alias("q"), s.alias("s"),
    )


def circles(spark, d):
    return _placed(spark, d).select("page_id", "x", "y", "radius").distinct().withColumn(
        "circle_id", (F.col("x") * 100000 + F.col("y") * 100 + F.col("radius")).cast("bigint")
    )


def tokens(spark, d):
    left = (F.col("x") - 10 + F.col("s") % 7).cast("int")
    top = (F.col("y") + 30 + F.col("s") % 4 * 8).cast("int")
    return (
        _placed(spark, d).where("s % 6 <> 0")
        .select("page_id", left.alias("x"), top.alias("y"), F.lit(20).alias("width"), F.lit(16).alias("height"), F.col("q").cast("string").alias("text"),
                (left.cast("bigint") * 10000000 + top * 1000 + F.col("q")).alias("token_id")).distinct()
    )


# Circle readings: a colour, its match and some text inside.
FIXTURE_SQL["fx_readings"] = """
select l_orderkey group_id, l_linenumber, m.color_key match_key, m.hex match_hex, l_discount*100 match_distance,
       case when l_suppkey%23=0 then '空 白' when l_suppkey%29=0 then '全' when l_suppkey%3=0 then ' '||lower(i.color_key)||'.' when l_suppkey%7=0 then 'ZZ99' end inside_text
  from lineitem join fx_palette m on m.ord=l_partkey%291 join fx_palette i on i.ord=l_suppkey%291
"""


def readings(spark, d):
    pal = fx.palette(spark, d)
    match = ops.lookup_side(pal.select(F.col("ord").cast("bigint").alias("mo"), F.col("color_key").alias("match_key"), F.col("hex").alias("match_hex")))
    inside = ops.lookup_side(pal.select(F.col("ord").cast("bigint").alias("io"), F.lower("color_key").alias("ik")))
    s = F.col("l_suppkey")
    text = F.when(s % 23 == 0, "空 白").when(s % 29 == 0, "全").when(s % 3 == 0, F.concat(F.lit(" "), "ik", F.lit("."))).when(s % 7 == 0, "ZZ99")
    return (
        fx.table(spark, d, "lineitem").withColumns({"mo": F.col("l_partkey") % 291, "io": s % 291})
        .join(match, "mo").join(inside, "io")
        .select(F.col("l_orderkey").alias("group_id"), "l_linenumber", "match_key", "match_hex", (F.col("l_discount") * 100).alias("match_distance"), text.alias("inside_text"))
    )


def _decide_sql(limit: int, always: bool) -> str:
    gone = "special" if always else f"special and match_distance>{limit}"
    return f"""
select color_key, hex, color_key_source, count(*) n, round(sum(match_distance),4) total_distance from (
  select case when o then p.color_key else match_key end color_key, case when o then p.hex else match_hex end hex, case when o then 'inside_ocr' else 'palette_match' end color_key_source, match_distance
    from (select r.*, p, match_distance>{limit} and p.color_key is not null o from (select *, coalesce(contains(inside_text,'空') or contains(inside_text,'全'),false) special from fx_readings) r
      left join fx_palette p on p.color_key=regexp_replace(upper(coalesce(inside_text,'')),'[^A-Z0-9]','','g') where not ({gone}))) group by 1,2,3
"""


def _decided(spark, d, mode):
    out = ops.decide_color_key(readings(spark, d), fx.palette(spark, d), mode)
    return out.groupBy("color_key", "hex", "color_key_source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("match_distance"), 4).alias("total_distance")
    )


@query("decide_modal_colors", _decide_sql(2, True))
def decide_modal_colors(spark, d):
    return _decided(spark, d, "modal")


@query("decide_detail_colors", _decide_sql(4, False))
def decide_detail_colors(spark, d):
    return _decided(spark, d, "detail")


FIXTURE_SQL["fx_below"] = """
select c.page_id, c.circle_id, c.k, arg_min(t.text, {'a':abs(t.x+t.width/2e0-c.x)+abs(t.y+t.height/2e0-c.y-c.radius*1.55e0)*0.5e0,'b':t.token_id}) token_text from fx_circles c
  left join fx_tokens t on t.page_id=c.page_id and abs(t.x+t.width/2e0-c.x)<=greatest(c.radius*1.35e0,44) and t.y+t.height/2e0-c.y>=c.radius*0.75e0 and t.y+t.height/2e0-c.y<=c.radius*2.35e0 group by 1,2,3
"""


@query("count_below_circle", "select page_id, circle_id, token_text from fx_below")
def count_below_circle(spark, d):
    return ops.count_below_circle(circles(spark, d), tokens(spark, d)).select("page_id", "circle_id", "token_text")


@query("merge_duplicate_circles")
def merge_duplicate_circles(spark, d):
    shaken = _placed(spark, d).select(
        "page_id", (F.col("x") + F.col("q") % 9).cast("int").alias("x"), (F.col("y") + F.col("q") % 7).cast("int").alias("y"), "radius"
    )
    return ops.merge_duplicate_circles(shaken)


def _order_sql(modal: bool) -> str:
    keep = "where c<6" if modal else ""
    return f"""
with o as (select page_id, circle_id, k, row_number() over (partition by page_id, k order by x, y, circle_id)-1 c from fx_circles), f as (select * from o {keep})
select page_id, circle_id, cast(row_number() over (partition by page_id order by k, c)-1 as bigint) reading_idx from f
"""


@query("reading_order", _order_sql(False))
def reading_order(spark, d):
    return ops.reading_order(circles(spark, d)).select("page_id", "circle_id", "reading_idx")


@query("modal_reading_order", _order_sql(True))
def modal_reading_order(spark, d):
    return ops.reading_order(circles(spark, d), modal=True).select("page_id", "circle_id", "reading_idx")


@query("choose_color_row", """
with r as (select page_id, k, count(token_text) m, count(*) n, row_number() over (partition by page_id order by count(token_text) desc, count(*) desc, k desc) rn from fx_below group by 1,2)
select b.page_id, b.circle_id, b.token_text from fx_below b join r on r.page_id=b.page_id and r.k=b.k and r.rn=1
""")
def choose_color_row(spark, d):
    return ops.choose_color_row(circles(spark, d), tokens(spark, d)).select("page_id", "circle_id", "token_text")


@query("drop_edge_circles", """
with b as (select page_id, max(x)+30 hi, min(x)-30 lo from fx_circles group by 1), n as (select *, greatest(4, round_even((hi-lo)*0.004,0)) m from b)
select c.page_id, circle_id from fx_circles c join n using (page_id) where c.page_id%3=0 or case when c.page_id%3=1 then x+radius<hi-m else x-radius>lo+m end
""")
def drop_edge_circles(spark, d):
    c = circles(spark, d)
    p = F.col("page_id")
    boxes = c.groupBy("page_id").agg((F.min("x") - 30).alias("box_x"), (F.max("x") - F.min("x") + 60).alias("box_w")).select(
        "*", F.when(p % 3 == 0, 1).otherwise(2).alias("n_pages"), F.when(p % 3 == 1, 1).otherwise(2).alias("page_idx")
    )
    return ops.drop_edge_circles(c, boxes).select("page_id", "circle_id")


@query("legend_totals")
def legend_totals(spark, d):
    return ops.legend_totals(tokens(spark, d))


# --- votes ------------------------------------------------------------------

@query("count_votes", """
with v as (select l_orderkey page_id, l_partkey%40 ord, unnest([1,2,3]) i, unnest([cast(cast(l_quantity as int) as varchar), case when l_suppkey%5=0 then '' else cast(cast(l_quantity as int) as varchar)||' ' end, case when l_suppkey%3=0 then '12345' else cast(cast(floor(l_extendedprice) as bigint)%100 as varchar) end]) t from lineitem),
 g as (select page_id, ord, regexp_replace(t,'[^0-9]','','g') t, i from v), c as (select page_id, ord, t, count(*) n, min(i) i from g where length(t) between 1 and 4 group by 1,2,3)
select page_id, ord, case when max(n)>=2 or count(*)=1 then arg_min(t,{'a':-n,'b':i,'c':t}) else '' end vote_text from c group by 1,2
""")
def count_votes(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    s = F.col("l_suppkey")
    texts = F.array(q, F.when(s % 5 == 0, "").otherwise(F.concat(q, F.lit(" "))), F.when(s % 3 == 0, "12345").otherwise((F.col("l_extendedprice").cast("int") % 100).cast("string")))
    read = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 40).alias("ord"), F.posexplode(texts).alias("variant_idx", "text")
    )
    # Ties between the same variant of different rows are settled by the text.
    return ops.vote(read.withColumn("variant_idx", F.struct("variant_idx", F.col("text"))), ["page_id", "ord"])


FIXTURE_SQL["fx_chosen"] = """
select *, case when src1=src2 or src1=src3 then src1 when src2=src3 then src2 else src1 end cnt,
       not (src1=src2 and (src3 is null or src3=src1)) is_conflict from fx_observations
"""


def chosen(spark, d):
    return ops.choose_count(fx.observations(spark, d), ["src1", "src2", "src3"])


@query("choose_count", """
select group_id, page_idx, ord, cast(cnt as varchar) count_text, case when is_conflict and ((src1=src2)::int+coalesce(src1=src3,false)::int+coalesce(src2=src3,false)::int)>0 then 'majority_vote' else 'preprocessing_vote' end count_source,
       case when src1=src2 and src2 is not distinct from src3 then 'preprocessing_vote opencv_components tesseract_token' when src1=src2 then 'preprocessing_vote opencv_components' when src1=src3 then 'preprocessing_vote tesseract_token'
            when src2=src3 then 'opencv_components tesseract_token' else 'preprocessing_vote' end vote_sources, is_conflict from fx_chosen
""")
def choose_count(spark, d):
    return chosen(spark, d).select(
        "group_id", "page_idx", "ord", "count_text", "count_source", F.array_join("vote_sources", " ").alias("vote_sources"), "is_conflict"
    )


# --- page rows, groups, reconciliation --------------------------------------

FIXTURE_SQL["fx_legend_items"] = """
select c.group_id, c.page_idx, p.color_key, c.cnt, c.src1, c.src2, c.src3, c.is_conflict, c.distance, src1*10000+src2*100+coalesce(src3,0) item_idx from fx_chosen c join fx_palette p on p.ord=c.ord
"""
FIXTURE_SQL["fx_page_rows"] = """
select group_id, page_idx, color_key, sum(cnt)::bigint cnt, arg_min(src1,o) src1, arg_min(src2,o) src2, arg_min(coalesce(src3,-1),o) src3, arg_min(is_conflict,o) is_conflict, min(distance) distance
  from (select *, {'a':distance,'b':item_idx} o from fx_legend_items) group by 1,2,3
"""
FIXTURE_SQL["fx_expected"] = """
select group_id, cast(count(distinct ord) as varchar)||'_'||cast(sum(src1)+case when group_id%5=0 then 10 else 0 end as varchar) expected_pair_key from fx_observations group by 1
"""


def legend_items(spark, d):
    pal = ops.lookup_side(fx.palette(spark, d).select("ord", "color_key"))
    reads = F.filter(F.array("src1", "src2", "src3"), lambda v: v.isNotNull()).cast("array<bigint>")
    return chosen(spark, d).join(pal, "ord").select(
        "group_id", "page_idx", (F.col("src1") * 10000 + F.col("src2") * 100 + F.coalesce("src3", F.lit(0))).alias("item_idx"),
        "color_key", F.col("count_text").cast("bigint").alias("count"), reads.alias("candidates"), "is_conflict", "distance",
    )


def expected(spark, d):
    return fx.observations(spark, d).groupBy("group_id").agg(F.countDistinct("ord").alias("n"), F.sum("src1").alias("s")).select(
        "group_id", F.concat_ws("_", "n", F.col("s") + F.when(F.col("group_id") % 5 == 0, 10).otherwise(0)).alias("expected_pair_key")
    )


@query("page_color_rows", """
select group_id, page_idx, color_key, cnt as "count", concat(src1,' ',src2,case when src3>=0 then concat(' ',src3) else '' end) candidates, is_conflict, distance, distance>34 is_uncertain from fx_page_rows
""")
def page_color_rows(spark, d):
    rows = ops.page_color_rows(legend_items(spark, d))
    return rows.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), " "))


@query("modal_dedupe", """
select group_id, page_idx, color_key, arg_max(cnt,o)::bigint as "count", arg_max(is_conflict,o) is_conflict, arg_max(distance,o) distance, count(*) n_detections
  from (select *, {'a':cnt,'b':-item_idx,'c':-distance} o from fx_legend_items) group by 1,2,3
""")
def modal_dedupe(spark, d):
    # Equal rows of the fixture differ in distance only; fold it into the order.
    items = legend_items(spark, d).withColumn("item_idx", F.col("item_idx").cast("bigint") * 1000 + F.col("distance"))
    return ops.modal_dedupe(items).select("group_id", "page_idx", "color_key", "count", "is_conflict", "distance", "n_detections")


FIXTURE_SQL["fx_manifest"] = """
select l_orderkey group_id, cast(l_linenumber*100000+l_suppkey as bigint) item_idx, case when l_orderkey%9=0 then 'summary_view' when l_suppkey%3=0 then 'detail_page' when l_suppkey%3=1 then 'color_modal' else 'summary_view' end page_type,
       case when l_partkey%6=0 then null when l_partkey%6=1 then 'x_'||l_linenumber else cast(l_suppkey%3 as varchar)||'_'||cast(l_partkey%2+500 as varchar) end pair_key from lineitem
"""


def manifest(spark, d):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    page = F.when(F.col("l_orderkey") % 9 == 0, "summary_view").when(s % 3 == 0, "detail_page").when(s % 3 == 1, "color_modal").otherwise("summary_view")
    pair = F.when(p % 6 == 0, F.lit(None)).when(p % 6 == 1, F.concat(F.lit("x_"), "l_linenumber")).otherwise(F.concat_ws("_", s % 3, p % 2 + 500))
    return fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), (F.col("l_linenumber") * 100000 + s).cast("bigint").alias("item_idx"), page.alias("page_type"), pair.alias("pair_key")
    )


@query("expected_pair_key", """
select group_id, arg_min(pair_key,{'a':-n,'b':i,'c':pair_key}) expected_pair_key from (select group_id, pair_key, count(*) n, min(item_idx) i from fx_manifest where regexp_matches(pair_key,'^\\d+_\\d+$') group by 1,2) group by 1
""")
def expected_pair_key(spark, d):
    # Items of the fixture may share an index; the key itself settles those ties.
    return ops.expected_pair_key(manifest(spark, d).withColumn("item_idx", F.struct("item_idx", "pair_key")))


FIXTURE_SQL["fx_page_source"] = """
select group_id, case when bool_or(page_type='detail_page') then 'detail_page' when bool_or(page_type='color_modal') then 'color_modal' end src from fx_manifest group by 1
"""


@query("select_pages", "select m.group_id, m.page_type source_page_type, count(*) n_pages from fx_manifest m join fx_page_source s on s.group_id=m.group_id and s.src=m.page_type group by 1,2")
def select_pages(spark, d):
    pages, _errors = ops.select_pages(manifest(spark, d))
    return pages.groupBy("group_id", "source_page_type").agg(F.count(F.lit(1)).alias("n_pages"))


@query("unreadable_groups", "select group_id, 'error_no_detail_or_color_modal' analysis_status from fx_page_source where src is null")
def unreadable_groups(spark, d):
    return ops.select_pages(manifest(spark, d))[1]


FIXTURE_SQL["fx_fallback"] = """
with v as (select group_id, color_key, page_idx, unnest([1,2,3]) pos, unnest([src1,src2,src3]) v from fx_page_rows),
 c as (select group_id, color_key, v, count(*) n, min(page_idx*10+pos) at_ from v where v>=0 group by 1,2,3)
select group_id, color_key, arg_min(v,{'a':-n,'b':at_})::bigint fallback from c group by 1,2
"""
FIXTURE_SQL["fx_merged"] = """
with c as (select distinct group_id, color_key, v from (select group_id, color_key, unnest([src1,src2,src3,cnt]) v from fx_page_rows) where v>=0)
select r.*, f.fallback, x.choices from (select group_id, color_key, count(distinct cnt) n_counts, max(cnt) max_count, bool_or(is_conflict) has_conflict, min(distance) distance, count(distinct page_idx) n_pages from fx_page_rows group by 1,2) r
  join fx_fallback f using (group_id, color_key) join (select group_id, color_key, list_sort(list(v)) choices from c group by 1,2) x using (group_id, color_key)
"""


def merged(spark, d):
    rows = cut_lineage(ops.page_color_rows(legend_items(spark, d)))
    pages = rows.select("group_id", F.lit(None).cast("bigint").alias("expected_total"), F.when(F.col("group_id") % 4 == 0, F.col("page_idx").cast("bigint")).alias("transparent_count"))
    return ops.merge_pages(rows, pages)


@query("merge_pages", "select group_id, color_key, array_to_string(choices,' ') choices, n_counts, max_count, has_conflict, distance, n_pages, fallback from fx_merged")
def merge_pages(spark, d):
    return merged(spark, d)[0].withColumn("choices", F.array_join(F.col("choices").cast("array<string>"), " "))


@query("color_sources", "select distinct group_id, color_key, page_idx from fx_page_rows")
def color_sources(spark, d):
    return ops.color_sources(ops.page_color_rows(legend_items(spark, d)))


# All combinations of the uncertain colours; the lexicographically first exact one is chosen.
_RECONCILE = """
with recursive u as (select *, has_conflict or n_counts>1 unsure from fx_merged),
 k as (select *, row_number() over (partition by group_id order by color_key[1], cast(color_key[2:] as int)) rk from u where unsure),
 s as (select group_id, coalesce(sum(max_count) filter (where not unsure),0) fixed, count(*) filter (where unsure) n_open from u group by 1),
 g as (select s.*, e.expected_pair_key, cast(split_part(e.expected_pair_key,'_',2) as bigint) goal, cast(split_part(e.expected_pair_key,'_',2) as bigint)-fixed target from s join fx_expected e using (group_id)),
 w(group_id, rk, total, path) as (select group_id, cast(0 as bigint), cast(0 as bigint), cast([] as bigint[]) from g where n_open>0 and target>=0
   union all select w.group_id, w.rk+1, cast(w.total+c.v as bigint), list_append(w.path, cast(c.v as bigint)) from w join (select group_id, rk, unnest(choices) v from k) c on c.group_id=w.group_id and c.rk=w.rk+1 join g on g.group_id=w.group_id where w.total+c.v<=g.target),
 b as (select w.group_id, min(w.path) path from w join g on g.group_id=w.group_id and g.n_open=w.rk and g.target=w.total group by 1),
 st as (select g.*, case when n_open=0 then 'skipped_no_uncertain_or_expected_total' when target<0 then 'skipped_negative_target' when b.path is null then 'no_exact_combo' else 'exact_combo' end reconcile_status from g left join b using (group_id)),
 f as (select u.group_id, u.color_key, case when not u.unsure then u.max_count when b.path is not null then b.path[k.rk] else u.fallback end cnt, case when u.unsure and b.path is not null then 'group_expected_total_reconcile' when u.n_counts>1 then 'cross_page_vote' else 'page' end count_source, u.distance
   from u left join k using (group_id, color_key) left join b on b.group_id=u.group_id)
"""


def reconciled(spark, d):
    rows, totals = merged(spark, d)
    return ops.reconcile_counts(rows, totals, expected(spark, d))


@query("reconcile_counts", _RECONCILE + 'select group_id, color_key, cast(cnt as bigint) as "count", count_source, distance from f')
def reconcile_counts(spark, d):
    return reconciled(spark, d)[0]


@query("reconcile_status", _RECONCILE + "select group_id, reconcile_status, goal expected_total, n_open::int n_uncertain from st")
def reconcile_status(spark, d):
    return reconciled(spark, d)[1].select("group_id", "reconcile_status", "expected_total", "n_uncertain")


_FINAL = _RECONCILE + """
, t as (select group_id, count(*) keys, sum(cnt)::bigint beads, string_agg(color_key||'='||cnt, ' ' order by color_key) counts from f group by 1),
 tr as (select group_id, max(case when group_id%4=0 then page_idx end)::bigint transparent_count from fx_page_rows group by 1),
 fin as (select group_id, keys total_color_keys, beads total_beads, keys||'_'||beads as "current", expected_pair_key expected, expected_pair_key=keys||'_'||beads matches_expected, transparent_count,
   beads+transparent_count total_with_transparent, reconcile_status, counts color_counts from t join st using (group_id) join tr using (group_id))
"""


def _final(spark, d):
    rows, totals = merged(spark, d)
    return ops.final_of_groups(ops.reconcile_groups(rows, totals, expected(spark, d)))


@query("final_legend", _FINAL + "select * from fin")
def final_legend(spark, d):
    shown = F.array_join(F.transform(F.map_entries("color_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return _final(spark, d).withColumn("color_counts", shown)


@query("legend_conflicts", _FINAL + 'select group_id, expected, "current" from fin where expected<>"current"')
def legend_conflicts(spark, d):
    return ops.legend_conflicts(_final(spark, d)).select("group_id", "expected", "current")


@query("review_items", """
with t as (select group_id, sum(cnt) total from fx_legend_items group by 1)
select i.group_id, i.page_idx, i.item_idx, i.color_key, i.cnt::bigint selected_count, t.total::bigint current_total, cast(split_part(e.expected_pair_key,'_',2) as bigint) expected_total,
       list_min(list_filter([src1,src2,src3], lambda v: v is not null and v<>i.cnt and t.total-i.cnt+v=cast(split_part(e.expected_pair_key,'_',2) as bigint)))::bigint suggested_count
  from fx_legend_items i join t using (group_id) join fx_expected e using (group_id) where i.is_conflict
""")
def review_items(spark, d):
    items = legend_items(spark, d)
    totals = items.groupBy("group_id").agg(F.sum("count").alias("current_total")).join(expected(spark, d), "group_id")
    return ops.review_items(items, totals)
