"""Lattice fitting over the text-centre fixture."""

from pyspark.sql import functions as F

from gridloom.operators import lattice as ops
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

SIZE = 52
FIXTURE_SQL["fx_boards"] = "select image_id, cast(ceil(max(x))+13 as int) width, cast(1060 as int) height from fx_text_centers group by 1"


def boards(spark, d):
    return fx.text_centers(spark, d).groupBy("image_id").agg((F.ceil(F.max("x")) + 13).cast("int").alias("width")).withColumn("height", F.lit(1060))


FIXTURE_SQL["fx_dists"] = """
with s as (select image_id, least(width,height)::double/60 lo, least(width,height)::double/44 hi, greatest(1.5e0,least(width,height)::double/52*0.08e0) tol from fx_boards),
 p as (select a.image_id, abs(a.x-b.x) dx, abs(a.y-b.y) dy, lo, hi, tol from fx_text_centers a join fx_text_centers b on a.image_id=b.image_id and a.idx<b.idx join s on s.image_id=a.image_id)
select image_id, lo, hi, dx d from p where dy<=tol and dx>=lo and dx<=hi union all select image_id, lo, hi, dy from p where dx<=tol and dy>=lo and dy<=hi
"""
FIXTURE_SQL["fx_pitch"] = """
with b as (select image_id, lo, least(floor((d-lo)/0.25),ceil((hi+0.25-lo)/0.25)-2) bin, count(*) n from fx_dists group by 1,2,3),
 f as (select image_id, lo+(bin+0.5)*0.25 p0 from (select *, row_number() over (partition by image_id order by n desc, bin) rn from b) where rn=1)
select f.image_id, coalesce(median(d.d) filter (where abs(d.d-p0)<=greatest(0.8,p0*0.035)), any_value(p0))::double pitch from f join fx_dists d on d.image_id=f.image_id group by 1
"""
FIXTURE_SQL["fx_axis"] = "select image_id, idx, 'x' axis, x v from fx_text_centers union all select image_id, idx, 'y', y from fx_text_centers"
FIXTURE_SQL["fx_phase"] = """
with m as (select a.*, pitch, v-floor(v/pitch)*pitch mo from fx_axis a join fx_pitch using (image_id)),
 b as (select image_id, axis, pitch, least(159,floor(mo*160/pitch)) bin, count(*) n from m group by 1,2,3,4),
 f as (select image_id, axis, pitch, (bin+0.5)*pitch/160 ph from (select *, row_number() over (partition by image_id, axis order by n desc, bin) rn from b) where rn=1),
 dl as (select m.image_id, m.axis, m.pitch, ph, (mo-ph+m.pitch/2)-floor((mo-ph+m.pitch/2)/m.pitch)*m.pitch-m.pitch/2 dd from m join f on f.image_id=m.image_id and f.axis=m.axis),
 av as (select image_id, axis, pitch, ph, avg(dd) filter (where abs(dd)<=greatest(2,pitch*0.1)) a from dl group by 1,2,3,4)
select image_id, axis, pitch, round(case when a is null then ph else (ph+a)-floor((ph+a)/pitch)*pitch end,9) phase from av
"""
FIXTURE_SQL["fx_lines"] = """
select image_id, axis, k, count(*) n from (select a.*, p.pitch, p.phase, round_even((v-phase)/pitch,0)::bigint k from fx_axis a join fx_phase p using (image_id, axis))
 where abs(v-(phase+k*pitch))<=greatest(3,pitch*0.15) group by 1,2,3
"""
FIXTURE_SQL["fx_window"] = """
select image_id, axis, st as "start", sc::bigint score from (select *, row_number() over (partition by image_id, axis order by sc desc, st) rn from
  (select image_id, axis, st, sum(n) sc from (select image_id, axis, n, unnest(range(k-51,k+1)) st from fx_lines) group by 1,2,3)) where rn=1
"""
FIXTURE_SQL["fx_fit0"] = """
select image_id, pitch, max(case when axis='x' then phase+"start"*pitch end) ox, max(case when axis='y' then phase+"start"*pitch end) oy from fx_phase join fx_window using (image_id, axis) group by 1,2
"""


def _cells_sql(fit: str) -> str:
    return f"""
select image_id, r row_idx, c col_idx, idx, x, y, residual from (select *, row_number() over (partition by image_id, r, c order by residual, idx) rn from (
  select *, round(sqrt(dx*dx+dy*dy),9) residual from (select *, x-(ox+c*pitch) dx, y-(oy+r*pitch) dy from (
    select t.*, f.pitch, f.ox, f.oy, round_even((x-ox)/f.pitch,0)::int c, round_even((y-oy)/f.pitch,0)::int r from fx_text_centers t join {fit} f on f.image_id=t.image_id)
   where c between 0 and 51 and r between 0 and 51) where abs(dx)<=greatest(3,pitch*0.16) and abs(dy)<=greatest(3,pitch*0.16))) where rn=1
"""


for _i in range(6):
    FIXTURE_SQL[f"fx_occupied{_i}"] = _cells_sql(f"fx_fit{_i}")
    FIXTURE_SQL[f"fx_fit{_i + 1}"] = f"""
with s as (select image_id, count(*)::double n, sum(col_idx)::double sc, sum(row_idx)::double sr, sum(col_idx*col_idx+row_idx*row_idx)::double sq, sum(x) sx, sum(y) sy, sum(x*col_idx+y*row_idx) sp from fx_occupied{_i} group by 1),
 p as (select *, case when n>=10 then round((sp-sc*sx/n-sr*sy/n)/(sq-sc*sc/n-sr*sr/n),9) end p from s)
select f.image_id, case when p>1 then p else f.pitch end pitch, case when p>1 then round((sx-sc*p)/n,9) else f.ox end ox, case when p>1 then round((sy-sr*p)/n,9) else f.oy end oy from fx_fit{_i} f left join p using (image_id)
"""


@query("estimate_pitch", "select image_id, round(pitch,6) pitch from fx_pitch")
def estimate_pitch(spark, d):
    return ops.estimate_pitch(fx.text_centers(spark, d), boards(spark, d), SIZE).withColumn("pitch", F.round("pitch", 6))


def phases(spark, d):
    pts = fx.text_centers(spark, d)
    return ops.fit_phase(pts, ops.estimate_pitch(pts, boards(spark, d), SIZE))


@query("fit_phase", "select image_id, axis, round(pitch,6) pitch, round(phase,6) phase from fx_phase")
def fit_phase(spark, d):
    return phases(spark, d).withColumns({c: F.round(c, 6) for c in ("pitch", "phase")})


@query("lattice_counts", "select * from fx_lines")
def lattice_counts(spark, d):
    return ops.lattice_counts(fx.text_centers(spark, d), phases(spark, d))


@query("best_window", "select * from fx_window")
def best_window(spark, d):
    return ops.best_window(ops.lattice_counts(fx.text_centers(spark, d), phases(spark, d)), SIZE)


@query("assign_lattice_cells", "select image_id, row_idx, col_idx, idx, round(residual,6) residual from fx_occupied0")
def assign_lattice_cells(spark, d):
    pts = fx.text_centers(spark, d)
    cells = ops.assign_cells(pts, ops.initial_fit(pts, boards(spark, d), SIZE), SIZE)
    return cells.select("image_id", "row_idx", "col_idx", "idx", F.round("residual", 6).alias("residual"))


@query("refine_lattice", "select image_id, round(ox,6) origin_x, round(oy,6) origin_y, round(pitch,6) pitch from fx_fit5")
def refine_lattice(spark, d):
    pts = fx.text_centers(spark, d)
    fits = ops.refine_lattice(pts, ops.initial_fit(pts, boards(spark, d), SIZE), SIZE)
    return fits.select("image_id", *[F.round(c, 6).alias(c) for c in ("origin_x", "origin_y", "pitch")])


@query("fit_lattice", """
with t as (select image_id, count(*) candidates from fx_text_centers group by 1), s as (select image_id, count(*) matched, max(row_idx)-min(row_idx)+1 sr, max(col_idx)-min(col_idx)+1 sc, avg(residual) ar, median(residual) mr, max(residual) xr from fx_occupied5 group by 1)
select image_id, round(ox,6) origin_x, round(oy,6) origin_y, round(pitch,6) pitch, candidates, matched, round(ar,6) avg_residual, round(mr,6) median_residual, round(xr,6) max_residual, round(ox-pitch/2,6) "left", round(oy+51*pitch+pitch/2,6) bottom,
  round_even(least(0.98e0,greatest(0.05e0,round(least(1,matched/greatest(12,candidates*0.75e0))*0.45e0+(sr/52e0+sc/52e0)/2*0.35e0+greatest(0,1-ar/greatest(1,pitch*0.18e0))*0.2e0,9))),3) confidence
  from fx_fit5 join t using (image_id) join s using (image_id)
""")
def fit_lattice(spark, d):
    fits, _failed = ops.fit_lattice(fx.text_centers(spark, d), boards(spark, d), SIZE)
    rounded = [F.round(c, 6).alias(c) for c in ("origin_x", "origin_y", "pitch", "avg_residual", "median_residual", "max_residual", "left", "bottom")]
    return fits.select("image_id", *rounded, "candidates", "matched", "confidence")


@query("top_candidates", """
with r as (select *, row_number() over (partition by image_id order by score desc, idx) rk from fx_text_centers), k as (select * from r where rk<=300)
select image_id, idx, cast(rk as int) rank, cast(row_number() over (partition by image_id order by y, x, rk)-1 as int) cand_idx from k
""")
def top_candidates(spark, d):
    return ops.top_candidates(fx.text_centers(spark, d), 300).select("image_id", "idx", "rank", "cand_idx")


@query("all_candidates", """
with r as (select *, row_number() over (partition by image_id order by score desc, idx) rk from fx_text_centers)
select image_id, idx, cast(rk as int) rank, cast(row_number() over (partition by image_id order by y, x, rk)-1 as int) cand_idx from r
""")
def all_candidates(spark, d):
    return ops.top_candidates(fx.text_centers(spark, d)).select("image_id", "idx", "rank", "cand_idx")


def sized_centers(spark, d):
    """Text centres with made-up glyph sizes and scores around 55."""
    i = F.col("idx")
    return fx.text_centers(spark, d).withColumns(
        {"width": (i % 5 + 6).cast("int"), "height": (i % 3 + 9).cast("int"), "score": F.col("score") / 20 + i % 3}
    )


@query("pitch_votes", """
with t as (select image_id, idx, x, y, idx%5+6 width, idx%3+9 height, score/20+idx%3 score from fx_text_centers), z as (select image_id, greatest(4,median(height)*0.8e0) ny, greatest(4,median(width)*0.55e0) nx from t group by 1),
 k as (select * from (select *, row_number() over (partition by image_id order by score desc, idx) rk from t) where rk<=900),
 s as (select b.image_id, greatest(6e0,least(width,height)/60e0) mn, least(95e0,least(width,height)/10e0) mx, ny, nx from fx_boards b join z using (image_id)),
 p as (select a.image_id, abs(a.x-b.x) dx, abs(a.y-b.y) dy, mn, mx, ny, nx from k a join k b on a.image_id=b.image_id and a.idx<b.idx join s on s.image_id=a.image_id),
 d as (select image_id, mn, mx, dx d from p where dy<=ny and dx>=mn union all select image_id, mn, mx, dy from p where dx<=nx and dy>=mn),
 v as (select image_id, mn, mx, d/q pt, case when q=1 then 4e0 else 1.4e0/sqrt(q) end w from d, (select unnest(range(1,9)) q))
select image_id, round_even(pt*2,0)::bigint "key", round(sum(w),4) weight from v where pt>=mn and pt<=mx group by 1,2
""")
def pitch_votes(spark, d):
    cands = ops.top_candidates(sized_centers(spark, d), ops.TOP_CANDIDATES)
    return ops.pitch_votes(cands, boards(spark, d), SIZE).withColumn("weight", F.round("weight", 4))


@query("propose_pitches")
def propose_pitches(spark, d):
    cands = ops.top_candidates(sized_centers(spark, d), ops.TOP_CANDIDATES)
    return ops.propose_pitches(cands, boards(spark, d), SIZE)


@query("lattice_components", """
with recursive n as (select image_id, row_idx, col_idx, row_idx*1000+col_idx id from fx_occupied5 where (row_idx*7+col_idx*3)%5<2),
 e as (select a.image_id, a.id u, b.id v from n a join n b on a.image_id=b.image_id and a.id<>b.id and abs(a.row_idx-b.row_idx)<=2 and abs(a.col_idx-b.col_idx)<=2 and abs(a.row_idx-b.row_idx)+abs(a.col_idx-b.col_idx)<=3),
 r(image_id, id, label) as (select image_id, id, id from n union select r.image_id, e.v, r.label from r join e on e.image_id=r.image_id and e.u=r.id where e.v>r.label),
 l as (select image_id, id, min(label) label from r group by 1,2), c as (select l.image_id, label, count(*) n, max(row_idx)-min(row_idx)+1 sr, max(col_idx)-min(col_idx)+1 sc from l join n using (image_id, id) group by 1,2),
 m as (select image_id, max(n) mx, sum(n) total, arg_min(label,{'a':-n,'b':label}) lone from c group by 1),
 k as (select c.*, mx, total, lone, c.n=mx or (c.n>=greatest(8,floor(mx*0.18)) and sr>=4 and sc>=4) keep from c join m using (image_id)),
 q as (select *, sum(n) filter (where keep) over (partition by image_id) kept from k)
select l.image_id, n.row_idx, n.col_idx from l join n using (image_id, id) join q using (image_id, label) where total<12 or case when kept<greatest(8,mx) then label=lone else keep end
""")
def lattice_components(spark, d):
    pts = fx.text_centers(spark, d)
    fits = ops.refine_lattice(pts, ops.initial_fit(pts, boards(spark, d), SIZE), SIZE)
    thinned = ops.assign_cells(pts, fits, SIZE).where("(row_idx * 7 + col_idx * 3) % 5 < 2").select("image_id", "row_idx", "col_idx")
    return ops.filter_lattice_components(thinned, ["image_id"])


@query("fit_scored_lattice")
def fit_scored_lattice(spark, d):
    return ops.fit_scored_lattice(sized_centers(spark, d), boards(spark, d), SIZE)
