"""Fingerprints of the pixel fixture and grouping of the embedding fixture."""

from pyspark.sql import functions as F

from gridloom.operators import grouping as ops
from gridloom.operators.raster import image_sizes
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

FIXTURE_SQL["fx_crop"] = """
select p.image_id, p.x-l x, p.y-t y, r, g, b, ri-l width, bo-t height, (r*4899+g*9617+b*1868+8192)//16384 v from fx_pixels p join (
  select image_id, l, t, least(w, greatest(round_even(w*(1.0e0-0.02e0),0),l+1))::int ri, least(h, greatest(round_even(h*(1.0e0-0.38e0),0),t+1))::int bo from (
    select image_id, w, h, least(w-2,greatest(round_even(w*0.02e0,0),0))::int l, least(h-2,greatest(round_even(h*0.08e0,0),0))::int t from (select image_id, max(x)+1 w, max(y)+1 h from fx_pixels group by 1))) s
  on s.image_id=p.image_id and x>=l and x<ri and y>=t and y<bo
"""


def _blocks_sql(cols: int, rows: int) -> str:
    return f"""
select image_id, j::int row_idx, i::int col_idx, round_even(sum(v*ox*oy)/sum(ox*oy)::double,0)::int "value" from (
  select image_id, v, i, j, least((i+1)*width,(x+1)*{cols})-greatest(i*width,x*{cols}) ox, least((j+1)*height,(y+1)*{rows})-greatest(j*height,y*{rows}) oy from (
    select *, unnest(range(y*{rows}//height, ((y+1)*{rows}+height-1)//height)) j from (select *, unnest(range(x*{cols}//width, ((x+1)*{cols}+width-1)//width)) i from fx_crop))) group by 1,2,3
"""


FIXTURE_SQL["fx_blocks9"] = _blocks_sql(9, 8)
FIXTURE_SQL["fx_blocks32"] = _blocks_sql(32, 32)


def crop(spark, d):
    px = fx.pixels(spark, d)
    return ops.crop_main(px, image_sizes(px))


@query("crop_main", "select image_id, width, height, count(*) n, sum(x*7+y*11+r)::bigint checksum from fx_crop group by 1,2,3")
def crop_main(spark, d):
    return crop(spark, d).groupBy("image_id", "width", "height").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 7 + F.col("y") * 11 + F.col("r")).alias("checksum")
    )


@query("downsample_area", "select * from fx_blocks32")
def downsample_area(spark, d):
    return ops.downsample_area(crop(spark, d), 32, 32)


FIXTURE_SQL["fx_dhash"] = """
select a.image_id, printf('%016x', sum(case when b."value">a."value" then cast(1 as hugeint)<<(a.row_idx*8+a.col_idx) else 0 end)) dhash
  from fx_blocks9 a join fx_blocks9 b on a.image_id=b.image_id and a.row_idx=b.row_idx and b.col_idx=a.col_idx+1 group by 1
"""
FIXTURE_SQL["fx_phash"] = """
with f as (select unnest(range(8)) f), k as (select unnest(range(32)) i), cs as (select f, i, sqrt((case when f=0 then 1 else 2 end)/32e0)*cos(pi()*(2*i+1)*f/64e0) c from f, k),
 lo as (select image_id, a.f u, b.f v, round(sum("value"*a.c*b.c),6) z from fx_blocks32 p join cs a on a.i=p.row_idx join cs b on b.i=p.col_idx group by 1,2,3),
 m as (select image_id, median(z) md from lo where u>0 and v>0 group by 1)
select lo.image_id, printf('%016x', sum(case when z>md then cast(1 as hugeint)<<cast(u*8+v as int) else 0 end)) phash from lo join m using (image_id) group by 1
"""


def hexed(name):
    return F.lower(F.lpad(F.hex(name), 16, "0")).alias(name)


@query("dhash", "select * from fx_dhash")
def dhash(spark, d):
    return ops.dhash(crop(spark, d)).select("image_id", hexed("dhash"))


@query("phash", "select * from fx_phash")
def phash(spark, d):
    return ops.phash(crop(spark, d)).select("image_id", hexed("phash"))


@query("color_histogram", """
with c as (select image_id, unnest([0,1,2]) ch, unnest([r,g,b]) v from fx_crop), n as (select image_id, count(*) n from fx_crop group by 1), bins as (select image_id, n, ch, b from n, (select unnest(range(3)) ch), (select unnest(range(8)) b))
select bins.image_id, cast(bins.ch*8+bins.b as int) bin, round(count(c.v)/any_value(n)::double,6) share from bins left join c on c.image_id=bins.image_id and c.ch=bins.ch and c.v//32=bins.b group by 1,2
""")
def color_histogram(spark, d):
    return ops.color_histogram(crop(spark, d)).select("image_id", F.posexplode("color_hist").alias("bin", "share")).withColumn("share", F.round("share", 6))


@query("thumb", 'select image_id, cast(row_idx*32+col_idx as int) cell, round("value"/255e0,6) share from fx_blocks32')
def thumb(spark, d):
    return ops.thumb(crop(spark, d)).select("image_id", F.posexplode("thumb").alias("cell", "share")).withColumn("share", F.round("share", 6))


@query("image_fingerprints", """
with c as (select image_id, count(*) filter (where r//32=0)/count(*)::double dark_red from fx_crop group by 1), t as (select image_id, sum("value")/255e0 thumb_total, count(*) thumb_size from fx_blocks32 group by 1)
select image_id, phash, dhash, round(dark_red,6) dark_red, round(thumb_total,6) thumb_total, thumb_size::int thumb_size from fx_phash join fx_dhash using (image_id) join c using (image_id) join t using (image_id)
""")
def image_fingerprints(spark, d):
    px = fx.pixels(spark, d)
    found = ops.image_fingerprints(px, image_sizes(px))
    total = F.aggregate("thumb", F.lit(0.0), lambda acc, v: acc + v)
    return found.select(
        "image_id", hexed("phash"), hexed("dhash"), F.round(F.get("color_hist", F.lit(0)), 6).alias("dark_red"),
        F.round(total, 6).alias("thumb_total"), F.size("thumb").alias("thumb_size"),
    )


# --- candidates, distances, rules -------------------------------------------

@query("local_pairs", "select a.order_idx order_a, b.order_idx order_b from fx_features a join fx_features b on b.order_idx>a.order_idx and b.order_idx<=a.order_idx+5")
def local_pairs(spark, d):
    return ops.local_pairs(fx.features(spark, d)).select("order_a", "order_b")


_SIMILAR = """
with h as (select distinct ph, case when ph>=9223372036854775808 then (ph-18446744073709551616)::bigint else ph::bigint end s from fx_features)
select a.s phash_a, b.s phash_b, bit_count(xor(a.s,b.s))::int distance from h a join h b on a.s<b.s and bit_count(xor(a.s,b.s))<={limit}
"""


@query("similar_hashes", _SIMILAR.format(limit=10))
def similar_hashes(spark, d):
    return ops.similar_hashes(fx.features(spark, d))


@query("similar_hashes_wide", _SIMILAR.format(limit=15))
def similar_hashes_wide(spark, d):
    return ops.similar_hashes(fx.features(spark, d), limit=15)


FIXTURE_SQL["fx_local_distances"] = """
select a.order_idx order_a, b.order_idx order_b, a.pair_key is not distinct from b.pair_key same_key, bit_count(xor(a.ph::uhugeint,b.ph::uhugeint)::bit)::int p, bit_count(xor(a.dh::uhugeint,b.dh::uhugeint)::bit)::int q,
  list_avg(list_transform(range(24), lambda i: abs(a.hist[i+1]-b.hist[i+1]))) h, list_avg(list_transform(range(64), lambda i: abs(a.thumb[i+1]-b.thumb[i+1]))) m, a.thumb ta, b.thumb tb, list_avg(a.thumb) ma, list_avg(b.thumb) mb
  from fx_features a join fx_features b on b.order_idx>a.order_idx and b.order_idx<=a.order_idx+5
"""
FIXTURE_SQL["fx_local_measures"] = """
select order_a, order_b, same_key, p, q, h, m, list_sum(list_transform(range(64), lambda i: (ta[i+1]-ma)*(tb[i+1]-mb)))/(sqrt(list_sum(list_transform(range(64), lambda i: (ta[i+1]-ma)*(ta[i+1]-ma))))*sqrt(list_sum(list_transform(range(64), lambda i: (tb[i+1]-mb)*(tb[i+1]-mb))))) c from fx_local_distances
"""


def _measured(spark, d):
    f = fx.features(spark, d)
    side = lambda n: f.select(F.col("order_idx").alias(f"order_{n}"), F.struct("phash", "dhash", "color_hist", "thumb", "pair_key").alias(n))
    pairs = ops.local_pairs(f).join(side("a"), "order_a").join(side("b"), "order_b")
    return ops.fingerprint_distance(pairs)


@query("fingerprint_distance", "select order_a, order_b, p phash_distance, q dhash_distance, round(h,6) hist_distance, round(m,6) thumb_mae, round(c,6) thumb_corr from fx_local_measures")
def fingerprint_distance(spark, d):
    return _measured(spark, d).select(
        "order_a", "order_b", "phash_distance", "dhash_distance",
        *[F.round(c, 6).alias(c) for c in ("hist_distance", "thumb_mae", "thumb_corr")],
    )


@query("match_rules", """
select same_key, p<=28 and q<=28 and h<=0.05 same_pattern, p=0 and q=0 and h<=0.000001 is_exact, c>=0.94 and m<=0.08 and h<=0.08 same_pair_visual, count(*) n from fx_local_measures group by 1,2,3,4
""")
def match_rules(spark, d):
    return _measured(spark, d).groupBy(
        F.col("a.pair_key").eqNullSafe(F.col("b.pair_key")).alias("same_key"), ops.is_same_pattern(28).alias("same_pattern"),
        ops.is_exact().alias("is_exact"), ops.is_same_pair_visual().alias("same_pair_visual"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("match_components", """
with recursive h as (select order_idx, pair_key, has_image, ph from fx_features),
 e as (select a.order_idx u, b.order_idx v from h a join h b on a.order_idx<>b.order_idx and (a.pair_key=b.pair_key or (a.has_image and b.has_image and bit_count(xor(a.ph::uhugeint,b.ph::uhugeint)::bit)<=10))),
 r(id, label) as (select order_idx, order_idx from h union select e.v, r.label from r join e on e.u=r.id where e.v>r.label)
select id order_idx, min(label) component from r group by 1
""")
def match_components(spark, d):
    return ops.match_components(fx.features(spark, d)).select("order_idx", "component")


@query("group_images")
def group_images(spark, d):
    keep, _ = ops.split_skipped(fx.features(spark, d))
    return ops.group_images(keep)[0]


@query("group_reviews")
def group_reviews(spark, d):
    keep, _ = ops.split_skipped(fx.features(spark, d))
    return ops.group_images(keep)[1]


@query("skipped_images", """
select image_id, page_type, pair_key, 'missing_pair_key' reason, true needs_review from fx_features where page_type in ('summary_view','color_modal') and pair_key is null
""")
def skipped_images(spark, d):
    return ops.split_skipped(fx.features(spark, d))[1]


# Groups for the manifest: events of one user are one group, led by the first.
@query("group_manifest", """
with g as (select min(event_id) leader, count(*) n from events group by user_id)
select row_number() over (order by leader) group_idx, leader, n as "count", n>1 folder_created, case when n>1 then 'group_folder' else 'root_file' end placement from g
""")
def group_manifest(spark, d):
    events = fx.table(spark, d, "events")
    heads = events.groupBy("user_id").agg(F.min("event_id").alias("leader"))
    return ops.group_manifest(events.join(heads, "user_id").select("event_id", "leader"))


@query("changed_files", """
select page_id, url source, length(html)::bigint size, page_id*7 mtime_ns from pages where not (page_id%5<>0 and page_id%7<>0 and page_id%11<>0)
""")
def changed_files(spark, d):
    p = F.col("page_id")
    files = fx.table(spark, d, "pages").select(p, F.col("url").alias("source"), F.length("html").cast("bigint").alias("size"), (p * 7).alias("mtime_ns"))
    cache = files.select(
        F.upper("source").alias("source"), "size", F.when(p % 5 == 0, 0).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
        F.when(p % 7 == 0, 4).otherwise(5).alias("version"), F.when(p % 11 == 0, "odd").otherwise("detail_page").alias("page_type"),
    )
    return ops.changed_files(files, cache)
