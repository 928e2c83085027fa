"""Scalar functions over whole driver tables."""

from pyspark.sql import functions as F

from gridloom.functions import colors, keys
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

# Raw colour codes as people type them, one per part.
FIXTURE_SQL["fx_raw_codes"] = """
select p_partkey id, case p_partkey%6 when 0 then concat('  a', p_partkey, ' ') when 1 then concat('B 00', p_partkey)
       when 2 then p_name when 3 then concat('zg', p_size, 'x') when 4 then concat('H', p_partkey%40) else p_brand end code
  from part
"""


def raw_codes(spark, d):
    p = F.col("p_partkey")
    code = (
        F.when(p % 6 == 0, F.concat(F.lit("  a"), p, F.lit(" "))).when(p % 6 == 1, F.concat(F.lit("B 00"), p))
        .when(p % 6 == 2, F.col("p_name")).when(p % 6 == 3, F.concat(F.lit("zg"), "p_size", F.lit("x")))
        .when(p % 6 == 4, F.concat(F.lit("H"), p % 40)).otherwise(F.col("p_brand"))
    )
    return fx.table(spark, d, "part").select(p.alias("id"), code.alias("code"))


@query("color_codes", """
select id, upper(trim(code)) color_key,
       upper(case when regexp_matches(code,'^([A-Za-z]+)\\s*0*(\\d+)') then regexp_extract(code,'^([A-Za-z]+)\\s*0*(\\d+)',1) else code end) prefix,
       case when regexp_matches(code,'^([A-Za-z]+)\\s*0*(\\d+)') then cast(regexp_extract(code,'^([A-Za-z]+)\\s*0*(\\d+)',2) as bigint) else 9007199254740991 end number
  from fx_raw_codes
""")
def color_codes(spark, d):
    c = F.col("code")
    return raw_codes(spark, d).select(
        "id", keys.normalize_color_key(c).alias("color_key"), keys.color_key_prefix(c).alias("prefix"),
        keys.color_key_number(c).alias("number"),
    )


@query("color_code_order", """
with parsed as (select color_key, regexp_extract(color_key,'^[A-Za-z]+',0) prefix, cast(regexp_extract(color_key,'(\\d+)',1) as bigint) number, count(*) n
                from fx_counted group by 1)
select color_key, n uses, row_number() over (order by prefix, number, color_key) - 1 sort_idx from parsed
""")
def color_code_order(spark, d):
    from pyspark.sql import Window

    uses = fx.counted(spark, d).groupBy("color_key").agg(F.count(F.lit(1)).alias("uses"))
    # A catalogue of a few hundred codes remains after the aggregation.
    w = Window.orderBy(*keys.color_key_order(F.col("color_key")))
    return uses.withColumn("sort_idx", (F.row_number().over(w) - 1).cast("bigint"))


@query("hex_round_trip", """
select swatch_id, hex, cast('0x'||substr(hex,2,2) as int) r, cast('0x'||substr(hex,4,2) as int) g, cast('0x'||substr(hex,6,2) as int) b, hex again
  from fx_swatch_hex
""")
def hex_round_trip(spark, d):
    parsed = fx.swatches(spark, d).select("swatch_id", "hex", colors.hex_to_rgb(F.lower("hex")).alias("c"))
    return parsed.select("swatch_id", "hex", "c.*", colors.rgb_to_hex(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("again"))


@query("oklab_values", """
select swatch_id, round(ok_l,6) l, round(ok_a,6) a, round(ok_b,6) b,
       round(sqrt(ok_a*ok_a+ok_b*ok_b+(ok_l-1)*(ok_l-1))*100,4) white_distance,
       round(least(0.99,greatest(0.05,1-round(sqrt(ok_a*ok_a+ok_b*ok_b+(ok_l-1)*(ok_l-1))*100,4)/34)),6) confidence,
       r>=246 and g>=246 and b>=246 near_white
  from fx_swatch_ok
""")
def oklab_values(spark, d):
    rgb = [F.col(c) for c in "rgb"]
    white = F.struct(F.lit(1.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    dist = F.round(colors.oklab_distance(F.col("ok"), white), 4)
    return fx.swatches(spark, d).withColumn("ok", colors.rgb_to_oklab(*rgb)).select(
        "swatch_id", *[F.round(f"ok.{n}", 6).alias(n) for n in "lab"], dist.alias("white_distance"),
        F.round(colors.distance_to_confidence(dist), 6).alias("confidence"),
        colors.is_near_white(*rgb).alias("near_white"),
    )


FIXTURE_SQL["fx_swatch_lab8"] = """
select *, cast(floor((case when yy>0.008856e0 then 116e0*cbrt(yy)-16e0 else 903.3e0*yy end)*255e0/100e0+1e-9+0.5) as int) lab_l,
       cast(floor((fx-fy)*500e0+128e0+1e-9+0.5) as int) lab_a, cast(floor((fy-fz)*200e0+128e0+1e-9+0.5) as int) lab_b
from (select *, case when xx>0.008856e0 then cbrt(xx) else 7.787e0*xx+16e0/116e0 end fx,
                case when yy>0.008856e0 then cbrt(yy) else 7.787e0*yy+16e0/116e0 end fy,
                case when zz>0.008856e0 then cbrt(zz) else 7.787e0*zz+16e0/116e0 end fz
      from (select *, (0.412453e0*lr+0.357580e0*lg+0.180423e0*lb)/0.950456e0 xx, 0.212671e0*lr+0.715160e0*lg+0.072169e0*lb yy,
                      (0.019334e0*lr+0.119193e0*lg+0.950227e0*lb)/1.088754e0 zz from fx_swatch_ok))
"""


@query("lab8_values", "select swatch_id, lab_l l, lab_a a, lab_b b from fx_swatch_lab8")
def lab8_values(spark, d):
    return fx.swatches(spark, d).select("swatch_id", colors.rgb_to_lab8(*[F.col(c) for c in "rgb"]).alias("lab")).select(
        "swatch_id", "lab.*"
    )


FIXTURE_SQL["fx_swatch_hsl"] = """
select swatch_id, hex, (case when mx=mn then 0e0 when mx=r1 then ((g1-b1)/(mx-mn)+case when g1<b1 then 6 else 0 end)/6
            when mx=g1 then ((b1-r1)/(mx-mn)+2)/6 else ((r1-g1)/(mx-mn)+4)/6 end)*360 h,
       (case when mx=mn then 0e0 when (mx+mn)/2>0.5 then (mx-mn)/(2e0-mx-mn) else (mx-mn)/(mx+mn) end)*100 s, (mx+mn)/2*100 l,
       0.2126e0*r+0.7152e0*g+0.0722e0*b luma
  from (select *, greatest(r1,g1,b1) mx, least(r1,g1,b1) mn from (select *, r/255e0 r1, g/255e0 g1, b/255e0 b1 from fx_swatch_hex))
"""


@query("hsl_values", """
select swatch_id, round(h,6) h, round(s,6) s, round(l,6) l, round(luma,6) luma, case when luma/255>0.5 then '#000000' else '#FFFFFF' end text_color
  from fx_swatch_hsl
""")
def hsl_values(spark, d):
    return fx.swatches(spark, d).withColumn("hsl", colors.hex_to_hsl(F.col("hex"))).select(
        "swatch_id", *[F.round(f"hsl.{n}", 6).alias(n) for n in "hsl"],
        F.round(colors.luma(F.col("r"), F.col("g"), F.col("b")), 6).alias("luma"),
        colors.contrast_color(F.col("hex")).alias("text_color"),
    )


@query("fallback_hexes", """
select id, printf('#%06X', list_reduce(list_transform(string_split(code,''), lambda c: cast(unicode(c) as bigint)),
                          lambda acc, c: (acc*31+c)%4294967296, cast(0 as bigint))%16777216) hex
  from fx_raw_codes
""")
def fallback_hexes(spark, d):
    return raw_codes(spark, d).select("id", keys.fallback_hex(F.col("code")).alias("hex"))


@query("natural_keys", """
select page_id, array_to_string(list_transform(string_split(regexp_replace(lower(url),'(\\d+)',chr(1)||'\\1'||chr(1),'g'),chr(1)),
       lambda x: case when regexp_matches(x,'^\\d+$') then printf('%06d',length(regexp_replace(x,'^0+(\\d)','\\1')))||regexp_replace(x,'^0+(\\d)','\\1') else x end),'|') natural_key
  from pages
""")
def natural_keys(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.array_join(keys.natural_key(F.col("url")), "|").alias("natural_key"))


@query("title_pair_keys", """
with t as (select p_partkey id, concat(p_size, case p_partkey%3 when 0 then ' 色号 ' when 1 then '色呈' else '色' end, p_name, ' ', p_partkey+100, case when p_partkey%5=0 then '颗' else ' 豆' end) title,
                  [p_size, cast(p_partkey as int), cast(p_partkey%700 as int)] numbers from part),
     k as (select *, regexp_replace(title,'\\s+','','g') compact from t),
     m as (select *, case when regexp_matches(compact,'(\\d+)色(?:号|呈)?.*?(\\d+)豆')
                     then concat(cast(regexp_extract(compact,'(\\d+)色(?:号|呈)?.*?(\\d+)豆',1) as bigint),'_',cast(regexp_extract(compact,'(\\d+)色(?:号|呈)?.*?(\\d+)豆',2) as bigint)) end pair_key,
              list_filter(numbers, lambda v: v>=1 and v<=400) cs, list_max(list_filter(numbers, lambda v: v>=100 and v<=20000)) bead from k)
select id, pair_key, cast(split_part(pair_key,'_',2) as bigint) total,
       case when bead is not null and len(cs)>0 then bead end bead_count,
       case when bead is not null then coalesce(list_filter(cs, lambda v: v<>bead)[-1], cs[-1]) end color_count
  from m
""")
def title_pair_keys(spark, d):
    p = F.col("p_partkey")
    mark = F.when(p % 3 == 0, " 色号 ").when(p % 3 == 1, "色呈").otherwise("色")
    title = F.concat("p_size", mark, "p_name", F.lit(" "), p + 100, F.when(p % 5 == 0, "颗").otherwise(" 豆"))
    numbers = F.array("p_size", p.cast("int"), (p % 700).cast("int"))
    return fx.table(spark, d, "part").select(
        p.alias("id"), keys.parse_pair_key(title).alias("pair_key"), keys.choose_pair_numbers(numbers).alias("n")
    ).select("id", "pair_key", keys.total_from_pair_key(F.col("pair_key")).alias("total"), "n.bead_count", "n.color_count")


@query("legend_texts", """
select doc_id, case when regexp_matches(clean,'[A-Z]{1,3}\\d{1,2}') then regexp_extract(clean,'[A-Z]{1,3}\\d{1,2}') else md5(clean) end key_text,
       length(digits) n_digits, digits[1:12] head_digits, special
  from (select doc_id, upper(regexp_replace(text,'[^A-Za-z0-9]','','g')) clean, regexp_replace(text,'[^0-9]','','g') digits,
               case when contains(text,'空') then 'transparent' when contains(text,'全') then 'full' else '' end special from documents)
""")
def legend_texts(spark, d):
    text = F.col("text")
    key = keys.normalize_key_text(text)
    digits = keys.digits_only(text)
    return fx.table(spark, d, "documents").select(
        "doc_id", F.when(key.rlike(r"^[A-Z]{1,3}\d{1,2}$"), key).otherwise(F.md5(key)).alias("key_text"),
        F.length(digits).cast("bigint").alias("n_digits"), F.substring(digits, 1, 12).alias("head_digits"),
        keys.special_circle_key(text).alias("special"),
    )


FIXTURE_SQL["fx_parsed_lines"] = """
select *, case when regexp_matches(flat,'^([A-Za-z]+)\\s*0*(\\d+)\\s+(\\d+)\\b') then upper(regexp_extract(flat,'^([A-Za-z]+)\\s*0*(\\d+)\\s+(\\d+)\\b',1))||cast(regexp_extract(flat,'^([A-Za-z]+)\\s*0*(\\d+)\\s+(\\d+)\\b',2) as bigint) end color_key,
       case when regexp_matches(flat,'^([A-Za-z]+)\\s*0*(\\d+)\\s+(\\d+)\\b') then cast(regexp_extract(flat,'^([A-Za-z]+)\\s*0*(\\d+)\\s+(\\d+)\\b',3) as bigint) end cnt
  from (select *, regexp_replace(regexp_replace(trim(line),'[颗粒个]','','g'),'[，,：:＋+–—-]',' ','g') flat from fx_replenish)
"""


@query("replenish_lines", 'select line_no, color_key, cnt "count" from fx_parsed_lines')
def replenish_lines(spark, d):
    parsed = fx.replenish(spark, d).select("line_no", keys.parse_replenish_line(F.col("line")).alias("e"))
    return parsed.select("line_no", "e.color_key", "e.count")


@query("status_values", """
select o_orderkey id, case when s in ('in_progress','completed') then s else 'draft' end status,
       case when s='in_progress' then '进行中' when s='completed' then '已完成' else '草稿' end status_label
  from (select o_orderkey, case o_orderstatus when 'P' then 'pending' when 'O' then 'in_progress' else 'completed' end s from orders)
""")
def status_values(spark, d):
    raw = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("completed")
    status = keys.normalize_status(raw)
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), keys.status_label(status).alias("status_label"))


@query("color_families", """
select letters, numbers, cast(count(*) as bigint) n from
 (select case when regexp_extract(k,'^[A-Z]+')<>'' then regexp_extract(k,'^[A-Z]+') else '其他' end letters,
         case when not regexp_matches(c,'^\\d+$') then '其他' when cast(c as bigint)<=20 then '1-20' when cast(c as bigint)<=50 then '21-50'
              when cast(c as bigint)<=100 then '51-100' when cast(c as bigint)<=200 then '101-200' else '200+' end numbers
    from (select case when l_linenumber=1 then '7x' else chr(cast(65+l_partkey%8 as int))||l_suppkey end k, case when l_linenumber=2 then 'x' else cast(l_partkey%291 as varchar) end c from lineitem)) group by 1,2
""")
def color_families(spark, d):
    k = F.when(F.col("l_linenumber") == 1, "7x").otherwise(F.concat(F.char(65 + F.col("l_partkey") % 8), F.col("l_suppkey")))
    c = F.when(F.col("l_linenumber") == 2, "x").otherwise((F.col("l_partkey") % 291).cast("string"))
    return fx.table(spark, d, "lineitem").groupBy(
        keys.color_family(k).alias("letters"), keys.color_family(c, numeric=True).alias("numbers")
    ).agg(F.count(F.lit(1)).alias("n"))
