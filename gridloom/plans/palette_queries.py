"""Palette lookups over swatches, grids and line items."""

from pyspark.sql import functions as F

from gridloom.operators import palette as ops
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import FIXTURE_SQL, query

FIXTURE_SQL["fx_swatch_ranked"] = f"""
select s.swatch_id, p.color_key, p.hex, p.ord, {fx.distance_sql('s', 'p')} distance,
       row_number() over (partition by s.swatch_id order by {fx.distance_sql('s', 'p')}, p.ord) rn
  from fx_swatch_ok s join fx_sets_ok p on p.palette_name=s.palette_name
"""


@query("nearest_palette_color", "select swatch_id, color_key match_key, hex match_hex, ord match_ord, distance match_distance from fx_swatch_ranked where rn=1")
def nearest_palette_color(spark, d):
    found = ops.nearest_palette_color(fx.swatches(spark, d), fx.palette_sets(spark, d), ["palette_name"])
    return found.select("swatch_id", "match_key", "match_hex", "match_ord", "match_distance")


@query("nearest_k_colors", "select swatch_id, rn-1 place, color_key, distance from fx_swatch_ranked where rn<=5")
def nearest_k_colors(spark, d):
    found = ops.nearest_k_colors(fx.swatches(spark, d), fx.palette_sets(spark, d), ["palette_name"], 5)
    return found.select("swatch_id", F.posexplode("nearest").alias("place", "n")).select(
        "swatch_id", F.col("place").cast("bigint").alias("place"), "n.color_key", "n.distance"
    )


FIXTURE_SQL["fx_palette_lab8"] = """
with lin as (select * from fx_palette_ok)
select *, cast(floor((case when yy>0.008856e0 then 116e0*cbrt(yy)-16e0 else 903.3e0*yy end)*255e0/100e0+1e-9+0.5) as int) lab_l,
       cast(floor((fx-fy)*500e0+128e0+1e-9+0.5) as int) lab_a, cast(floor((fy-fz)*200e0+128e0+1e-9+0.5) as int) lab_b
from (select *, case when xx>0.008856e0 then cbrt(xx) else 7.787e0*xx+16e0/116e0 end fx,
                case when yy>0.008856e0 then cbrt(yy) else 7.787e0*yy+16e0/116e0 end fy,
                case when zz>0.008856e0 then cbrt(zz) else 7.787e0*zz+16e0/116e0 end fz
      from (select *, (0.412453e0*lr+0.357580e0*lg+0.180423e0*lb)/0.950456e0 xx, 0.212671e0*lr+0.715160e0*lg+0.072169e0*lb yy,
                      (0.019334e0*lr+0.119193e0*lg+0.950227e0*lb)/1.088754e0 zz from lin))
"""


@query("match_palette_lab", """
select swatch_id, color_key match_key, round(sqrt(d2),6) match_distance from (
  select s.swatch_id, p.color_key, (s.lab_l-p.lab_l)*(s.lab_l-p.lab_l)+(s.lab_a-p.lab_a)*(s.lab_a-p.lab_a)+(s.lab_b-p.lab_b)*(s.lab_b-p.lab_b) d2,
         row_number() over (partition by s.swatch_id order by (s.lab_l-p.lab_l)*(s.lab_l-p.lab_l)+(s.lab_a-p.lab_a)*(s.lab_a-p.lab_a)+(s.lab_b-p.lab_b)*(s.lab_b-p.lab_b), p.ord) rn
    from fx_swatch_lab8 s join fx_palette_lab8 p on p.ord<case s.palette_name when '96' then 96 when '144' then 144 else 291 end) where rn=1
""")
def match_palette_lab(spark, d):
    found = ops.match_palette_lab(fx.swatches(spark, d), fx.palette_sets(spark, d), ["palette_name"])
    return found.select("swatch_id", "match_key", "match_distance")


@query("active_palette", """
select p.* from fx_palette p where hex in (select hex from fx_swatch_hex where palette_name<>'144' union select p2.hex from lineitem join fx_palette p2 on p2.ord=l_partkey where l_quantity>45)
   and hex not in (select hex from fx_swatch_hex where palette_name='96')
""")
def active_palette(spark, d):
    sw = fx.swatches(spark, d)
    bought = fx.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("int").alias("ord"))
    selected = sw.where("palette_name <> '144'").select("hex").unionByName(
        fx.palette(spark, d).join(bought, "ord", "left_semi").select("hex")
    )
    return ops.active_palette(fx.palette(spark, d), selected, sw.where("palette_name = '96'").select("hex")).select(
        "ord", "color_key", "r", "g", "b", "hex"
    )


FIXTURE_SQL["fx_lookups"] = """
select l_orderkey, l_linenumber, l_partkey, case when l_linenumber%2=0 then 'letters' else 'numbers' end system,
       case when l_suppkey%17=0 then 'ERASE' else coalesce(lower(p.hex),'#ABCDEF') end value,
       case when l_suppkey%13=0 then coalesce(lower(p.hex),'#abcdef') else cast(l_partkey%300 as varchar) end code
  from lineitem left join fx_palette p on p.ord=l_partkey%300
"""


def _lookups(spark, d):
    pal = fx.palette(spark, d).select(F.col("ord").cast("bigint").alias("ord"), "hex")
    s = F.col("l_suppkey")
    return (
        fx.table(spark, d, "lineitem").withColumn("ord", F.col("l_partkey") % 300).join(ops.lookup_side(pal), "ord", "left")
        .select(
            "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "letters").otherwise("numbers").alias("system"),
            F.when(s % 17 == 0, "ERASE").otherwise(F.coalesce(F.lower("hex"), F.lit("#ABCDEF"))).alias("value"),
            F.when(s % 13 == 0, F.coalesce(F.lower("hex"), F.lit("#abcdef"))).otherwise(F.col("ord").cast("string")).alias("code"),
        )
    )


@query("display_color_keys", """
select l.system, l.value, case when l.value='ERASE' then 'ERASE' else coalesce(s.code,'?') end display_key, s2.hex is not null is_valid, cast(count(*) as bigint) n
  from fx_lookups l left join fx_systems s on s.hex=upper(l.value) and s.system=l.system
  left join fx_systems s2 on s2.hex=l.value and s2.system=l.system group by 1,2,3,4
""")
def display_color_keys(spark, d):
    sys_ = fx.systems(spark, d)
    counted = _lookups(spark, d).groupBy("system", "value").agg(F.count(F.lit(1)).alias("n"))
    return ops.valid_in_system(ops.display_color_key(counted, sys_, "value"), sys_, "value")


@query("color_key_hexes", """
select l.system, l.code, case when l.code like '#______' then upper(l.code) else coalesce(f.hex,l.code) end resolved_hex, cast(count(*) as bigint) n
  from fx_lookups l left join (select system, code, arg_min(hex,ord) hex from fx_systems group by 1,2) f on f.code=l.code and f.system=l.system group by 1,2,3
""")
def color_key_hexes(spark, d):
    counted = _lookups(spark, d).groupBy("system", "code").agg(F.count(F.lit(1)).alias("n"))
    return ops.color_key_to_hex(counted, fx.systems(spark, d), "code")


@query("converted_palette_uses", """
select coalesce(s.code, p.color_key) color_key, cast(sum(c.cnt) as bigint) uses from fx_pattern_colors c join fx_palette p on p.ord=c.ord
  left join fx_systems s on s.hex=p.hex and s.system='numbers' group by 1
""")
def converted_palette_uses(spark, d):
    pal = ops.convert_palette(fx.palette(spark, d), fx.systems(spark, d), "numbers").select("ord", "color_key")
    return fx.pattern_colors(spark, d).join(ops.lookup_side(pal), "ord").groupBy("color_key").agg(F.sum("cnt").alias("uses"))


@query("palette_set_colors", """
select palette_name, 'p'||palette_name brand, color_key, hex, ord, cast(coalesce(u.uses,0) as bigint) uses from fx_palette_sets p
  left join (select ord o, sum(cnt) uses from fx_pattern_colors group by 1) u on u.o=p.ord where ord%50<>49
""")
def palette_set_colors(spark, d):
    sets = fx.palette_sets(spark, d).select(F.concat(F.lit("p"), "palette_name").alias("brand"), "palette_name", "ord", "color_key")
    known, _missing = ops.palette_colors(sets, fx.palette(spark, d).where("ord % 50 <> 49"))
    uses = fx.pattern_colors(spark, d).groupBy("ord").agg(F.sum("cnt").alias("uses"))
    return known.join(uses, "ord", "left").select(
        "palette_name", "brand", "color_key", "hex", "ord", F.coalesce("uses", F.lit(0)).alias("uses")
    )
