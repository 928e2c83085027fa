"""The library's input tables, derived from the driver tables by plain Spark expressions.

Each fixture exists twice: as a DataFrame function and, under the same name, as the
SQL that the checks use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import colors, keys
from gridloom.operators.sizing import lookup_side, rank_in_blocks
from gridloom.plans.registry import FIXTURE_SQL

PALETTE_SIZE = 291


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- palettes ---------------------------------------------------------------

# Every part moves the colour of its class: the channels come from sums over all parts of the class.
FIXTURE_SQL["fx_palette"] = """
select cast(ord as int) ord, concat(chr(cast(65 + ord % 8 as int)), cast(ord // 8 + 1 as varchar)) color_key,
       cast(r as int) r, cast(g as int) g, cast(b as int) b, printf('#%02X%02X%02X', r, g, b) hex
  from (select p_partkey%291 ord, cast(sum(p_partkey*37 + p_size*11)%256 as bigint) r, cast(sum(p_partkey*91 + p_size*29 + 17)%256 as bigint) g,
               cast(sum(p_partkey*53 + p_partkey*p_size*31 + 101)%256 as bigint) b from part group by 1)
"""
FIXTURE_SQL["fx_palette_sets"] = """
select s.name palette_name, p.* from fx_palette p
  join (values ('96',96),('144',144),('291',291)) s(name, size) on p.ord < s.size
"""
def oklab_sql(source: str) -> str:
    """SQL adding ok_l, ok_a, ok_b to a relation with r, g, b."""
    linear = ", ".join(
        f"case when {c}/255.0e0<=0.04045e0 then {c}/255.0e0/12.92e0 else pow(({c}/255.0e0+0.055e0)/1.055e0,2.4e0) end l{c}"
        for c in "rgb"
    )
    return f"""
select *, 0.2104542553e0*l_+0.7936177850e0*m_-0.0040720468e0*s_ ok_l,
          1.9779984951e0*l_-2.4285922050e0*m_+0.4505937099e0*s_ ok_a,
          0.0259040371e0*l_+0.7827717662e0*m_-0.8086757660e0*s_ ok_b
from (select *, cbrt(0.4122214708e0*lr+0.5363325363e0*lg+0.0514459929e0*lb) l_,
                cbrt(0.2119034982e0*lr+0.6806995451e0*lg+0.1073969566e0*lb) m_,
                cbrt(0.0883024619e0*lr+0.2817188376e0*lg+0.6299787005e0*lb) s_
      from (select *, {linear} from {source}))
"""


def distance_sql(a: str, b: str) -> str:
    """Rounded Oklab distance of two relations made by `oklab_sql`."""
    parts = "+".join(f"({a}.ok_{n}-{b}.ok_{n})*({a}.ok_{n}-{b}.ok_{n})" for n in "lab")
    return f"round(sqrt({parts})*100,6)"


FIXTURE_SQL["fx_palette_ok"] = oklab_sql("fx_palette")
FIXTURE_SQL["fx_sets_ok"] = oklab_sql("fx_palette_sets")

# Every part is a colour swatch, to be matched against the palettes.
FIXTURE_SQL["fx_swatches"] = """
select p_partkey swatch_id, case p_size%3 when 0 then '96' when 1 then '144' else '291' end palette_name,
       cast((p_partkey*37)%256 as int) r, cast((p_partkey*91+17)%256 as int) g, cast((p_partkey*53+p_size*31+101)%256 as int) b
  from part
"""
FIXTURE_SQL["fx_swatch_hex"] = "select *, printf('#%02X%02X%02X', r, g, b) hex from fx_swatches"
FIXTURE_SQL["fx_swatch_ok"] = oklab_sql("fx_swatch_hex")
FIXTURE_SQL["fx_systems"] = """
select ord, hex, s.name system, case s.name when 'letters' then color_key else cast(ord+1 as varchar) end code
  from fx_palette, (values ('letters'),('numbers')) s(name) where s.name='letters' or ord%10<>0
"""


def swatches(spark: SparkSession, d: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size")
    rgb = {"r": (p * 37) % 256, "g": (p * 91 + 17) % 256, "b": (p * 53 + size * 31 + 101) % 256}
    return table(spark, d, "part").select(
        p.alias("swatch_id"),
        F.when(size % 3 == 0, "96").when(size % 3 == 1, "144").otherwise("291").alias("palette_name"),
        *[c.cast("int").alias(n) for n, c in rgb.items()], colors.rgb_to_hex(*rgb.values()).alias("hex"),
    )


def systems(spark: SparkSession, d: str) -> DataFrame:
    """Vendor codes per hex; the numeric vendor lacks every tenth colour."""
    coded = F.when(F.col("system") == "letters", F.col("color_key")).otherwise((F.col("ord") + 1).cast("string"))
    return (
        palette(spark, d).withColumn("system", F.explode(F.array(F.lit("letters"), F.lit("numbers"))))
        .where((F.col("system") == "letters") | (F.col("ord") % 10 != 0))
        .select("ord", "hex", "system", coded.alias("code"))
    )


def palette(spark: SparkSession, d: str) -> DataFrame:
    """Every part belongs to one of 291 colours and moves its channels, which are sums over all parts of the colour."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    parts = {"r": p * 37 + size * 11, "g": p * 91 + size * 29 + 17, "b": p * 53 + p * size * 31 + 101}
    mixed = table(spark, d, "part").groupBy((p % PALETTE_SIZE).alias("ord")).agg(*[(F.sum(c) % 256).alias(n) for n, c in parts.items()])
    return mixed.select(
        F.col("ord").cast("int").alias("ord"), F.concat(F.char(65 + F.col("ord") % 8), (F.floor(F.col("ord") / 8) + 1).cast("string")).alias("color_key"),
        *[F.col(n).cast("int").alias(n) for n in "rgb"], colors.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"),
    )


def palette_sets(spark: SparkSession, d: str) -> DataFrame:
    """Palette membership: the first 96 and 144 colours form their own sets."""
    names = (
        F.when(F.col("ord") < 96, F.array(F.lit("96"), F.lit("144"), F.lit("291")))
        .when(F.col("ord") < 144, F.array(F.lit("144"), F.lit("291")))
        .otherwise(F.array(F.lit("291")))
    )
    return palette(spark, d).select(F.explode(names).alias("palette_name"), "*")


# --- rasters and grids ------------------------------------------------------

FIXTURE_SQL["fx_rows"] = """
select label, cast(row_number() over (partition by label order by vec_id)-1 as int) y, embedding from embeddings
"""
FIXTURE_SQL["fx_pixels"] = """
select label image_id, x, y, max(case when ch=0 then v end) r, max(case when ch=1 then v end) g,
       max(case when ch=2 then v end) b, max(case when (x*7+y*3+tail)%11=0 then 0 else 255 end) a
from (select label, cast(floor(pos/3) as int) x, y, pos%3 ch, least(3,greatest(0,cast(floor((cast(embedding[64] as double)+0.5)*4) as int))) tail,
             least(255,greatest(0,cast(floor((cast(embedding[pos+1] as double)+0.5)*4) as int)*64)) v
      from (select label, y, unnest(range(64)) pos, embedding from fx_rows) where pos<63) group by 1,2,3
"""
FIXTURE_SQL["fx_levels"] = """
select label pattern_id, y row_idx, cast(pos as int) col_idx,
       least(11,greatest(0,cast(floor((cast(embedding[pos+1] as double)+0.5)*12) as int))) lvl
from (select label, y, unnest(range(64)) pos, embedding from fx_rows)
"""
FIXTURE_SQL["fx_cells"] = """
select l.pattern_id, l.row_idx, l.col_idx, (l.row_idx+l.col_idx)%17=0 is_external,
       case when (l.row_idx+l.col_idx)%17=0 then 'ERASE' else p.color_key end color_key,
       case when (l.row_idx+l.col_idx)%17=0 then '#FFFFFF' else p.hex end hex
from fx_levels l join fx_palette p on p.ord=11*l.lvl
"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    ranked = rank_in_blocks(table(spark, d, "embeddings"), ["label"], "vec_id", "y")
    return ranked.withColumn("y", F.col("y").cast("int"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    # the value left over after 21 pixels of three channels moves the transparent ones
    tail = F.least(F.lit(3), F.greatest(F.lit(0), F.floor((F.element_at("embedding", 64).cast("double") + 0.5) * 4).cast("int")))

    def level(offset: int):
        v = F.element_at("embedding", F.col("x") * 3 + (offset + 1)).cast("double")
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.5) * 4).cast("int") * 64))

    return (
        _rows(spark, d)
        .select(F.col("label").alias("image_id"), "y", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
        .select(
            "image_id", "x", "y", *[level(i).alias(n) for i, n in enumerate("rgb")],
            F.when((F.col("x") * 7 + F.col("y") * 3 + tail) % 11 == 0, 0).otherwise(255).alias("a"),
        )
    )


def levels(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(
        F.col("label").alias("pattern_id"), F.col("y").alias("row_idx"), F.posexplode("embedding").alias("col_idx", "v")
    ).select(
        "pattern_id", "row_idx", "col_idx",
        F.least(F.lit(11), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.5) * 12).cast("int"))).alias("lvl"),
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    pal = lookup_side(palette(spark, d).where("ord % 11 = 0 and ord <= 121").select("ord", "color_key", "hex"))
    outside = (F.col("row_idx") + F.col("col_idx")) % 17 == 0
    return (
        levels(spark, d).withColumn("ord", F.col("lvl") * 11).join(pal, "ord")
        .select(
            "pattern_id", "row_idx", "col_idx", outside.alias("is_external"),
            F.when(outside, keys.ERASE_KEY).otherwise(F.col("color_key")).alias("color_key"),
            F.when(outside, keys.ERASE_HEX).otherwise(F.col("hex")).alias("hex"),
        )
    )


# --- stock ------------------------------------------------------------------

FIXTURE_SQL["fx_ledger"] = """
select event_id seq, user_id%10 warehouse_id, cast(event_id%96 as int) ord, ts created_at,
       case when event_type in ('purchase','signup') then cast(floor(value) as bigint)
            when event_type='error' then 0 else -cast(floor(value/10) as bigint) end delta
  from events
"""
FIXTURE_SQL["fx_stock"] = """
select warehouse_id, ord, cast(greatest(0,sum(delta)) as bigint) owned from fx_ledger group by 1,2
"""
FIXTURE_SQL["fx_items"] = """
select s.warehouse_id, s.ord item_idx, p.color_key, p.hex, s.owned, s.ord>=90 is_extra
  from fx_stock s join fx_palette p on p.ord=s.ord
"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    gain = F.col("event_type").isin("purchase", "signup")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("warehouse_id"),
        (F.col("event_id") % 96).cast("int").alias("ord"), F.col("ts").alias("created_at"),
        F.when(gain, F.floor("value")).when(F.col("event_type") == "error", F.lit(0))
        .otherwise(-F.floor(F.col("value") / 10)).cast("bigint").alias("delta"),
    )


def stock(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).groupBy("warehouse_id", "ord").agg(F.greatest(F.lit(0), F.sum("delta")).alias("owned"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Warehouse items by colour code; the last six colours of each warehouse are extras."""
    pal = lookup_side(palette(spark, d).select("ord", "color_key", "hex"))
    return stock(spark, d).join(pal, "ord").select(
        "warehouse_id", F.col("ord").alias("item_idx"), "color_key", "hex", "owned", (F.col("ord") >= 90).alias("is_extra")
    )


FIXTURE_SQL["fx_replenish"] = """
select p_size%10 warehouse_id, p_partkey line_no,
       case when p_partkey%13=0 then 'bad line' when p_partkey%17=0 then concat(p.color_key,' 0')
            when p_partkey%19=0 then 'ZZ99 5'
            else concat(' ',lower(p.color_key),
                        case p_partkey%4 when 0 then '-' when 1 then ' ' when 2 then ',' else '：' end,
                        cast(p_size as varchar)) end line
  from part join fx_palette p on p.ord=p_partkey%96
"""


def replenish(spark: SparkSession, d: str) -> DataFrame:
    pal = lookup_side(palette(spark, d).select("ord", "color_key"))
    p = F.col("p_partkey")
    sep = F.when(p % 4 == 0, "-").when(p % 4 == 1, " ").when(p % 4 == 2, ",").otherwise("：")
    line = (
        F.when(p % 13 == 0, "bad line").when(p % 17 == 0, F.concat("color_key", F.lit(" 0"))).when(p % 19 == 0, "ZZ99 5")
        .otherwise(F.concat(F.lit(" "), F.lower("color_key"), sep, F.col("p_size").cast("string")))
    )
    return (
        table(spark, d, "part").withColumn("ord", (p % 96).cast("int")).join(pal, "ord")
        .select((F.col("p_size") % 10).alias("warehouse_id"), p.alias("line_no"), line.alias("line"))
    )


# --- projects ---------------------------------------------------------------

FIXTURE_SQL["fx_patterns"] = """
select o_orderkey pattern_id, o_custkey project_id, o_custkey%10 warehouse_id,
       case o_orderstatus when 'P' then 'draft' when 'O' then 'in_progress' else 'completed' end status,
       o_orderdate added_at, o_orderkey%5=0 and o_orderstatus not in ('P','O') is_deducted
  from orders
"""
FIXTURE_SQL["fx_pattern_colors"] = """
select l_orderkey pattern_id, cast(l_partkey%291 as int) ord, cast(sum(l_quantity) as bigint) cnt from lineitem group by 1,2
"""
FIXTURE_SQL["fx_counted"] = """
select c.pattern_id, p.color_key, p.hex, c.cnt from fx_pattern_colors c join fx_palette p on p.ord=c.ord
"""


def patterns(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "draft").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("completed")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pattern_id"), F.col("o_custkey").alias("project_id"),
        (F.col("o_custkey") % 10).alias("warehouse_id"), status.alias("status"), F.col("o_orderdate").alias("added_at"),
        ((F.col("o_orderkey") % 5 == 0) & ~F.col("o_orderstatus").isin("P", "O")).alias("is_deducted"),
    )


def pattern_colors(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("pattern_id"), (F.col("l_partkey") % 291).cast("int").alias("ord"))
        .agg(F.sum("l_quantity").cast("bigint").alias("cnt"))
    )


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Colour counts per pattern with code and hex."""
    pal = lookup_side(palette(spark, d).select("ord", "color_key", "hex"))
    return pattern_colors(spark, d).join(pal, "ord").select("pattern_id", "color_key", "hex", "cnt")


# --- legend evidence --------------------------------------------------------

FIXTURE_SQL["fx_observations"] = """
select l_orderkey group_id, l_linenumber page_idx, cast(l_partkey%40 as int) ord, cast(l_quantity as int) src1,
       case when l_suppkey%5=0 then cast(l_quantity as int)+10 else cast(l_quantity as int) end src2,
       case when l_suppkey%3=0 then null when l_suppkey%7=0 then cast(l_quantity as int)+10 else cast(l_quantity as int) end src3,
       cast(round(l_discount*100) as int) distance
  from lineitem
"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    q, s = F.col("l_quantity").cast("int"), F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("page_idx"),
        (F.col("l_partkey") % 40).cast("int").alias("ord"), q.alias("src1"),
        F.when(s % 5 == 0, q + 10).otherwise(q).alias("src2"),
        F.when(s % 3 == 0, F.lit(None)).when(s % 7 == 0, q + 10).otherwise(q).alias("src3"),
        F.round(F.col("l_discount") * 100).cast("int").alias("distance"),
    )


FIXTURE_SQL["fx_text_centers"] = """
select p_size%5 image_id, p_partkey idx,
       cast(13.5 as double) + (p_partkey%52)*cast(20 as double) + ((p_partkey*17)%7-3)*cast(0.25 as double) x,
       cast(9.25 as double) + (cast(floor(p_partkey/52) as int)%52)*cast(20 as double) + ((p_partkey*29)%5-2)*cast(0.25 as double) y,
       p_retailprice score
  from part
"""


def text_centers(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        (F.col("p_size") % 5).alias("image_id"), p.alias("idx"),
        (F.lit(13.5) + (p % 52) * F.lit(20.0) + ((p * 17) % 7 - 3) * F.lit(0.25)).alias("x"),
        (F.lit(9.25) + (F.floor(p / 52) % 52) * F.lit(20.0) + ((p * 29) % 5 - 2) * F.lit(0.25)).alias("y"),
        F.col("p_retailprice").alias("score"),
    )


# --- image fingerprints -----------------------------------------------------

FIXTURE_SQL["fx_features"] = """
select vec_id image_id, vec_id order_idx,
       case vec_id%3 when 0 then 'detail_page' when 1 then 'summary_view' else 'color_modal' end page_type,
       case when vec_id%7=0 then null else concat(cast(label+1 as varchar),'_',cast(100+10*label as varchar)) end pair_key,
       vec_id%3<>2 has_image,
       list_sum(list_transform(range(64), lambda i: case when embedding[i+1]>0 then (cast(1 as hugeint)<<cast(i as int)) else 0 end)) ph,
       list_sum(list_transform(range(63), lambda i: case when embedding[i+2]>embedding[i+1] then (cast(1 as hugeint)<<cast(i as int)) else 0 end)) dh,
       list_transform(embedding[1:24], lambda v: abs(cast(v as double))/list_sum(list_transform(embedding[1:24], lambda u: abs(cast(u as double))))) hist,
       list_transform(embedding, lambda v: cast(v as double)) thumb
  from embeddings
"""


def features(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")

    def bits(flags):
        return F.aggregate(
            flags, F.lit(0).cast("bigint"),
            lambda acc, f: acc.bitwiseOR(F.when(f["on"], F.call_function("shiftleft", F.lit(1).cast("bigint"), f["i"])).otherwise(F.lit(0))),
        )

    flag = lambda on, i: F.struct(on.alias("on"), i.cast("int").alias("i"))
    above = F.transform(v, lambda e, i: flag(e > 0, i))
    rising = F.transform(F.slice(v, 1, 63), lambda e, i: flag(F.element_at(v, i.cast("int") + 2) > e, i))
    head = F.transform(F.slice(v, 1, 24), lambda e: F.abs(e.cast("double")))
    total = F.aggregate(head, F.lit(0.0), lambda acc, e: acc + e)
    page = F.when(F.col("vec_id") % 3 == 0, "detail_page").when(F.col("vec_id") % 3 == 1, "summary_view").otherwise("color_modal")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("vec_id").alias("order_idx"), page.alias("page_type"),
        F.when(F.col("vec_id") % 7 != 0, F.concat_ws("_", F.col("label") + 1, 100 + 10 * F.col("label"))).alias("pair_key"),
        (F.col("vec_id") % 3 != 2).alias("has_image"),
        bits(above).alias("phash"), bits(rising).alias("dhash"),
        F.transform(head, lambda e: e / total).alias("color_hist"),
        F.transform(v, lambda e: e.cast("double")).alias("thumb"),
    )
