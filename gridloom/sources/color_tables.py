"""Vendor colour maps and palette sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_MAP = "map<string,map<string,string>>"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as `value`, without a byte-order mark."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value"))


def read_color_systems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON map of hex to vendor codes as rows (hex, system, code, ord), and codes given twice."""
    colors = _text(spark, path).select(F.posexplode(F.map_entries(F.from_json("value", _MAP))).alias("ord", "_c"))
    rows = colors.select("ord", F.upper("_c.key").alias("hex"), F.explode("_c.value").alias("system", "code")).where(
        F.coalesce("code", F.lit("")) != ""
    )
    doubles = rows.groupBy("system", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows, doubles


def read_palette_sets(spark: SparkSession, path: str) -> DataFrame:
    """CSV of palette sets as rows (brand, palette_name, ord, color_key) in list order."""
    sets = spark.read.option("header", True).option("escape", '"').csv(path)
    codes = F.filter(F.split(F.trim("colorCodes"), r"\s+"), lambda c: c != "")
    return sets.select("brand", F.col("paletteName").alias("palette_name"), F.posexplode(codes).alias("ord", "color_key"))


def write_palette_sets(palette: DataFrame, path: str) -> None:
    """Inverse of `read_palette_sets`; a palette is a catalogue of a few hundred codes."""
    codes = F.transform(F.sort_array(F.collect_list(F.struct("ord", "color_key"))), lambda c: c["color_key"])
    palette.groupBy("brand", F.col("palette_name").alias("paletteName")).agg(
        F.count(F.lit(1)).alias("colorCount"), F.array_join(codes, " ").alias("colorCodes")
    ).withColumn("sourceUrl", F.lit("")).write.option("header", True).option("quoteAll", True).csv(path)


def write_color_systems(systems: DataFrame, path: str, per: list[str] | None = None) -> None:
    """Inverse of `read_color_systems`: one JSON map per value of the `per` columns, one per file line."""
    per = per or []
    per_hex = systems.groupBy(*per, "hex").agg(
        F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("system", "code"))).alias("codes")
    )
    whole = per_hex.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("ord", "hex", "codes"))).alias("_c"))
    entries = F.map_from_entries(F.transform("_c", lambda c: F.struct(c["hex"].alias("k"), F.map_from_entries(c["codes"]).alias("v"))))
    whole.select(*per, F.to_json(entries).alias("value")).write.partitionBy(*per).text(path)
