"""Palette lookups: nearest colours, vendor codes, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import colors
from gridloom.operators.sizing import lookup_side

# What an empty palette answers.
NO_COLOR_KEY, NO_COLOR_HEX = "ERR", "#000000"
RGB = ["r", "g", "b"]


def palette_entries(palette: DataFrame, on: list[str], space=colors.rgb_to_oklab) -> DataFrame:
    """One row per palette with its colours as an array in palette order.

    A palette is a vendor's catalogue of a few hundred colours, so the array stays small.
    """
    entry = F.struct("ord", "color_key", "hex", space(F.col("r"), F.col("g"), F.col("b")).alias("at"))
    return palette.groupBy(*on).agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def _scored(metric) -> Column:
    """Entries as (distance, ord, key, hex), ready for a minimum or a sort."""
    return F.transform(
        F.col("entries"),
        lambda e: F.struct(
            colors.round_distance(metric(F.col("_at"), e["at"])).alias("distance"),
            e["ord"].alias("ord"), e["color_key"].alias("color_key"), e["hex"].alias("hex"),
        ),
    )


def _match_distinct(df: DataFrame, palette: DataFrame, on: list[str], pick, space, metric) -> DataFrame:
    """Score each distinct colour once, then join the answer back.

    There are at most 2^24 colours whatever the number of rows. The colours are made
    distinct with partial aggregation and the join back is on the colour itself, where
    AQE splits a dominating colour. The colour's coordinates are computed below the join,
    so that they are not evaluated again for every palette entry.
    """
    entries = lookup_side(palette_entries(palette, on, space), probe=palette)
    distinct = df.select(*on, *RGB).where(F.col("r").isNotNull()).distinct()
    placed = distinct.withColumn("_at", space(F.col("r"), F.col("g"), F.col("b")))
    scored = placed.join(entries, on, "left").select(*on, *RGB, pick(_scored(metric)).alias("_match"))
    return df.join(scored, [*on, *RGB], "left")


def nearest_palette_color(
    df: DataFrame, palette: DataFrame, on: list[str], space=colors.rgb_to_oklab, metric=colors.oklab_distance
) -> DataFrame:
    """Adds match_key, match_hex, match_ord, match_distance; ties go to palette order."""
    matched = _match_distinct(df, palette, on, F.array_min, space, metric)
    known = F.col("r").isNotNull()
    m = F.col("_match")
    return matched.select(
        *df.columns,
        F.coalesce(m["color_key"], F.when(known, NO_COLOR_KEY)).alias("match_key"),
        F.coalesce(m["hex"], F.when(known, NO_COLOR_HEX)).alias("match_hex"),
        m["ord"].alias("match_ord"),
        m["distance"].alias("match_distance"),
    )


def match_palette_lab(df: DataFrame, palette: DataFrame, on: list[str]) -> DataFrame:
    """Nearest colour in 8-bit CIE Lab."""
    return nearest_palette_color(df, palette, on, colors.rgb_to_lab8, colors.lab8_distance)


def nearest_k_colors(df: DataFrame, palette: DataFrame, on: list[str], k: int = 5) -> DataFrame:
    """Adds `nearest`: the k closest colours as (distance, ord, color_key, hex), closest first."""
    pick = lambda scored: F.slice(F.array_sort(scored), 1, k)
    return _match_distinct(df, palette, on, pick, colors.rgb_to_oklab, colors.oklab_distance).withColumnRenamed(
        "_match", "nearest"
    )


def active_palette(palette: DataFrame, selected: DataFrame, excluded: DataFrame) -> DataFrame:
    """Palette colours that are selected and not excluded, by hex."""
    return palette.join(selected, "hex", "left_semi").join(excluded, "hex", "left_anti")


def display_color_key(df: DataFrame, systems: DataFrame, hex_col: str = "hex", system_col: str = "system") -> DataFrame:
    """Adds `display_key`: the code of a hex value in a vendor system.

    The erase sentinel, empty text and '?' pass through; unknown colours give '?'.
    """
    codes = lookup_side(systems.select(F.col("hex").alias("_hex"), F.col("system").alias("_system"), "code"))
    value = F.col(hex_col)
    joined = df.join(codes, (F.upper(value) == F.col("_hex")) & (F.col(system_col) == F.col("_system")), "left")
    passes = value.isin("ERASE", "", "?")
    code = F.when(passes, value).otherwise(F.coalesce(F.nullif(F.col("code"), F.lit("")), F.lit("?")))
    return joined.select(*df.columns, code.alias("display_key"))


def color_key_to_hex(df: DataFrame, systems: DataFrame, key_col: str, system_col: str = "system") -> DataFrame:
    """Adds `resolved_hex`: hex of a code (the first listed one); hex text and unknown codes pass through."""
    first = systems.groupBy(F.col("system").alias("_system"), F.col("code").alias("_code")).agg(
        F.min_by("hex", "ord").alias("_hex")
    )
    key = F.col(key_col)
    joined = df.join(lookup_side(first), (key == F.col("_code")) & (F.col(system_col) == F.col("_system")), "left")
    is_hex = key.startswith("#") & (F.length(key) == 7)
    return joined.select(
        *df.columns, F.when(is_hex, F.upper(key)).otherwise(F.coalesce("_hex", key)).alias("resolved_hex")
    )


def valid_in_system(df: DataFrame, systems: DataFrame, hex_col: str = "hex", system_col: str = "system") -> DataFrame:
    """Adds `is_valid`: whether the hex value, as written, has a code in the system."""
    codes = lookup_side(
        systems.select(F.col("hex").alias("_hex"), F.col("system").alias("_system"), F.lit(True).alias("_ok"))
    )
    joined = df.join(codes, (F.col(hex_col) == F.col("_hex")) & (F.col(system_col) == F.col("_system")), "left")
    return joined.select(*df.columns, F.coalesce("_ok", F.lit(False)).alias("is_valid"))


def convert_palette(palette: DataFrame, systems: DataFrame, system: str) -> DataFrame:
    """Palette relabelled with another vendor's codes; unmapped colours keep their own."""
    codes = lookup_side(systems.where(F.col("system") == system).select("hex", F.nullif("code", F.lit("")).alias("_code")))
    return palette.join(codes, "hex", "left").select(
        *[F.coalesce("_code", "color_key").alias("color_key") if c == "color_key" else c for c in palette.columns]
    )


def palette_colors(sets: DataFrame, key_to_hex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes of each palette set with their hex, in list order; codes without a hex come second."""
    joined = sets.join(lookup_side(key_to_hex.select("color_key", "hex")), "color_key", "left")
    missing = joined.where(F.col("hex").isNull()).select("brand", "palette_name", "color_key", F.lit("missing_hex").alias("reason"))
    return joined.where(F.col("hex").isNotNull()), missing
