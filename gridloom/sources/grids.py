"""Colour grids as CSV and JSON documents, and the CSV reports made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import keys
from gridloom.functions.colors import STRICT_HEX_PATTERN

# Fixed value: an external cell in a grid CSV.
TRANSPARENT = "TRANSPARENT"


def grid_lines(cells: DataFrame) -> DataFrame:
    """Grid rows as CSV lines (pattern_id, row_idx, line)."""
    value = F.when(F.col("is_external"), TRANSPARENT).otherwise(F.col("hex"))
    ordered = F.sort_array(F.collect_list(F.struct("col_idx", value.alias("v"))))
    return cells.groupBy("pattern_id", "row_idx").agg(F.array_join(F.transform(ordered, lambda c: c["v"]), ",").alias("line"))


def write_grid_csv(cells: DataFrame, path: str) -> None:
    """One folder per pattern with its lines in row order; rows are sorted within their file."""
    lines = grid_lines(cells)
    lines.repartition("pattern_id").sortWithinPartitions("pattern_id", "row_idx").select("pattern_id", "line").write.partitionBy(
        "pattern_id"
    ).text(path)


def read_grid_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Grid CSVs (one file per pattern) as cells, and the files rejected with their first mistake.

    TRANSPARENT and empty values are external cells. A ragged row or a value that is no
    colour rejects its file. Files carry their path; a pattern_id=… folder gives the id.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "*")
    extra = [c for c in files.columns if c not in ("source", "value")]
    rows = files.select("source", *extra, F.posexplode(F.split(keys.trim_all(F.col("value")), "\n")).alias("row_idx", "_line"))
    parts = rows.withColumn("_v", F.split("_line", ","))
    width = parts.where("row_idx = 0").select("source", F.size("_v").alias("_n"))
    checked = parts.join(width, "source")
    ragged = checked.where(F.size("_v") != F.col("_n")).select(
        "source", (F.col("row_idx") + 1).alias("row"), F.lit(0).alias("column"), F.lit("ragged_row").alias("reason"), F.size("_v").cast("string").alias("value")
    )
    cells = checked.select("source", *extra, "row_idx", F.posexplode("_v").alias("col_idx", "_raw")).withColumn("_raw", keys.trim_all(F.col("_raw")))
    outside = F.col("_raw").isin(TRANSPARENT, "")
    wrong = cells.where(~outside & ~F.col("_raw").rlike(STRICT_HEX_PATTERN)).select(
        "source", (F.col("row_idx") + 1).alias("row"), (F.col("col_idx") + 1).alias("column"), F.lit("bad_color").alias("reason"), F.col("_raw").alias("value")
    )
    at = F.struct("row", "column")
    errors = ragged.unionByName(wrong).groupBy("source").agg(F.min_by(F.struct("row", "column", "reason", "value"), at).alias("_e")).select("source", "_e.*")
    good = cells.join(errors, "source", "left_anti").select(
        "source", *extra, "row_idx", "col_idx", F.when(outside, TRANSPARENT).otherwise(F.upper("_raw")).alias("color_key"),
        F.when(outside, keys.ERASE_HEX).otherwise(F.upper("_raw")).alias("hex"), outside.alias("is_external"),
    )
    return good, errors


PATTERN_SCHEMA = """
id string, name string, brand string, selectedColorSystem string, paletteName string, totalBeadCount bigint,
gridDimensions struct<N:int,M:int>,
mappedPixelData array<array<struct<key:string,color:string,isExternal:boolean>>>,
colorCounts map<string,struct<count:double,color:string,colorKey:string,key:string,isExtraColor:boolean,recommendedColor:string,recommendedColorKey:string>>
"""


def write_pattern_json(cells: DataFrame, counts: DataFrame, heads: DataFrame, path: str) -> None:
    """Patterns as nested documents, one JSON line each.

    Cells are gathered per grid row, rows per grid; a grid has at most a few hundred of each.
    """
    pixel = F.struct(F.col("color_key").alias("key"), F.col("hex").alias("color"), F.col("is_external").alias("isExternal"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("col_idx", pixel.alias("p")))), lambda c: c["p"])
    rows = cells.groupBy("pattern_id", "row_idx").agg(line.alias("_r"))
    grids = rows.groupBy("pattern_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "_r"))), lambda r: r["_r"]).alias("mappedPixelData")
    )
    entry = F.struct("count", F.col("hex").alias("color"), F.col("color_key").alias("colorKey"))
    totals = counts.groupBy("pattern_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("hex", entry.alias("e"))))).alias("colorCounts"), F.sum("count").alias("totalBeadCount")
    )
    docs = grids.join(totals, "pattern_id", "left").join(heads, "pattern_id", "left")
    size = F.struct(F.size(F.get("mappedPixelData", F.lit(0))).alias("N"), F.size("mappedPixelData").alias("M"))
    docs.select(
        F.col("pattern_id").cast("string").alias("id"), *[c for c in heads.columns if c != "pattern_id"],
        size.alias("gridDimensions"), "mappedPixelData", "colorCounts", "totalBeadCount",
    ).write.json(path)


def read_patterns(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Pattern documents; `multi_line` for one pretty-printed document per file."""
    return spark.read.schema(PATTERN_SCHEMA).option("multiLine", multi_line).json(path).withColumn("source", F.col("_metadata.file_path"))


def pattern_counts(patterns: DataFrame) -> DataFrame:
    """Positive colour counts of pattern documents; the entry's own hex and code come first."""
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    brand = F.coalesce(blank(F.col("brand")), blank(F.col("selectedColorSystem")), F.lit("MARD"))
    rows = patterns.select(F.col("id").alias("pattern_id"), brand.alias("brand"), F.coalesce("paletteName", F.lit("")).alias("palette_name"), F.explode("colorCounts").alias("_hex", "_e"))
    return rows.where(F.col("_e.count") > 0).select(
        "pattern_id", "brand", "palette_name", F.upper(F.coalesce(blank(F.col("_e.color")), F.col("_hex"))).alias("hex"),
        F.coalesce(blank(F.col("_e.colorKey")), blank(F.col("_e.key")), F.lit("")).alias("color_key"), F.col("_e.count").cast("bigint").alias("count"),
    )


def pattern_cells(patterns: DataFrame) -> DataFrame:
    """Cells of pattern documents."""
    rows = patterns.select(F.col("id").alias("pattern_id"), F.posexplode("mappedPixelData").alias("row_idx", "_r"))
    return rows.select("pattern_id", "row_idx", F.posexplode("_r").alias("col_idx", "_c")).select(
        "pattern_id", "row_idx", "col_idx", F.col("_c.key").alias("color_key"), F.col("_c.color").alias("hex"),
        F.coalesce("_c.isExternal", F.lit(False)).alias("is_external"),
    )


def pattern_stats(counts: DataFrame) -> DataFrame:
    """Report rows of `export_pattern_stats`."""
    return counts.where("count > 0").select("pattern_id", "hex", "brand", F.col("palette_name").alias("paletteName"), "color_key", "count")


def export_pattern_stats(counts: DataFrame, path: str) -> None:
    """Colour counts as CSV with a pattern column; many patterns share a file, colours in code order."""
    rows = pattern_stats(counts)
    rows.repartitionByRange("pattern_id", "color_key").sortWithinPartitions("pattern_id", *keys.color_key_order(F.col("color_key"))).write.option(
        "header", True
    ).csv(path)


def requirement_rows(required: DataFrame, projects: DataFrame) -> DataFrame:
    """The eight report columns of a project's demand."""
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return required.join(projects.select("project_id", "brand", "paletteName"), "project_id").select(
        "project_id", "hex", blank("brand", "MARD"), F.coalesce("paletteName", F.lit("")).alias("paletteName"), "color_key", "needed", "owned", "missing",
        F.col("remaining").alias("remaining_after_project"),
    )


def export_requirements(required: DataFrame, projects: DataFrame, path: str) -> None:
    """Demand as CSV with a project column; many projects share a file, colours in code order."""
    requirement_rows(required, projects).repartitionByRange("project_id", "color_key").sortWithinPartitions(
        "project_id", *keys.color_key_order(F.col("color_key"))
    ).write.option("header", True).csv(path)
