"""Inventory, project, legend-result and manifest documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import keys

# Current and former name of a project file, defaults for missing fields.
PROJECT_FILES = ["project_data.json", "project.json"]
DEFAULT_HEX = "#000000"
DEFAULT_BRAND, DEFAULT_PALETTE = "MARD", "96"

INVENTORY_SCHEMA = """
schemaVersion int,
warehouses array<struct<id:string,name:string,brand:string,paletteName:string,createdAt:string,updatedAt:string,
  items:array<struct<hex:string,colorKey:string,ownedCount:string,sourcePaletteName:string,isExtraColor:boolean,updatedAt:string>>>>,
transactions array<struct<id:string,seq:bigint,warehouseId:string,type:string,createdAt:string,note:string,
  items:array<struct<hex:string,colorKey:string,delta:bigint,before:bigint,after:bigint>>>>
"""


def _or(c: str | Column, default: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def read_inventory(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Warehouses, items, transactions and ledger entries of inventory documents.

    Missing values get defaults; counts that are no number or negative become 0. A file
    that cannot be read gives no rows.
    """
    docs = spark.read.schema(INVENTORY_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    houses = docs.select(F.posexplode("warehouses").alias("_pos", "_w"))
    created = F.col("_w.createdAt")
    warehouses = houses.select(
        F.col("_w.id").alias("warehouse_id"), _or("_w.name", "未命名豆仓").alias("name"), F.lit(DEFAULT_BRAND).alias("brand"),
        _or("_w.paletteName", DEFAULT_PALETTE).alias("palette_name"), created.try_cast("timestamp").alias("created_at"),
        F.coalesce(F.nullif(F.col("_w.updatedAt"), F.lit("")), created).try_cast("timestamp").alias("updated_at"),
    )
    owned = F.greatest(F.lit(0), F.when(F.isnan(_number("_i.ownedCount")), 0).otherwise(_number("_i.ownedCount")))
    items = houses.select(F.col("_w.id").alias("warehouse_id"), F.posexplode("_w.items").alias("item_idx", "_i")).select(
        "warehouse_id", "item_idx", keys.normalize_color_key(F.col("_i.colorKey")).alias("color_key"),
        F.upper(_or("_i.hex", DEFAULT_HEX)).alias("hex"), owned.cast("bigint").alias("owned"),
        F.coalesce("_i.isExtraColor", F.lit(False)).alias("is_extra"),
    )
    moves = docs.select(F.posexplode("transactions").alias("_pos", "_t"))
    transactions = moves.select(
        F.col("_t.id").alias("txn_id"), F.col("_t.warehouseId").alias("warehouse_id"), F.col("_t.type").alias("type"),
        # documents from elsewhere have no numbers; their order is that of the file
        F.coalesce("_t.seq", F.col("_pos").cast("bigint")).alias("seq"), F.col("_t.createdAt").try_cast("timestamp").alias("created_at"), F.col("_t.note").alias("note"),
    )
    entries = moves.select(F.col("_t.id").alias("txn_id"), F.explode("_t.items").alias("_e")).select(
        "txn_id", F.col("_e.colorKey").alias("color_key"), F.col("_e.hex").alias("hex"), "_e.delta", "_e.before", "_e.after"
    )
    return warehouses, items, transactions, entries


def _optional(df: DataFrame, name: str, moment: bool = False) -> Column:
    """A column that may be missing; moments with microseconds and zone, so that they read back equal."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if moment else F.col(name)


def write_inventory(warehouses: DataFrame, items: DataFrame, transactions: DataFrame, entries: DataFrame, path: str) -> None:
    """Inventory documents, one JSON line per warehouse and per block of 1000 transactions.

    Sequence numbers are written, so the order of the ledger survives; created_at, updated_at and note are optional.
    """
    stock = F.struct("hex", F.col("color_key").alias("colorKey"), F.col("owned").cast("string").alias("ownedCount"), F.col("is_extra").alias("isExtraColor"))
    nested = items.groupBy("warehouse_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("item_idx", stock.alias("i")))), lambda x: x["i"]).alias("items")
    )
    house = F.struct(F.col("warehouse_id").cast("string").alias("id"), "name", F.col("palette_name").alias("paletteName"),
                     _optional(warehouses, "created_at", True).alias("createdAt"), _optional(warehouses, "updated_at", True).alias("updatedAt"), "items")
    first = warehouses.join(nested, "warehouse_id", "left").select(F.array(house).alias("warehouses"))
    move = F.struct("hex", F.col("color_key").alias("colorKey"), "delta", "before", "after")
    rows = entries.groupBy("txn_id").agg(F.collect_list(move).alias("items"))
    txn = F.struct(F.col("txn_id").cast("string").alias("id"), "seq", F.col("warehouse_id").cast("string").alias("warehouseId"), "type",
                   _optional(transactions, "created_at", True).alias("createdAt"), _optional(transactions, "note").alias("note"), "items")
    second = transactions.join(rows, "txn_id", "left").groupBy(F.floor(F.col("seq") / 1000).alias("_b")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", txn.alias("t")))), lambda x: x["t"]).alias("transactions")
    ).drop("_b")
    first.withColumn("schemaVersion", F.lit(1)).write.json(f"{path}/warehouses")
    second.withColumn("schemaVersion", F.lit(1)).write.json(f"{path}/transactions")


PROJECT_SCHEMA = """
schemaVersion int, id string, name string, createdAt string, updatedAt string, warehouseId string, warehouseName string,
warehouseBrand string, warehousePaletteName string, status string,
patterns array<struct<id:string,name:string,fileName:string,path:string,thumbnailPath:string,totalBeadCount:double,colorCount:double,
  colorCounts:map<string,double>,expected:string,matchesExpected:boolean,sourcePageType:string,analysisStatus:string,status:string,
  addedToPlanAt:string,completedAt:string,inventoryDeductedAt:string>>
"""


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects, patterns and pattern colour counts from one JSON document per directory.

    `path` is a glob over both file names.
    """
    docs = spark.read.schema(PROJECT_SCHEMA).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("path"))
    return parse_projects(docs)


def parse_projects(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of project documents with their `path`.

    In a directory the current file name wins over the former one; the id defaults to the
    directory name.
    """
    parts = F.split("path", "/")
    named = docs.withColumns({"_file": F.element_at(parts, -1), "directory": F.element_at(parts, -2)}).where(F.col("_file").isin(PROJECT_FILES))
    # Two files per directory at most, so the window sees a bounded group.
    newest = Window.partitionBy("directory").orderBy(F.when(F.col("_file") == PROJECT_FILES[0], 0).otherwise(1))
    docs = named.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    pid = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("directory"))
    docs = docs.withColumn("project_id", pid)
    projects = docs.select(
        "project_id", "directory", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("directory")).alias("name"),
        F.coalesce("warehouseId", F.lit("")).alias("warehouse_id"), _or("warehouseName", "未绑定豆仓").alias("warehouse_name"),
        F.col("warehouseBrand").alias("brand"), F.col("warehousePaletteName").alias("paletteName"),
        F.col("createdAt").try_cast("timestamp").alias("created_at"),
        F.coalesce(F.nullif(F.col("updatedAt"), F.lit("")), F.col("createdAt")).try_cast("timestamp").alias("updated_at"),
        keys.normalize_status(F.col("status")).alias("status"),
    )
    rows = docs.select("project_id", F.posexplode("patterns").alias("pattern_idx", "_p"))
    name = F.coalesce(F.nullif(F.col("_p.name"), F.lit("")), F.nullif(F.col("_p.fileName"), F.lit("")), F.lit("未命名图纸"))
    patterns = rows.select(
        "project_id", "pattern_idx", F.col("_p.id").alias("pattern_id"), name.alias("name"),
        F.coalesce("_p.totalBeadCount", F.lit(0.0)).cast("bigint").alias("bead_total"), F.coalesce("_p.colorCount", F.lit(0.0)).cast("bigint").alias("n_colors"),
        F.col("_p.thumbnailPath").alias("thumbnail"), keys.normalize_status(F.col("_p.status")).alias("status"),
        F.col("_p.addedToPlanAt").try_cast("timestamp").alias("added_at"), F.col("_p.completedAt").try_cast("timestamp").alias("completed_at"),
        F.col("_p.inventoryDeductedAt").isNotNull().alias("is_deducted"),
    )
    counts = rows.select(F.col("_p.id").alias("pattern_id"), F.explode("_p.colorCounts").alias("color_key", "_n")).where("_n > 0")
    return projects, patterns, counts.select("pattern_id", "color_key", F.col("_n").cast("bigint").alias("count"))


_LEGEND = {
    "id": "string", "sourceImages": "array<string>", "sourcePageType": "string", "analysisStatus": "string", "totalColorKeys": "double",
    "totalBeads": "double", "expected": "string", "matchesExpected": "boolean", "colorCounts": "map<string,double>",
    "needsReviewCount": "bigint", "transparentCount": "bigint",
}
LEGEND_SCHEMA = ", ".join(f"{n} {t}" for n, t in _LEGEND.items())
BATCH_SCHEMA = f"images array<struct<{','.join(f'{n}:{t}' for n, t in _LEGEND.items())}>>"


def read_legend_results(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Batch results (`images` of a document) as patterns and their colour counts.

    Totals that are missing or 0 are taken from the counts; counts that are not positive
    are dropped; images without an id are skipped.
    """
    docs = spark.read.schema(BATCH_SCHEMA).option("multiLine", multi_line).json(path)
    images = docs.select(F.explode("images").alias("_i")).select("_i.*").withColumn("id", keys.trim_all(F.col("id"))).where("id <> ''")
    positive = F.map_filter(F.coalesce("colorCounts", F.create_map().cast("map<string,double>")), lambda k, v: F.coalesce(v, F.lit(0.0)) > 0)
    images = images.withColumn("_c", positive)
    total = F.aggregate(F.map_values("_c"), F.lit(0.0), lambda acc, v: acc + v)
    patterns = images.select(
        F.col("id").alias("pattern_id"), F.coalesce(F.nullif("totalBeads", F.lit(0.0)), total).cast("bigint").alias("bead_total"),
        F.coalesce(F.nullif("totalColorKeys", F.lit(0.0)), F.size("_c").cast("double")).cast("bigint").alias("n_colors"),
        "expected", F.col("matchesExpected").alias("matches_expected"), F.col("sourcePageType").alias("source_page_type"),
        F.col("analysisStatus").alias("analysis_status"), (F.size("sourceImages") > 1).alias("is_grouped"),
    )
    counts = images.select(F.col("id").alias("pattern_id"), F.explode("_c").alias("color_key", "_n"))
    return patterns, counts.select("pattern_id", "color_key", F.col("_n").cast("bigint").alias("count"))


def write_legend_results(final: DataFrame, path: str) -> None:
    """Final legends as one JSON line per group, with the field names of the batch documents."""
    final.select(
        F.col("group_id").cast("string").alias("id"), F.col("total_color_keys").alias("totalColorKeys"), F.col("total_beads").alias("totalBeads"),
        "expected", F.col("matches_expected").alias("matchesExpected"), F.col("color_counts").alias("colorCounts"),
        F.col("transparent_count").alias("transparentCount"),
    ).write.json(path)


def read_legend_lines(spark: SparkSession, path: str) -> DataFrame:
    """Legends written by `write_legend_results`, as (group_id, color_key, count) with the group's totals."""
    rows = spark.read.schema(LEGEND_SCHEMA).json(path)
    return rows.select(F.col("id").alias("group_id"), F.col("totalBeads").cast("bigint").alias("total_beads"), "expected", F.explode("colorCounts").alias("color_key", "_n")).select(
        "group_id", "total_beads", "expected", "color_key", F.col("_n").cast("bigint").alias("count")
    )


_ITEM = "struct<source:string,size:bigint,mtimeNs:bigint,pageType:string,pairKey:string>"
_GROUP = {"id": "string", "groupName": "string", "count": "bigint", "placement": "string", "items": f"array<{_ITEM}>"}
MANIFEST_SCHEMA = ", ".join(f"{n} {t}" for n, t in _GROUP.items())
NESTED_MANIFEST_SCHEMA = f"groups array<struct<{','.join(f'{n}:{t}' for n, t in _GROUP.items())}>>"


def write_manifest(manifest: DataFrame, items: DataFrame, path: str) -> None:
    """Groups and their items (group_idx, item_idx, …) as one JSON line per item block.

    Items are nested in blocks of 1000, so a very large group becomes several lines.
    """
    item = F.struct("source", "size", F.col("mtime_ns").alias("mtimeNs"), F.col("page_type").alias("pageType"), F.col("pair_key").alias("pairKey"))
    blocks = items.groupBy("group_idx", F.floor(F.col("item_idx") / 1000).alias("_b")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("item_idx", item.alias("i")))), lambda x: x["i"]).alias("items")
    )
    name = F.format_string("group_%03d", "group_idx")
    manifest.join(blocks, "group_idx").select(
        name.alias("id"), F.concat(F.lit("Image"), "group_idx").alias("groupName"), "count", "placement", "items"
    ).write.json(path)


def read_manifest(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Manifest items as rows; `nested` for a whole document with a `groups` array."""
    if nested:
        whole = spark.read.schema(NESTED_MANIFEST_SCHEMA).option("multiLine", True).json(path)
        docs = whole.select(F.explode("groups").alias("_g")).select("_g.*")
    else:
        docs = spark.read.schema(MANIFEST_SCHEMA).json(path)
    return docs.select(F.col("id").alias("group_id"), "groupName", "count", "placement", F.explode("items").alias("_i")).select(
        "group_id", F.col("groupName").alias("group_name"), "count", "placement", "_i.source", "_i.size", F.col("_i.mtimeNs").alias("mtime_ns"),
        F.col("_i.pageType").alias("page_type"), F.col("_i.pairKey").alias("pair_key"),
    )
