"""Round trips through the file formats: tables derived from the driver tables are written and read back."""

from pyarrow import fs
from pyspark.sql import functions as F

from gridloom.lineage import scratch_path
from gridloom.operators import cells as cell_ops
from gridloom.operators import legend as legend_ops
from gridloom.plans import fixtures as fx
from gridloom.plans import grouping_queries as gq
from gridloom.plans import ledger_queries as lq
from gridloom.plans import legend_queries as leg
from gridloom.plans import project_queries as pq
from gridloom.plans.registry import FIXTURE_SQL, query
from gridloom.sources import color_tables, documents, grids, images

# Colour maps of a thousand swatches each; every hex once, with up to two vendor codes.
FIXTURE_SQL["fx_vendor_codes"] = """
with h as (select hex, min(swatch_id) ord from fx_swatch_hex group by 1)
select hex, ord, 'a' system, 'A'||(ord%700) code from h union all select hex, ord, 'b', cast(ord as varchar) from h where ord%10<>0
"""


def vendor_codes(spark, d):
    h = fx.swatches(spark, d).groupBy("hex").agg(F.min("swatch_id").alias("ord"))
    system = F.explode(F.when(F.col("ord") % 10 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    code = F.when(F.col("system") == "a", F.concat(F.lit("A"), F.col("ord") % 700)).otherwise(F.col("ord").cast("string"))
    return h.withColumn("system", system).withColumn("code", code)


def _color_systems(spark, d):
    path = scratch_path(spark, "color-systems")
    color_tables.write_color_systems(vendor_codes(spark, d).withColumn("block", F.floor(F.col("ord") / 1000)), path, ["block"])
    return color_tables.read_color_systems(spark, path)


@query("read_color_systems", "select hex, system, code from fx_vendor_codes")
def read_color_systems(spark, d):
    return _color_systems(spark, d)[0].select("hex", "system", "code")


@query("duplicate_vendor_codes", "select system, code, count(*) n from fx_vendor_codes group by 1,2 having count(*)>1")
def duplicate_vendor_codes(spark, d):
    return _color_systems(spark, d)[1]


@query("read_palette_sets", """
select 'b'||swatch_id//500 brand, palette_name, cast(row_number() over (partition by swatch_id//500, palette_name order by swatch_id)-1 as int) ord, 'C'||swatch_id color_key from fx_swatches
""")
def read_palette_sets(spark, d):
    s = fx.swatches(spark, d)
    sets = s.select(
        F.concat(F.lit("b"), F.floor(F.col("swatch_id") / 500)).alias("brand"), "palette_name", F.col("swatch_id").alias("ord"),
        F.concat(F.lit("C"), "swatch_id").alias("color_key"),
    )
    path = scratch_path(spark, "palette-sets")
    color_tables.write_palette_sets(sets, path)
    return color_tables.read_palette_sets(spark, path)


# Sheets of 64 rows cut from the grid fixture.
FIXTURE_SQL["fx_sheets64"] = """
select pattern_id*1000+row_idx//64 pattern_id, cast(row_idx%64 as int) row_idx, col_idx, color_key, hex, is_external from fx_cells
"""


def sheets64(spark, d):
    row = F.col("row_idx")
    return fx.cells(spark, d).withColumns(
        {"pattern_id": (F.col("pattern_id") * 1000 + F.floor(row / 64)).cast("int"), "row_idx": (row % 64).cast("int")}
    )


@query("grid_csv_round_trip", """
select pattern_id, row_idx, col_idx, case when is_external then 'TRANSPARENT' else hex end color_key, case when is_external then '#FFFFFF' else hex end hex, is_external from fx_sheets64
""")
def grid_csv_round_trip(spark, d):
    path = scratch_path(spark, "grid-csv")
    grids.write_grid_csv(sheets64(spark, d), path)
    cells, _errors = grids.read_grid_csv(spark, path)
    return cells.drop("source")


@query("grid_csv_errors", """
with b as (select *, case when pattern_id%3=1 and row_idx=4 and col_idx=6 then 'red' when is_external then 'TRANSPARENT' else hex end v from fx_sheets64 where not (pattern_id%4=2 and row_idx=9 and col_idx=63)),
 w as (select pattern_id, min(row_idx*1000+col_idx) at_ from b where v='red' group by 1), r as (select pattern_id, row_idx from b group by 1,2 having count(*)<>64),
 e as (select pattern_id, cast(at_//1000+1 as int) as "row", cast(at_%1000+1 as int) as "column", 'bad_color' reason, 'red' as "value" from w union all select pattern_id, row_idx+1, 0, 'ragged_row', '63' from r)
select pattern_id, arg_min("row",{'a':"row",'b':"column"}) as "row", arg_min("column",{'a':"row",'b':"column"}) as "column", arg_min(reason,{'a':"row",'b':"column"}) reason, arg_min("value",{'a':"row",'b':"column"}) as "value" from e group by 1
""")
def grid_csv_errors(spark, d):
    p, row, col = F.col("pattern_id"), F.col("row_idx"), F.col("col_idx")
    spoiled = sheets64(spark, d).where(~((p % 4 == 2) & (row == 9) & (col == 63))).withColumn(
        "hex", F.when((p % 3 == 1) & (row == 4) & (col == 6), "red").otherwise(F.col("hex"))
    ).withColumn("is_external", F.col("is_external") & (F.col("hex") != "red"))
    path = scratch_path(spark, "grid-csv")
    grids.write_grid_csv(spoiled, path)
    errors = grids.read_grid_csv(spark, path)[1]
    pid = F.regexp_extract("source", r"pattern_id=(\d+)", 1).cast("int")
    return errors.select(pid.alias("pattern_id"), "row", "column", "reason", "value")


def _saved_patterns(spark, d):
    cells = sheets64(spark, d)
    heads = cells.select("pattern_id").distinct().select(
        "pattern_id", F.concat(F.lit("sheet "), "pattern_id").alias("name"), F.lit("MARD").alias("brand"), F.lit("291").alias("paletteName")
    )
    path = scratch_path(spark, "patterns")
    grids.write_pattern_json(cells, cell_ops.color_counts(cells), heads, path)
    return grids.read_patterns(spark, path)


@query("pattern_json_cells", "select cast(pattern_id as varchar) pattern_id, row_idx, col_idx, color_key, hex, is_external from fx_sheets64")
def pattern_json_cells(spark, d):
    return grids.pattern_cells(_saved_patterns(spark, d))


FIXTURE_SQL["fx_sheet_counts"] = "select cast(pattern_id as varchar) pattern_id, hex, count(*) cnt, any_value(color_key) color_key from fx_sheets64 where not is_external group by 1,2"


@query("pattern_json_counts", "select pattern_id, 'MARD' brand, '291' palette_name, hex, color_key, cnt as \"count\" from fx_sheet_counts")
def pattern_json_counts(spark, d):
    return grids.pattern_counts(_saved_patterns(spark, d))


@query("export_pattern_stats", "select pattern_id, hex, 'MARD' brand, '291' \"paletteName\", color_key, cast(cnt as varchar) as \"count\" from fx_sheet_counts")
def export_pattern_stats(spark, d):
    path = scratch_path(spark, "stats")
    grids.export_pattern_stats(grids.pattern_counts(_saved_patterns(spark, d)), path)
    return spark.read.option("header", True).csv(path)


@query("export_requirements", """
select cast(project_id as varchar) project_id, hex, case when project_id%2=0 then 'Other' else 'MARD' end brand, '291' "paletteName", color_key, cast(needed as varchar) needed, cast(owned as varchar) owned,
       cast(missing as varchar) missing, cast(remaining as varchar) remaining_after_project from fx_required
""")
def export_requirements(spark, d):
    path = scratch_path(spark, "requirements")
    projects = pq.projects(spark, d).select("project_id", F.when(F.col("project_id") % 2 == 0, "Other").otherwise("").alias("brand"), F.lit("291").alias("paletteName"))
    grids.export_requirements(pq.required(spark, d), projects, path)
    return spark.read.option("header", True).csv(path)


# --- inventory and projects -------------------------------------------------

def _inventory(spark, d):
    i = F.col("item_idx")
    raw = fx.items(spark, d).withColumns(
        {
            "color_key": F.concat(F.lit(" "), F.lower("color_key")), "hex": F.when(i % 13 == 0, F.lit(None)).otherwise(F.lower("hex")),
            "owned": F.when(i % 7 == 0, "oops").when(i % 11 == 0, F.concat(F.lit("-"), "owned")).otherwise(F.col("owned").cast("string")),
        }
    )
    houses = fx.stock(spark, d).select("warehouse_id").distinct().withColumns(
        {"name": F.when(F.col("warehouse_id") % 3 == 0, "").otherwise(F.concat(F.lit("w"), "warehouse_id")), "palette_name": F.lit(None).cast("string")}
    )
    heads, rows = lq.transactions(spark, d)
    path = scratch_path(spark, "inventory")
    documents.write_inventory(
        houses, raw, heads.withColumns({"type": F.lit("manual_adjustment"), "note": F.concat(F.lit("entry "), "txn_id")}),
        rows.select("txn_id", "color_key", F.lit("#000000").alias("hex"), "delta", F.lit(0).cast("bigint").alias("before"), F.col("delta").alias("after")), path,
    )
    return documents.read_inventory(spark, f"{path}/*", multi_line=False)


@query("read_inventory_items", """
select cast(warehouse_id as varchar) warehouse_id, color_key, case when item_idx%13=0 then '#000000' else hex end hex, cast(case when item_idx%7=0 then 0 when item_idx%11=0 then 0 else owned end as bigint) owned, is_extra from fx_items
""")
def read_inventory_items(spark, d):
    return _inventory(spark, d)[1].drop("item_idx")


@query("read_inventory_warehouses", """
select distinct cast(warehouse_id as varchar) warehouse_id, case when warehouse_id%3=0 then '未命名豆仓' else 'w'||warehouse_id end "name", 'MARD' brand, '96' palette_name from fx_stock
""")
def read_inventory_warehouses(spark, d):
    return _inventory(spark, d)[0].select("warehouse_id", "name", "brand", "palette_name")


@query("read_inventory_entries", """
select t.warehouse_id::varchar warehouse_id, t.seq, 'manual_adjustment' "type", 'entry '||t.txn_id note, e.color_key, delta from fx_txns t join fx_txn_entries e using (txn_id)
""")
def read_inventory_entries(spark, d):
    _, _, txns, entries = _inventory(spark, d)
    return txns.join(entries, "txn_id").select("warehouse_id", "seq", "type", "note", "color_key", "delta")


def _projects(spark, d):
    """Project documents of ten orders each: a current file, for every fourth also a former one."""
    counts = fx.counted(spark, d).groupBy("pattern_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("color_key", F.col("cnt").cast("double"))))).alias("colorCounts")
    )
    pats = fx.table(spark, d, "orders").withColumn("pattern_id", F.col("o_orderkey")).join(counts, "pattern_id", "left")
    doc = F.struct(
        F.col("pattern_id").cast("string").alias("id"), F.when(F.col("pattern_id") % 2 == 0, F.concat(F.lit("p"), "pattern_id")).alias("name"),
        F.floor("o_totalprice").cast("double").alias("totalBeadCount"), "colorCounts",
        F.when(F.col("o_orderstatus") == "O", "in_progress").when(F.col("o_orderstatus") == "F", "completed").otherwise("odd").alias("status"),
    )
    nested = pats.groupBy(F.floor(F.col("pattern_id") / 10).alias("_b")).agg(F.collect_list(doc).alias("patterns"))
    b = F.col("_b")
    heads = nested.select(
        F.when(b % 3 == 0, F.concat(F.lit("id"), b)).alias("id"), F.concat(F.lit("block "), b).alias("name"), (b % 10).cast("string").alias("warehouseId"),
        "patterns", F.concat(F.lit("/projects/dir"), b, F.lit("/project_data.json")).alias("path"), (b % 4 == 0).alias("_old"),
    )
    former = heads.where("_old").withColumns({"id": F.lit("old"), "name": F.lit("old"), "path": F.regexp_replace("path", "project_data", "project")})
    lines = scratch_path(spark, "projects")
    heads.unionByName(former).drop("_old").write.json(lines)
    docs = spark.read.schema(documents.PROJECT_SCHEMA + ", path string").json(lines)
    return documents.parse_projects(docs)


FIXTURE_SQL["fx_project_blocks"] = """
select distinct o_orderkey//10 b, case when o_orderkey//10%3=0 then 'id'||(o_orderkey//10) else 'dir'||(o_orderkey//10) end project_id from orders
"""


@query("read_projects", """
select project_id, 'dir'||b directory, 'block '||b "name", cast(b%10 as varchar) warehouse_id, '未绑定豆仓' warehouse_name, 'draft' status from fx_project_blocks
""")
def read_projects(spark, d):
    return _projects(spark, d)[0].select("project_id", "directory", "name", "warehouse_id", "warehouse_name", "status")


@query("read_project_patterns", """
select project_id, cast(o_orderkey as varchar) pattern_id, case when o_orderkey%2=0 then 'p'||o_orderkey else '未命名图纸' end "name",
       cast(floor(o_totalprice) as bigint) bead_total, case o_orderstatus when 'O' then 'in_progress' when 'F' then 'completed' else 'draft' end status, false is_deducted
  from orders join fx_project_blocks on b=o_orderkey//10
""")
def read_project_patterns(spark, d):
    return _projects(spark, d)[1].select("project_id", "pattern_id", "name", "bead_total", "status", "is_deducted")


@query("read_project_counts", "select cast(pattern_id as varchar) pattern_id, color_key, cnt as \"count\" from fx_counted join orders on o_orderkey=pattern_id where cnt>0")
def read_project_counts(spark, d):
    return _projects(spark, d)[2]


# --- legend results, manifest, images ---------------------------------------

FIXTURE_SQL["fx_batch"] = """
select group_id, color_key, case when page_idx_min%5=0 then 0 else cnt end cnt, group_id%3=0 no_total from (select group_id, color_key, sum(cnt)::bigint cnt, min(page_idx) page_idx_min from fx_page_rows group by 1,2)
"""


def _batch(spark, d):
    """Batch documents of a hundred images each; some totals are missing, some counts are 0."""
    rows = legend_ops.page_color_rows(leg.legend_items(spark, d)).groupBy("group_id", "color_key").agg(
        F.sum("count").alias("cnt"), F.min("page_idx").alias("page")
    )
    count = F.when(F.col("page") % 5 == 0, 0).otherwise(F.col("cnt")).cast("double")
    per = rows.withColumn("cnt", count).groupBy("group_id").agg(
        F.map_from_entries(F.collect_list(F.struct("color_key", "cnt"))).alias("colorCounts"), F.sum("cnt").alias("_t")
    )
    image = F.struct(
        F.concat(F.lit(" "), "group_id").alias("id"), "colorCounts", F.when(F.col("group_id") % 3 == 0, 0).otherwise(F.col("_t") + 1).alias("totalBeads"),
        F.array(F.lit("a"), F.lit("b")).alias("sourceImages"),
    )
    path = scratch_path(spark, "batch")
    per.groupBy(F.floor(F.col("group_id") / 100).alias("_b")).agg(F.collect_list(image).alias("images")).drop("_b").write.json(path)
    return documents.read_legend_results(spark, path, multi_line=False)


@query("read_legend_patterns", """
select cast(group_id as varchar) pattern_id, cast(case when bool_or(no_total) then sum(cnt) else sum(cnt)+1 end as bigint) bead_total, count(*) filter (where cnt>0) n_colors, true is_grouped from fx_batch group by 1
""")
def read_legend_patterns(spark, d):
    return _batch(spark, d)[0].select("pattern_id", "bead_total", "n_colors", "is_grouped")


@query("read_legend_counts", 'select cast(group_id as varchar) pattern_id, color_key, cast(cnt as bigint) as "count" from fx_batch where cnt>0')
def read_legend_counts(spark, d):
    return _batch(spark, d)[1]


@query("legend_results_round_trip", leg._FINAL + """
select cast(f.group_id as varchar) group_id, total_beads, expected, color_key, cast(cnt as bigint) as "count" from f join fin on fin.group_id=f.group_id
""")
def legend_results_round_trip(spark, d):
    path = scratch_path(spark, "legend")
    documents.write_legend_results(leg._final(spark, d), path)
    return documents.read_legend_lines(spark, path)


@query("manifest_round_trip", """
with g as (select min(event_id) leader, user_id, count(*) n from events group by user_id), k as (select *, row_number() over (order by leader) gi from g)
select printf('group_%03d', gi) group_id, 'Image'||gi group_name, n as "count", case when n>1 then 'group_folder' else 'root_file' end placement, 'f'||event_id source, event_id size, event_id*3 mtime_ns, 'detail_page' page_type, event_type pair_key
  from events join k using (user_id)
""")
def manifest_round_trip(spark, d):
    events = fx.table(spark, d, "events")
    heads = events.groupBy("user_id").agg(F.min("event_id").alias("leader"))
    grouped = events.join(heads, "user_id")
    plan = gq.ops.group_manifest(grouped.select("event_id", "leader"))
    items = grouped.join(plan.select("leader", "group_idx"), "leader").select(
        "group_idx", F.col("event_id").alias("item_idx"), F.concat(F.lit("f"), "event_id").alias("source"), F.col("event_id").alias("size"),
        (F.col("event_id") * 3).alias("mtime_ns"), F.lit("detail_page").alias("page_type"), F.col("event_type").alias("pair_key"),
    )
    path = scratch_path(spark, "manifest")
    documents.write_manifest(plan, items, path)
    return documents.read_manifest(spark, path)


@query("image_pixels", "select image_id*1000+y//16 image_id, x, cast(y%16 as int) y, r, g, b, 255 a from fx_pixels")
def image_pixels(spark, d):
    """Strips of 16 pixel lines as raw bytes, taken apart again."""
    px = fx.pixels(spark, d).withColumns({"image_id": (F.col("image_id") * 1000 + F.floor(F.col("y") / 16)).cast("int"), "y": (F.col("y") % 16).cast("int")})
    dots = F.sort_array(F.collect_list(F.struct("y", "x", F.format_string("%02X%02X%02X", "b", "g", "r").alias("h"))))
    strips = px.groupBy("image_id").agg(
        F.unhex(F.array_join(F.transform(dots, lambda p: p["h"]), "")).alias("data"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    ).withColumn("channels", F.lit(3))
    return images.image_pixels(strips)


def _bitmap_files(spark, d):
    """Strips of 16 pixel lines as BMP files in a fresh folder: every fifth one broken, every seventh under a name that is no image's."""
    folder = scratch_path(spark, "bitmaps")
    px = fx.pixels(spark, d).select(
        (F.col("image_id") * 1000 + F.floor(F.col("y") / 16)).alias("strip"), (F.col("y") % 16).alias("y"), "x", F.format_string("%02X%02X%02X", "b", "g", "r").alias("h")
    )
    little = lambda n: F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * i).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0") for i in range(4)])
    dots = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "h"))), lambda p: p["h"]), "")
    lines = px.groupBy("strip", "y").agg(dots.alias("line"), F.count(F.lit(1)).alias("width"))
    padded = F.rpad("line", (F.ceil(F.col("width") * 3 / 4) * 8).cast("int"), F.lit("0"))
    strips = lines.groupBy("strip").agg(  # a bitmap's lowest line comes first
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", padded.alias("l"))), asc=False), lambda p: p["l"]), "").alias("body"),
        F.max("width").alias("width"), F.count(F.lit(1)).alias("height"),
    )
    header = F.concat(F.lit("424D"), little(F.length("body") / 2 + 54), F.lit("00000000" "36000000" "28000000"), little(F.col("width")), little(F.col("height")), F.lit("01001800" + "00" * 24))
    content = F.unhex(F.when(F.col("strip") % 5 == 0, F.lit("424D0000")).otherwise(F.concat(header, "body")))
    name = F.concat(F.col("strip").cast("string"), F.when(F.col("strip") % 7 == 0, ".txt").otherwise(".BMP"))

    def save(batches):
        system, place = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(place, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():  # a second attempt writes the same bytes
                with system.open_output_stream(f"{place}/{row['name']}") as out:
                    out.write(row["content"])
            yield batch.select(["name"])

    strips.select(name.alias("name"), content.alias("content")).mapInArrow(save, "name string").count()
    return folder


@query("read_images", """
with strips as (select image_id*1000+y//16 strip, max(x)+1 width, count(distinct y) height, sum(r*(x+1)+g*3+b*(y%16+7)) checksum from fx_pixels group by 1)
select cast(strip as varchar) || '.BMP' "name", case when strip%5<>0 then cast(width as int) end width, case when strip%5<>0 then cast(height as int) end height,
  case when strip%5<>0 then cast(checksum as bigint) end checksum, case when strip%5=0 then 'could_not_read' end reason from strips where strip%7<>0
""")
def read_images(spark, d):
    """Decoded files with a checksum of their pixels, and the files that could not be read."""
    found, refused = images.read_images(spark, _bitmap_files(spark, d))
    name = F.element_at(F.split("image_id", "/"), -1).alias("name")
    sums = images.image_pixels(found).groupBy("image_id").agg(F.sum(F.col("r") * (F.col("x") + 1) + F.col("g") * 3 + F.col("b") * (F.col("y") + 7)).alias("checksum"))
    good = found.join(sums, "image_id").select(name, "width", "height", "checksum", F.lit(None).cast("string").alias("reason"))
    bad = refused.select(name, F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("bigint").alias("checksum"), "reason")
    return good.unionByName(bad)
