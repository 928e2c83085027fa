import json
import struct
import zlib

from gridloom.sources import color_tables, documents, grids, images


def test_color_systems_with_mark_and_duplicates(spark, tmp_path, rows):
    (tmp_path / "map.json").write_text("﻿" + json.dumps({"#aa0000": {"a": "A1", "b": "1"}, "#BB0000": {"a": "A1", "b": ""}}), encoding="utf-8")
    systems, doubles = color_tables.read_color_systems(spark, str(tmp_path))
    assert rows(systems, "hex", "system", "code") == [("#AA0000", "a", "A1"), ("#AA0000", "b", "1"), ("#BB0000", "a", "A1")]
    assert rows(doubles) == [("a", "A1", 2)]


def test_palette_sets(spark, tmp_path, rows):
    (tmp_path / "sets.csv").write_text('brand,paletteName,colorCount,colorCodes,sourceUrl\nMARD,24,3,"A2  A1 B1 ",http://x\n', encoding="utf-8")
    assert rows(color_tables.read_palette_sets(spark, str(tmp_path))) == [("MARD", "24", 0, "A2"), ("MARD", "24", 1, "A1"), ("MARD", "24", 2, "B1")]


def test_grid_csv(spark, tmp_path, rows):
    for name, text in {"ok": "#aa0000,TRANSPARENT\n,#BB0000\n", "ragged": "#AA0000,#AA0000\n#AA0000\n", "bad": "#AA0000,#12\nred,#AA0000"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    cells, errors = grids.read_grid_csv(spark, str(tmp_path))
    assert rows(cells, "row_idx", "col_idx", "hex", "is_external") == [(0, 0, "#AA0000", False), (0, 1, "#FFFFFF", True), (1, 0, "#FFFFFF", True), (1, 1, "#BB0000", False)]
    found = {r.source.rsplit("/", 1)[1]: (r.row, r.column, r.reason, r.value) for r in errors.collect()}
    assert found == {"ragged.csv": (2, 0, "ragged_row", "1"), "bad.csv": (1, 2, "bad_color", "#12")}


def test_pattern_document(spark, tmp_path, rows):
    doc = {
        "id": "p1", "selectedColorSystem": "X", "paletteName": "96", "mappedPixelData": [[{"key": "A1", "color": "#AA0000"}, {"key": "ERASE", "color": "#FFFFFF", "isExternal": True}]],
        "colorCounts": {"#aa0000": {"count": 2, "key": "A1"}, "#bb0000": {"count": 0, "colorKey": "B1"}, "#cc0000": {"count": 1, "color": "#dd0000", "colorKey": "D1"}},
    }
    (tmp_path / "p.json").write_text("﻿" + json.dumps(doc, indent=1), encoding="utf-8")
    patterns = grids.read_patterns(spark, str(tmp_path), multi_line=True)
    assert rows(grids.pattern_counts(patterns)) == [("p1", "X", "96", "#AA0000", "A1", 2), ("p1", "X", "96", "#DD0000", "D1", 1)]
    assert rows(grids.pattern_cells(patterns), "col_idx", "color_key", "is_external") == [(0, "A1", False), (1, "ERASE", True)]


def test_inventory_defaults(spark, tmp_path, rows):
    doc = {
        "schemaVersion": 1,
        "warehouses": [{"id": "w", "items": [{"colorKey": " a1 ", "ownedCount": "x"}, {"hex": "#aa0000", "colorKey": "B1", "ownedCount": -4}, {"hex": "#aa0000", "colorKey": "C1", "ownedCount": 7, "isExtraColor": True}]}],
        "transactions": [{"id": "t", "warehouseId": "w", "type": "manual_adjustment", "items": [{"colorKey": "A1", "delta": 1}]}],
    }
    (tmp_path / "inventory.json").write_text(json.dumps(doc, indent=1))
    houses, items, txns, entries = documents.read_inventory(spark, str(tmp_path / "inventory.json"))
    assert rows(houses, "warehouse_id", "brand", "palette_name") == [("w", "MARD", "96")]
    assert rows(items) == [("w", 0, "A1", "#000000", 0, False), ("w", 1, "B1", "#AA0000", 0, False), ("w", 2, "C1", "#AA0000", 7, True)]
    assert rows(txns, "txn_id", "seq") == [("t", 0)] and rows(entries, "color_key", "delta") == [("A1", 1)]
    (tmp_path / "broken.json").write_text("{oops")
    assert documents.read_inventory(spark, str(tmp_path / "broken.json"))[1].count() == 0


def test_projects_prefer_the_current_file(spark, tmp_path, rows):
    for d, name, doc in [
        ("one", "project.json", {"id": "old"}), ("one", "project_data.json", {"status": "weird", "patterns": [{"id": "x", "colorCounts": {"A1": 3, "B1": 0}, "status": "completed"}]}),
        ("two", "project.json", {"id": "legacy", "name": "L", "warehouseId": "w"}),
    ]:
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / name).write_text(json.dumps(doc))
    projects, patterns, counts = documents.read_projects(spark, str(tmp_path / "*" / "*.json"))
    assert rows(projects, "project_id", "name", "warehouse_id", "status") == [("legacy", "L", "w", "draft"), ("one", "one", "", "draft")]
    assert rows(patterns, "project_id", "pattern_id", "status") == [("one", "x", "completed")]
    assert rows(counts) == [("x", "A1", 3)]


def test_legend_results_and_manifest(spark, tmp_path, rows):
    (tmp_path / "r.json").write_text(json.dumps({"images": [{"id": " a ", "colorCounts": {"A1": 2, "B1": -1}}, {"id": "", "colorCounts": {"A1": 1}}, {"id": "c", "totalBeads": 9, "totalColorKeys": 4}]}, indent=1))
    patterns, counts = documents.read_legend_results(spark, str(tmp_path / "r.json"))
    assert rows(patterns, "pattern_id", "bead_total", "n_colors") == [("a", 2, 1), ("c", 9, 4)]
    assert rows(counts) == [("a", "A1", 2)]
    (tmp_path / "m.json").write_text(json.dumps({"groups": [{"id": "g", "count": 1, "items": [{"source": "s", "pairKey": "1_2"}]}]}, indent=1))
    assert rows(documents.read_manifest(spark, str(tmp_path / "m.json"), nested=True), "group_id", "source", "pair_key") == [("g", "s", "1_2")]


def png(pixels):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in line for v in p) for line in pixels)
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path, rows):
    (tmp_path / "a.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (10, 11, 255)]]))
    (tmp_path / "b.png").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("x")
    found, skipped = images.read_images(spark, str(tmp_path))
    assert rows(images.image_pixels(found), "x", "y", "r", "g", "b", "a") == [(0, 0, 1, 2, 3, 255), (0, 1, 7, 8, 9, 255), (1, 0, 4, 5, 6, 255), (1, 1, 10, 11, 255, 255)]
    assert [r.image_id.rsplit("/", 1)[1] for r in skipped.collect()] == ["b.png"]


def test_manifest_with_many_groups_and_a_ledger_with_many_transactions(spark, tmp_path):
    plan = spark.range(1, 1203).selectExpr("cast(id as int) group_idx", "1L as count", "'root_file' placement")
    items = spark.range(1, 1203).selectExpr("cast(id as int) group_idx", "0L item_idx", "'s' source", "id size", "id mtime_ns", "'p' page_type", "'k' pair_key")
    documents.write_manifest(plan, items, str(tmp_path / "m"))
    ids = {r.group_id for r in documents.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert len(ids) == 1202 and {"group_001", "group_999", "group_1202"} <= ids
    houses = spark.sql("select 1 warehouse_id, 'n' name, '96' palette_name, timestamp'2024-01-02 03:04:05.678901' created_at")
    stock = spark.sql("select 1 warehouse_id, 0 item_idx, '#AA0000' hex, 'A1' color_key, 3L owned, false is_extra")
    txns = spark.range(3000).selectExpr("id txn_id", "1 warehouse_id", "id * 2 seq", "'manual_adjustment' type", "concat('n', id) note", "timestamp'2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) created_at")
    moves = txns.selectExpr("txn_id", "'#AA0000' hex", "'A1' color_key", "1L delta", "0L before", "1L after")
    documents.write_inventory(houses, stock, txns, moves, str(tmp_path / "i"))
    read, _, back, _ = documents.read_inventory(spark, str(tmp_path / "i" / "*"), multi_line=False)
    assert str(read.first().created_at) == "2024-01-02 03:04:05.678901"
    assert sorted(map(tuple, back.selectExpr("cast(txn_id as bigint)", "seq", "note", "created_at").collect())) == sorted(map(tuple, txns.select("txn_id", "seq", "note", "created_at").collect()))
