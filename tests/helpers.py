"""Small builders shared by the tests."""

ERASE = ("ERASE", "#FFFFFF", True)


def grid(spark, text, pattern_id=1):
    """Cells of a drawing: one letter per colour, '.' for an external cell."""
    out = []
    for r, line in enumerate(text.split()):
        for c, ch in enumerate(line):
            key, hex_, ext = ERASE if ch == "." else (ch, f"#{ord(ch):02X}0000", False)
            out.append((pattern_id, r, c, key, hex_, ext))
    return spark.createDataFrame(out, "pattern_id int, row_idx int, col_idx int, color_key string, hex string, is_external boolean")


def draw(cells):
    """Inverse of `grid`."""
    found = {(r.row_idx, r.col_idx): "." if r.is_external else r.color_key for r in cells.collect()}
    height = max(k[0] for k in found) + 1
    width = max(k[1] for k in found) + 1
    return [" ".join("".join(found[r, c] for c in range(width)) for r in range(height))][0]


def palette(spark, entries, name="p"):
    """Palette from (key, hex) pairs in order."""
    data = [(name, i, k, h, int(h[1:3], 16), int(h[3:5], 16), int(h[5:7], 16)) for i, (k, h) in enumerate(entries)]
    return spark.createDataFrame(data, "palette_name string, ord int, color_key string, hex string, r int, g int, b int")
