"""Colour-code, title-text and status parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinel for an erased cell, number that sorts unparsable codes last.
ERASE_KEY = "ERASE"
ERASE_HEX = "#FFFFFF"
UNPARSED_NUMBER = 2**53 - 1

# White space as browsers trim it: ASCII, no-break, ideographic, byte-order mark.
_SPACE = r"\s\u00A0\u3000\uFEFF"
_CODE = r"^([A-Za-z]+)\s*0*(\d+)"


def _blank_safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim_all(c: Column) -> Column:
    """Strip any white space, not only blanks."""
    return F.regexp_replace(_blank_safe(c), rf"^[{_SPACE}]+|[{_SPACE}]+$", "")


def normalize_color_key(c: Column) -> Column:
    return F.upper(trim_all(c))


def color_key_prefix(c: Column) -> Column:
    return F.upper(F.when(c.rlike(_CODE), F.regexp_extract(c, _CODE, 1)).otherwise(c))


def color_key_number(c: Column) -> Column:
    digits = F.regexp_extract(c, _CODE, 2)
    return F.coalesce(F.when(c.rlike(_CODE), digits.try_cast("bigint")), F.lit(UNPARSED_NUMBER))


def natural_key(c: Column) -> Column:
    """Array that sorts text with embedded numbers by value: text, number, text, …"""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(F.lower(c), r"(\d+)", f"{mark}$1{mark}"), mark)

    def sortable(part: Column) -> Column:
        bare = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^\d+$"), F.concat(F.lpad(F.length(bare).cast("string"), 6, "0"), bare)).otherwise(part)

    return F.transform(parts, sortable)


def color_key_order(c: Column) -> list[Column]:
    """Sort columns for colour codes: letter prefix, number, then natural text."""
    return [color_key_prefix(c), color_key_number(c), natural_key(c)]


def fallback_hex(c: Column) -> Column:
    """Stable stand-in colour for a code without a known hex value: base-31 hash, low 24 bits."""

    def unit(ch: Column) -> Column:
        code = F.ascii(ch).cast("bigint")
        return F.when(code > 65535, 55296 + F.floor((code - 65536) / 1024)).otherwise(code)

    folded = F.aggregate(
        F.split(c, ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: F.pmod(acc * 31 + unit(ch), F.lit(2**32)),
    )
    return F.concat(F.lit("#"), F.lpad(F.hex(F.pmod(folded, F.lit(2**24))), 6, "0"))


# The title marks 色 (colours), 号/呈 (optional), 豆 (pieces).
_PAIR = r"(\d+)色(?:号|呈)?.*?(\d+)豆"


def parse_pair_key(text: Column) -> Column:
    """`<colours>_<pieces>` from a title, NULL when it does not match."""
    compact = F.regexp_replace(text, r"\s+", "")
    joined = F.concat_ws(
        "_",
        F.regexp_extract(compact, _PAIR, 1).try_cast("bigint").cast("string"),
        F.regexp_extract(compact, _PAIR, 2).try_cast("bigint").cast("string"),
    )
    return F.when(compact.rlike(_PAIR), joined)


def choose_pair_numbers(numbers: Column) -> Column:
    """struct(color_count, bead_count) guessed from the numbers seen in a title."""
    colors = F.filter(numbers, lambda v: (v >= 1) & (v <= 400))
    bead = F.array_max(F.filter(numbers, lambda v: (v >= 100) & (v <= 20000)))
    others = F.filter(colors, lambda v: v != bead)
    color = F.coalesce(F.try_element_at(others, F.lit(-1)), F.try_element_at(colors, F.lit(-1)))
    both = bead.isNotNull() & color.isNotNull()
    return F.struct(F.when(both, color).alias("color_count"), F.when(both, bead).alias("bead_count"))


def total_from_pair_key(pair_key: Column) -> Column:
    return F.regexp_extract(pair_key, r"^\d+_(\d+)$", 1).try_cast("bigint")


def is_pair_key(pair_key: Column) -> Column:
    return F.coalesce(pair_key.rlike(r"^\d+_\d+$"), F.lit(False))


def normalize_key_text(text: Column) -> Column:
    clean = F.upper(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))
    code = r"([A-Z]{1,3})(\d{1,2})"
    return F.when(
        clean.rlike(code), F.concat(F.regexp_extract(clean, code, 1), F.regexp_extract(clean, code, 2))
    ).otherwise(clean)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def special_circle_key(text: Column) -> Column:
    """空 marks the transparent count, 全 the full count."""
    compact = F.regexp_replace(text, r"\s+", "")
    return F.when(compact.contains("空"), "transparent").when(compact.contains("全"), "full").otherwise("")


# Separators that count as a blank, unit words that are dropped.
_SEPARATORS = "，,：:＋+-–—"
_UNITS = "颗粒个"
_LINE = rf"^([A-Za-z]+)[{_SPACE}]*0*(\d+)[{_SPACE}]+(\d+)\b"


def parse_replenish_line(line: Column) -> Column:
    """struct(color_key, count) from one restock line, NULL when it cannot be read."""
    flat = F.translate(trim_all(line), _SEPARATORS + _UNITS, " " * len(_SEPARATORS))
    code = F.concat(
        F.upper(F.regexp_extract(flat, _LINE, 1)),
        F.regexp_extract(flat, _LINE, 2).try_cast("decimal(38,0)").cast("string"),
    )
    count = F.regexp_extract(flat, _LINE, 3).try_cast("bigint")
    return F.when(flat.rlike(_LINE), F.struct(code.alias("color_key"), count.alias("count")))


def normalize_status(status: Column) -> Column:
    return F.when(status.isin("in_progress", "completed"), status).otherwise("draft")


def status_label(status: Column) -> Column:
    """Display labels of the three states."""
    return F.when(status == "in_progress", "进行中").when(status == "completed", "已完成").otherwise("草稿")


# Label for codes without a family, upper ends of the numeric ranges.
OTHER_FAMILY = "其他"
NUMERIC_RANGES = [(20, "1-20"), (50, "21-50"), (100, "51-100"), (200, "101-200")]


def color_family(code: Column, numeric: bool = False) -> Column:
    """Family of a colour code: its capital letters, or a number range for numeric vendors."""
    if not numeric:
        letters = F.regexp_extract(code, r"^[A-Z]+", 0)
        return F.when(letters != "", letters).otherwise(OTHER_FAMILY)
    number = code.try_cast("bigint")
    bucket = F.when(F.lit(False), F.lit(""))
    for upper, label in NUMERIC_RANGES:
        bucket = bucket.when(number <= upper, label)
    return F.when(code.rlike(r"^\d+$"), bucket.otherwise("200+")).otherwise(OTHER_FAMILY)


def series_prefix(code: Column) -> Column:
    return F.regexp_extract(normalize_color_key(code), r"^[A-Za-z]+", 0)
