import pytest
from pyspark.sql import functions as F

from gridloom.functions import colors, keys


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "code, prefix, number", [("a007", "A", 7), ("B 12", "B", 12), ("foo", "FOO", 2**53 - 1), ("ZG1x", "ZG", 1), ("A00", "A", 0)]
)
def test_color_code_parts(spark, code, prefix, number):
    assert one(spark, code, keys.color_key_prefix) == prefix
    assert one(spark, code, keys.color_key_number) == number


@pytest.mark.parametrize("code, hex_", [("H7", "#0008EF"), ("A12", "#00FA22"), ("ZG1", "#015AA4")])
def test_fallback_hex(spark, code, hex_):
    assert one(spark, code, keys.fallback_hex) == hex_


@pytest.mark.parametrize(
    "line, expected",
    [
        ("T1-500", ("T1", 500)), ("t1 500", ("T1", 500)), ("T1,500", ("T1", 500)), ("R11：100", ("R11", 100)), ("A007＋12颗", ("A7", 12)),
        ("  b2 – 3 个", ("B2", 3)), ("A1 0", ("A1", 0)), ("bad line", None), ("A1", None), ("12 A1", None),
    ],
)
def test_replenish_line(spark, line, expected):
    got = one(spark, line, keys.parse_replenish_line)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "text, key", [("52 色号 共 2955 豆", "52_2955"), ("31色呈2652豆", "31_2652"), ("5色 893豆", "5_893"), ("52色", None), ("色12豆", None)]
)
def test_pair_key(spark, text, key):
    assert one(spark, text, keys.parse_pair_key) == key


def test_pair_numbers_and_totals(spark):
    pick = lambda v: tuple(one(spark, v, keys.choose_pair_numbers, "array<int>"))
    assert pick([52, 2955]) == (52, 2955)
    assert pick([31, 120, 300]) == (120, 300)
    assert pick([150]) == (150, 150)
    assert pick([50]) == (None, None)
    assert one(spark, "52_2955", keys.total_from_pair_key) == 2955
    assert one(spark, "x_1", keys.total_from_pair_key) is None


def test_natural_order(spark):
    names = ["img10.png", "img2.png", "12", "a", "img02b", "IMG1.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(keys.natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["12", "a", "IMG1.png", "img2.png", "img02b", "img10.png"]


def test_legend_text(spark):
    assert one(spark, " h7. ", keys.normalize_key_text) == "H7"
    assert one(spark, "??", keys.normalize_key_text) == ""
    assert one(spark, "空 白", keys.special_circle_key) == "transparent"
    assert one(spark, "a1b22", keys.digits_only) == "122"


@pytest.mark.parametrize("code, numeric, family", [("A12", False, "A"), ("zg1", False, "其他"), ("20", True, "1-20"), ("21", True, "21-50"), ("200", True, "101-200"), ("201", True, "200+"), ("x1", True, "其他")])
def test_color_family(spark, code, numeric, family):
    assert one(spark, code, lambda c: keys.color_family(c, numeric)) == family


def test_hex_and_contrast(spark):
    assert tuple(one(spark, "0a0B0c", colors.hex_to_rgb)) == (10, 11, 12)
    assert one(spark, "#12", colors.hex_to_rgb) is None
    assert one(spark, "#FFFFFF", colors.contrast_color) == "#000000"
    assert one(spark, "#101010", colors.contrast_color) == "#FFFFFF"
    assert one(spark, "nope", colors.contrast_color) == "#000000"


def test_lab8_corners(spark):
    lab = lambda h: tuple(one(spark, h, lambda c: colors.rgb_to_lab8(*[colors.hex_channel(c, i) for i in range(3)])))
    assert lab("#FFFFFF") == (255, 128, 128)
    assert lab("#000000") == (0, 128, 128)
    assert lab("#FF0000") == (136, 208, 195)


def test_hsl(spark):
    h = one(spark, "#FF8000", colors.hex_to_hsl)
    assert (round(h.h, 2), round(h.s, 2), round(h.l, 2)) == (30.12, 100.0, 50.0)
