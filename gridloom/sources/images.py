"""Screenshots as pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import natural_key

# File types read as images.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"]


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images below a folder, and the files that could not be decoded.

    Images: image_id (path), name_key (natural sort key of the name), width, height,
    channels and the raw bytes in blue-green-red order.
    """
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    listed = raw.where(F.lower(F.regexp_extract("origin", r"\.([^./\\]+)$", 1)).isin(IMAGE_EXTENSIONS))
    good = F.col("width") > 0
    name = F.element_at(F.split("origin", "/"), -1)
    images = listed.where(good).select(
        F.col("origin").alias("image_id"), natural_key(name).alias("name_key"), "width", "height", F.col("nChannels").alias("channels"), "data"
    )
    return images, listed.where(~good).select(F.col("origin").alias("image_id"), F.lit("could_not_read").alias("reason"))


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixel rows (image_id, x, y, r, g, b, a); pixel lines are unfolded before their pixels."""
    n = F.col("channels")
    line = F.substring("data", F.col("y") * F.col("width") * n + 1, F.col("width") * n)
    lines = images.select("image_id", "width", "channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    lines = lines.select("image_id", "y", "width", "channels", F.hex(line).alias("_h"))
    dots = lines.select("image_id", "y", "channels", "_h", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    byte = lambda i: F.conv(F.substring("_h", (F.col("x") * n + i) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    channel = lambda i: F.when(n == 1, byte(F.lit(0))).otherwise(byte(F.lit(i)))
    return dots.select(
        "image_id", "x", "y", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"), F.when(n == 4, byte(F.lit(3))).otherwise(255).alias("a")
    )
