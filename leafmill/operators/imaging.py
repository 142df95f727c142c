"""Images as pixel rows (image_id, x, y, v): decoding to luma, local statistics, binarisation, and PNG output."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.cluster import ship

# The window's half width, the threshold's weight (a 32-bit 0.34), and the shares of red, green and blue in luma.
HALF, WEIGHT = 12, 0.3400000035762787
LUMA = (2126, 7152, 722)


def read_luma(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows of PNG and JPEG files, decoded by content; image_id is the path. A file that cannot be decoded has none."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    i = images.select(F.col("image.origin").alias("image_id"), "image.width", "image.height", F.col("image.nChannels").alias("c"), "image.data")
    i = i.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    at = (F.col("y") * F.col("width") + F.col("x")) * F.col("c")
    byte = lambda n: F.conv(F.hex(F.substring("data", at + n + 1, F.lit(1))), 16, 10).cast("long")
    blue, green, red = (byte(n) for n in range(3))
    luma = F.floor((LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue) / 10000)
    return i.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.when(F.col("c") < 3, byte(0)).otherwise(luma).cast("long").alias("v"))


def png(v: np.ndarray) -> bytes:
    """A grey image (height, width) of bytes as a PNG file."""
    high, wide = v.shape
    raw = np.concatenate([np.zeros((high, 1), np.uint8), v.astype(np.uint8)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def as_png(pixels: DataFrame, value: str = "v") -> DataFrame:
    """image_id and png of pixel rows; a pixel that is missing is black. One image is put together by one task."""
    ship(pixels.sparkSession)
    kind = pixels.schema["image_id"].dataType.simpleString()

    def draw(t: pa.Table) -> pa.Table:
        x, y, v = (t[c].to_numpy().astype(np.int64) for c in ("x", "y", "v"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
        image[y, x] = v
        return pa.table({"image_id": t["image_id"].slice(0, 1), "png": pa.array([png(image)], pa.binary())})

    return pixels.select("image_id", "x", "y", F.col(value).alias("v")).groupBy("image_id").applyInArrow(draw, f"image_id {kind}, png binary")


def box(pixels: DataFrame, half: int = HALF) -> DataFrame:
    """mean and sd over the window around each pixel, clipped at the borders: sums along rows, then along columns."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-half, half)
    column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-half, half)
    v = F.col("v").cast("double")
    p = pixels.withColumns({"__s": F.sum(v).over(row), "__q": F.sum(v * v).over(row), "__n": F.count(F.lit(1)).over(row)})
    p = p.withColumns({c: F.sum(c).over(column) for c in ("__s", "__q", "__n")})
    mean = F.col("__s") / F.col("__n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__n") - mean * mean))
    return p.withColumns({"mean": mean, "sd": sd}).drop("__s", "__q", "__n")


def binarise(pixels: DataFrame, half: int = HALF, weight: float = WEIGHT) -> DataFrame:
    """255 where a pixel is above its local threshold, else 0."""
    limit = F.col("mean") * (1 + F.lit(weight) * (F.col("sd") / 128 - 1))
    return box(pixels, half).withColumn("out", F.when(F.col("v") > limit, 255).otherwise(0)).drop("mean", "sd")
