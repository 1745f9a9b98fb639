"""Texts read as images, so text tables can drive the image operators.

The whole text is the picture: three successive code points (mod 256) are the three bytes of one
pixel, pixels fill rows of a near-square canvas, and the unused tail of the canvas is black.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def text_as_image(df: DataFrame, text: str = "text") -> DataFrame:
    """Add (width, height, n_channels, data); an empty text counts as undecodable (width -1)."""
    # Latin-1 is the code point itself below 256. UTF-32 has four bytes per code point, the last of which is it mod 256.
    any_bytes = F.unhex(F.regexp_replace(F.hex(F.encode(F.col(text), "UTF-32")), "[0-9A-F]{6}([0-9A-F]{2})", "$1"))
    latin = F.col(text).rlike("^[\\x00-\\xff]*\\z")
    low_bytes = F.when(latin, F.encode(F.col(text), "ISO-8859-1")).otherwise(any_bytes)
    pixels = F.ceil(F.length(text) / F.lit(3.0))
    width = F.ceil(F.sqrt(pixels)).cast("int")
    height = F.ceil(pixels / width).cast("int")
    filled = F.length(text) > 0
    return (
        df.withColumn("width", F.when(filled, width).otherwise(F.lit(-1)))
        .withColumn("height", F.when(filled, height).otherwise(F.lit(-1)))
        .withColumn("n_channels", F.when(filled, F.lit(3)).otherwise(F.lit(-1)))
        .withColumn("data", F.rpad(low_bytes, F.col("width") * F.col("height") * 3, F.lit(b"\x00")))
    )
