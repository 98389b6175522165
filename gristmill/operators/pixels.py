"""Images as pixel rows (image_id, y, x, r, g, b), channels 0 to 255. Every transform is a projection or an explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def _threshold(t: int) -> int:
    assert isinstance(t, int) and not isinstance(t, bool) and 0 <= t <= 255, "threshold must be an integer from 0 to 255"
    return t


def checked(px: DataFrame) -> DataFrame:
    """px, failing on a channel outside 0 to 255 or null."""
    ok = {c: F.when(F.col(c).between(0, 255), F.col(c)).otherwise(F.raise_error(F.lit("channel out of range")).cast("int")) for c in CHANNELS}
    return px.withColumns(ok)


def _each(px: DataFrame, f) -> DataFrame:
    return px.withColumns({c: f(F.col(c)).cast("int") for c in CHANNELS})


def threshold(px: DataFrame, t: int, inverted: bool = False) -> DataFrame:
    """From t on 255, else 0; inverted the other way round."""
    hi, lo = (0, 255) if inverted else (255, 0)
    return _each(px, lambda c, t=_threshold(t): F.when(c >= t, hi).otherwise(lo))


def truncate(px: DataFrame, t: int) -> DataFrame:
    return _each(px, lambda c, t=_threshold(t): F.least(c, F.lit(t)))


def to_zero(px: DataFrame, t: int) -> DataFrame:
    """Up to t 0."""
    return _each(px, lambda c, t=_threshold(t): F.when(c <= t, 0).otherwise(c))


def upscale(px: DataFrame, s: int) -> DataFrame:
    """Every pixel as s x s pixels. ValueError unless s is an integer over 1."""
    if not isinstance(s, int) or s <= 1:
        raise ValueError("the scale must be an integer over 1")
    k = F.sequence(F.lit(0), F.lit(s - 1))
    tall = px.withColumn("gm_i", F.explode(k)).withColumn("gm_j", F.explode(k))
    return tall.withColumns({"y": F.col("y") * s + F.col("gm_i"), "x": F.col("x") * s + F.col("gm_j")}).drop("gm_i", "gm_j")


def _sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.max("y").alias("gm_h"), F.max("x").alias("gm_w")).withColumnRenamed("image_id", "gm_id")


def flip(px: DataFrame, axis: str) -> DataFrame:
    """vertical turns rows around, horizontal columns. One row an image is aggregated and joined back."""
    if axis not in ("vertical", "horizontal"):
        raise ValueError("axis must be vertical or horizontal")
    c, top = ("y", "gm_h") if axis == "vertical" else ("x", "gm_w")
    return px.join(_sizes(px), F.col("image_id") == F.col("gm_id")).withColumn(c, F.col(top) - F.col(c)).drop("gm_id", "gm_h", "gm_w")


def rotate(px: DataFrame) -> DataFrame:
    """A quarter turn clockwise."""
    out = px.join(_sizes(px), F.col("image_id") == F.col("gm_id"))
    return out.withColumns({"y": F.col("x"), "x": F.col("gm_h") - F.col("y")}).drop("gm_id", "gm_h", "gm_w")


def hsv() -> tuple[Column, Column, Column]:
    """Hue in [0, 360), saturation and value in [0, 1], of r, g, b; grey has hue 0 and black saturation 0."""
    r, g, b = (F.col(c) / F.lit(255.0) for c in CHANNELS)
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = most - least
    sector = F.when(most == r, F.pmod((g - b) / d, F.lit(6.0))).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d == 0, 0.0).otherwise(sector * 60), F.when(most == 0, 0.0).otherwise(d / most), most


def to_hsv(px: DataFrame) -> DataFrame:
    h, s, v = hsv()
    return px.select("image_id", "y", "x", h.alias("h"), s.alias("s"), v.alias("v"))


GREY = {
    "mean": lambda r, g, b: (r + g + b) / 3,
    "luminosity": lambda r, g, b: r * 0.299 + g * 0.587 + b * 0.114,
    "lightness": lambda r, g, b: (F.greatest(r, g, b) + F.least(r, g, b)) / 2,
    "maximum": lambda r, g, b: F.greatest(r, g, b),
}


def greyscale(px: DataFrame, method: str = "mean") -> DataFrame:
    """(image_id, y, x, grey), a double. ValueError for a method that is not in GREY."""
    if method not in GREY:
        raise ValueError(f"method must be one of {sorted(GREY)}")
    return px.select("image_id", "y", "x", GREY[method](*(F.col(c).cast("double") for c in CHANNELS)).alias("grey"))


def brightness(px: DataFrame, add: int) -> DataFrame:
    """Extension: each channel plus add, held to 0 to 255."""
    return _each(px, lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c + add)))


def gamma(px: DataFrame, g: float) -> DataFrame:
    """Extension: 255 (c / 255)^g, rounded."""
    return _each(px, lambda c: F.round(F.pow(c / F.lit(255.0), F.lit(g)) * 255))


def histogram(px: DataFrame) -> DataFrame:
    """Extension: (image_id, channel, level, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("level")) for c in CHANNELS]))
    return px.select("image_id", pairs.alias("p")).groupBy("image_id", "p.channel", "p.level").agg(F.count(F.lit(1)).alias("n"))
