"""Grey-value operators on the pixel view or on any frame with a ``value`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: luma weights of red, green, blue -------------------------------------
LUMA = (0.299, 0.587, 0.114)
# --- fixed values: normalisation means and deviations of the three colour channels -------
RGB_MEAN, RGB_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
GRAY_MEAN, GRAY_STD = 0.33, 0.33


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rounded luma; the caller names the channel order by the arguments."""
    return F.round(r * LUMA[0] + g * LUMA[1] + b * LUMA[2]).cast("int")


def normalize(v: Column, how: str = "unit", channel: int | None = None) -> Column:
    """``unit``: v/255.  ``standard``: (v/255-mean)/std, grey values or one RGB channel."""
    if how == "unit":
        return v / F.lit(255.0)
    mean, std = (GRAY_MEAN, GRAY_STD) if channel is None else (RGB_MEAN[channel], RGB_STD[channel])
    return (v / F.lit(255.0) - mean) / std


def minmax_normalize(layer: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Stretch each image to 0..255; a constant image becomes 0."""
    ends = layer.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.coalesce(F.try_divide((F.col("value") - F.col("lo")) * 255.0, (F.col("hi") - F.col("lo")).cast("double")), F.lit(0.0))
    return layer.join(ends, list(keys)).withColumn("value", scaled).drop("lo", "hi")


def abs_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id", "y", "x")) -> DataFrame:
    """Absolute difference of two layers of the same grid."""
    return a.join(b.withColumnRenamed("value", "other"), list(keys)).select(
        *keys, F.abs(F.col("value").cast("double") - F.col("other")).alias("value")
    )


def threshold(v: Column, t) -> Column:
    """255 where strictly above ``t``, else 0."""
    return F.when(v > t, 255).otherwise(0)


def histogram(layer: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Exact count per grey level; partial counts leave at most 256 rows per image and task."""
    return layer.groupBy(*keys, F.col("value").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def otsu_threshold(hist: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Level of the largest between-class variance, first maximum; windows hold at most 256 rows."""
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    n, v = F.col("n"), F.col("value")
    sums = hist.select(
        *keys,
        "value",
        F.sum(n).over(upto).alias("w0"),
        F.sum(n * v).over(upto).alias("s0"),
        F.sum(n).over(whole).alias("w"),
        F.sum(n * v).over(whole).alias("s"),
    )
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  (products of large photos leave 64 bits)
    gap = (exact("s0") * exact("w") - exact("s") * exact("w0")).cast("double")
    between = F.coalesce(
        F.try_divide(gap * gap, F.col("w0").cast("double") * (F.col("w") - F.col("w0"))), F.lit(0.0)
    )
    best = F.min_by("value", F.struct(-F.col("score"), F.col("value")))
    return sums.withColumn("score", between).groupBy(*keys).agg(best.alias("threshold"))


def area_threshold(hist: DataFrame, start: int = 64, share: float = 0.62, floor: int = 40, back: int = 4, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Level whose dark share fits: walk down from ``start`` while more than ``share`` lies at or below.

    A walk that stops above ``floor`` steps ``back`` further, not below ``floor``.  Null when
    even level 0 holds more than ``share``.  Only levels that occur carry histogram rows, so
    the walk is the end of the gap below the first level whose running share is too large.
    """
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    running = hist.select(*keys, "value", (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("cdf"))
    first_over = F.min(F.when(F.col("cdf") > share, F.col("value")))
    found = running.groupBy(*keys).agg(first_over.alias("over"))
    walked = F.col("over") - 1
    return found.select(
        *keys,
        F.when(F.col("over") > start, F.lit(start))
        .when(F.col("over") == 0, F.lit(None))
        .when(walked > floor, F.greatest(F.lit(floor), walked - back))
        .otherwise(walked)
        .cast("int")
        .alias("threshold"),
    )


def number(v: int | Column) -> Column:
    """A size: one for all images, or a column of the layer that gives each image its own."""
    return v if isinstance(v, Column) else F.lit(v)


def downscale(layer: DataFrame, factor: int, height: int | Column, width: int | Column, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Area mean by a whole factor; a remainder row or column is cut off."""
    if factor == 1:
        return layer
    y, x = F.floor(F.col("y") / factor).cast("int"), F.floor(F.col("x") / factor).cast("int")
    whole = (F.col("y") < F.floor(number(height) / factor) * factor) & (F.col("x") < F.floor(number(width) / factor) * factor)
    return layer.where(whole).groupBy(*keys, y.alias("y"), x.alias("x")).agg(F.avg("value").alias("value"))


def resize_nearest(layer: DataFrame, size: tuple[int | Column, int | Column], target: tuple[int | Column, int | Column], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Nearest resize for masks: target row i reads source row floor(i*h/H).

    Each source pixel knows its own target rows and columns, so growing is an explode
    and shrinking a filter; no join and no target grid.
    """
    (h, w), (th, tw) = map(number, size), map(number, target)

    def span(c: str, n: Column, m: Column) -> Column:
        first = F.ceil(F.col(c) * m / n)
        last = F.ceil((F.col(c) + 1) * m / n) - 1
        return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    return (
        layer.select(*keys, span("y", h, th).alias("ys"), span("x", w, tw).alias("xs"), "value")
        .select(*keys, F.explode("ys").alias("y"), "xs", "value")
        .select(*keys, "y", F.explode("xs").alias("x"), "value")
    )


def crop(layer: DataFrame, x, y, w, h) -> DataFrame:
    """Half-open rectangle, moved to the origin."""
    return layer.where((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)).withColumns(
        {"x": (F.col("x") - x).cast("int"), "y": (F.col("y") - y).cast("int")}
    )


def paste(layer: DataFrame, x, y, frame_h, frame_w, size: tuple[int | Column, int | Column], target: tuple[int | Column, int | Column], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mask resized to ``target``, put at (x, y), cut at the frame and made 0/1; background rows vanish.

    Places and sizes are numbers or columns of the layer.
    """
    place = {"at_x": x, "at_y": y, "frame_h": frame_h, "frame_w": frame_w}
    placed = layer.where("value > 0").withColumns({c: number(v) for c, v in place.items()})
    return (
        resize_nearest(placed, size, target, [*keys, *place])
        .withColumns({"y": (F.col("y") + F.col("at_y")).cast("int"), "x": (F.col("x") + F.col("at_x")).cast("int")})
        .where("x >= 0 and x < frame_w and y >= 0 and y < frame_h")
        .select(*keys, "y", "x", F.lit(1).alias("value"))
    )


def flip_and_turn(layer: DataFrame, op: str, height: int | Column, width: int | Column) -> DataFrame:
    """Coordinate maps: hflip, vflip, rot90 (counter-clockwise), transpose."""
    y, x = F.col("y"), F.col("x")
    height, width = number(height), number(width)
    maps = {
        "hflip": (y, width - 1 - x),
        "vflip": (height - 1 - y, x),
        "rot90": (width - 1 - x, y),
        "transpose": (x, y),
    }
    new_y, new_x = maps[op]
    return layer.withColumns({"y": new_y.cast("int"), "x": new_x.cast("int")})


def brightness_contrast(v: Column, brightness: Column, contrast: Column) -> Column:
    """v*(1+contrast) + 255*brightness, cut to 0..255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * (1 + contrast) + 255 * brightness))


def superimpose(base: DataFrame, placed: DataFrame, channels: Sequence[str] = ("value",)) -> DataFrame:
    """Subtract placed difference pixels (``diff``, 0/1 ``cover``) from every channel, cut to 0..255.

    ``placed`` holds at most one row per pixel; accepted placements do not overlap.
    """
    joined = base.join(placed.select("image_id", "y", "x", "diff", "cover"), ["image_id", "y", "x"], "left")
    drop = F.coalesce(F.col("diff") * F.col("cover"), F.lit(0))
    return joined.withColumns(
        {c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) - drop)).cast("int") for c in channels}
    ).drop("diff", "cover")


def superimpose_protected(base: DataFrame, placed: DataFrame, protect: DataFrame, channels: Sequence[str] = ("value",)) -> DataFrame:
    """As ``superimpose`` but never inside the protected mask (image_id, y, x)."""
    return superimpose(base, placed.join(protect, ["image_id", "y", "x"], "left_anti"), channels)


def bright_line_flag(layer: DataFrame, rects: DataFrame, delta: float = 50.0) -> DataFrame:
    """True when a row inside any rectangle is brighter on average than the rectangle by more than ``delta``.

    ``rects``: image_id, rect_id, x, y, w, h; a handful per image, so the equi join on the
    image only multiplies pixels by that handful.  An empty rectangle is false.
    """
    inside = layer.alias("p").join(
        rects.select("image_id", "rect_id", F.col("x").alias("rx"), F.col("y").alias("ry"), "w", "h").alias("r"), "image_id"
    ).where("x >= rx and x < rx + w and y >= ry and y < ry + h")
    rows = inside.groupBy("image_id", "rect_id", "y").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return bright_rows(rows, rects, delta)


def bright_rows(rows: DataFrame, rects: DataFrame, delta: float) -> DataFrame:
    """The flag out of ``total`` and ``n`` of each row of a rectangle.

    Rows of one length are compared by whole sums, so a row brighter by ``delta`` to the dot is no hit
    in any order of adding; only rectangles with holes need quotients.
    """
    mean = F.col("total") / F.col("n")
    whole = F.max("total") * F.count(F.lit(1)) - F.sum("total") > F.lit(delta) * F.max("n") * F.count(F.lit(1))
    hit = F.when(F.min("n") == F.max("n"), whole).otherwise(F.max(mean) > F.avg(mean) + delta)
    flags = rows.where("n > 0").groupBy("image_id", "rect_id").agg(hit.alias("hit"))
    hits = flags.groupBy("image_id").agg(F.bool_or("hit").alias("power_on"))
    images = rects.select("image_id").distinct()
    return images.join(hits, "image_id", "left").select("image_id", F.coalesce("power_on", F.lit(False)).alias("power_on"))
