"""Patch grids and clipping annotations to patches.

A grid is regular, so the patches a box meets follow from its coordinates: boxes explode
to patch numbers.  There is no range join and no pair list; a box yields only the patches
it really overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan.operators.geometry import polygon_to_runs


def grid_step(size: int, overlap: float | int) -> int:
    """Whole-number overlap in pixels, or a share in [0, 1)."""
    if isinstance(overlap, float):
        if not 0 <= overlap < 1:
            raise ValueError("overlap share must be in [0, 1)")
        step = int(size * (1 - overlap))
    else:
        step = size - overlap
    if step <= 0:
        raise ValueError("patch step must be positive")
    return step


def _count(extent: Column, step: int) -> Column:
    return F.ceil(extent / F.lit(step)).cast("bigint")


def patch_grid(frames: DataFrame, size: int, overlap: float | int) -> DataFrame:
    """Patches of each frame (image_id, x, y, w, h), numbered in raster order from 0."""
    step = grid_step(size, overlap)
    cols, rows = _count(F.col("w"), step), _count(F.col("h"), step)
    zero = F.lit(0).cast("bigint")
    return (
        frames.where("w > 0 and h > 0")
        .select("*", cols.alias("n_cols"), F.explode(F.sequence(zero, rows - 1)).alias("row"))
        .select("*", F.explode(F.sequence(zero, F.col("n_cols") - 1)).alias("col"))
        .select(
            "image_id",
            (F.col("row") * F.col("n_cols") + F.col("col")).alias("patch_id"),
            (F.col("x") + F.col("col") * step).alias("x0"),
            (F.col("y") + F.col("row") * step).alias("y0"),
            F.least(F.col("x") + F.col("col") * step + size, F.col("x") + F.col("w")).alias("x1"),
            F.least(F.col("y") + F.col("row") * step + size, F.col("y") + F.col("h")).alias("y1"),
        )
    )


def _first_last(low: Column, high: Column, origin: Column, extent: Column, size: int, step: int) -> tuple[Column, Column]:
    """First and last grid number whose half-open patch strictly overlaps [low, high)."""
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((low - origin - size) / F.lit(step)).cast("bigint") + 1)
    last = F.least(_count(extent, step) - 1, F.ceil((high - origin) / F.lit(step)).cast("bigint") - 1)
    return first, last


def _with_frame(items: DataFrame, frames: DataFrame) -> DataFrame:
    """One frame row per image: AQE splits a hot image on the item side."""
    fr = frames.select("image_id", F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("w").alias("fw"), F.col("h").alias("fh"))
    return items.join(fr, "image_id")


def _met_patches(framed: DataFrame, size: int, overlap, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Rows exploded to the patches of their frame that [x0,x1) x [y0,y1) meets."""
    step = grid_step(size, overlap)
    fx, fy, fw, fh = (F.col(c) for c in ("fx", "fy", "fw", "fh"))
    c0, c1 = _first_last(x0, x1, fx, fw, size, step)
    r0, r1 = _first_last(y0, y1, fy, fh, size, step)
    inside = (x0 < fx + fw) & (x1 > fx) & (y0 < fy + fh) & (y1 > fy)
    met = framed.where(inside).withColumns({"c0": c0, "c1": c1, "r0": r0, "r1": r1}).where("c0 <= c1 and r0 <= r1")
    # the ranges are never empty here; the outer form only spares a second evaluation in a filter
    return (
        met.withColumn("row", F.explode_outer(F.sequence("r0", "r1")))
        .withColumn("col", F.explode_outer(F.sequence("c0", "c1")))
        .withColumns(
            {
                "patch_id": F.col("row") * _count(F.col("fw"), step) + F.col("col"),
                "px0": F.col("fx") + F.col("col") * step,
                "py0": F.col("fy") + F.col("row") * step,
            }
        )
        .withColumns(
            {
                "px1": F.least(F.col("px0") + size, F.col("fx") + F.col("fw")),
                "py1": F.least(F.col("py0") + size, F.col("fy") + F.col("fh")),
            }
        )
        .drop("c0", "c1", "r0", "r1", "row", "col", "fx", "fy", "fw", "fh")
    )


def boxes_to_patches(boxes: DataFrame, frames: DataFrame, size: int, overlap: float | int, keep_empty: bool = False) -> DataFrame:
    """Boxes clipped to every patch they overlap, in patch coordinates, area counted filled."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    met = _met_patches(_with_frame(boxes, frames), size, overlap, x, y, x + w, y + h)
    clipped = met.select(
        "image_id",
        "patch_id",
        "ann_id",
        "category_id",
        (F.greatest(x, "px0") - F.col("px0")).alias("bx"),
        (F.greatest(y, "py0") - F.col("py0")).alias("by"),
        (F.least(x + w, "px1") - F.greatest(x, "px0")).alias("bw"),
        (F.least(y + h, "py1") - F.greatest(y, "py0")).alias("bh"),
    ).withColumn("area", F.col("bw") * F.col("bh")).where("bw > 0 and bh > 0")
    if not keep_empty:
        return clipped
    return patch_grid(frames, size, overlap).select("image_id", "patch_id").join(clipped, ["image_id", "patch_id"], "left")


def clipped_area(polygons: DataFrame, frames: DataFrame, size: int, overlap: float | int) -> DataFrame:
    """Filled pixels of each polygon (image_id, ann_id, points) inside each patch.

    Only polygons are shuffled (to meet their frame); their runs are made, cut and
    partially summed in the same task.
    """
    carried = ["image_id", "ann_id", "fx", "fy", "fw", "fh"]
    runs = polygon_to_runs(_with_frame(polygons, frames), carried)
    y = F.col("y").cast("bigint")
    met = _met_patches(runs, size, overlap, F.col("x0").cast("bigint"), y, F.col("x1").cast("bigint") + 1, y + 1)
    inside = F.least(F.col("x1") + 1, F.col("px1")) - F.greatest("x0", "px0")
    return met.groupBy("image_id", "patch_id", "ann_id").agg(F.sum(inside).cast("bigint").alias("area")).where("area > 0")


def shift_polygon(points: Column, x: Column, y: Column) -> Column:
    """Polygon in patch coordinates; points are moved, not clipped."""
    return F.transform(points, lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y")))
