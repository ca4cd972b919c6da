"""Boxes, screen candidates, inspection rectangles and polygons as column arithmetic.

``int_of`` cuts towards zero like the integer conversion the rules were written for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_of(c: Column) -> Column:
    return c.cast("bigint")


def box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


# --- fixed values: default screen margins in percent -------------------------------------
MARGINS = {"left": 12, "top": 15, "right": 12, "bottom": 15}


def margin_box(w: Column, h: Column, margins: dict = MARGINS) -> Column:
    """Box that leaves the given percentages free on each side."""
    x0, y0 = int_of(w * (margins["left"] / 100.0)), int_of(h * (margins["top"] / 100.0))
    x1, y1 = int_of(w * (1.0 - margins["right"] / 100.0)), int_of(h * (1.0 - margins["bottom"] / 100.0))
    return box(x0, y0, x1 - x0, y1 - y0)


def clip_box(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Clamp the corner into the frame, then the size to what is left."""
    cx, cy = F.greatest(F.lit(0), F.least(x, frame_w)), F.greatest(F.lit(0), F.least(y, frame_h))
    return box(cx, cy, F.least(w, frame_w - cx), F.least(h, frame_h - cy))


def rescale_box(x: Column, y: Column, w: Column, h: Column, scale: float) -> Column:
    return box(*[int_of(v / F.lit(scale)) for v in (x, y, w, h)])


def screen_share(w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    return w * h / (frame_w * frame_h) * 100


def turned_size(w: Column, h: Column, angle: Column, scale: Column) -> Column:
    """Scaled size and the canvas that holds it after turning by ``angle`` degrees."""
    sw, sh = int_of(w * scale), int_of(h * scale)
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    # corner offsets from the origin corner: (0,0) (w,0) (w,h) (0,h)
    xs = [F.lit(0.0), sw * c, sw * c + sh * s, sh * s]
    ys = [F.lit(0.0), -(sw * s), sh * c - sw * s, sh * c]
    wide = F.ceil(F.round(F.greatest(*xs) - F.least(*xs), 6))
    high = F.ceil(F.round(F.greatest(*ys) - F.least(*ys), 6))
    return F.struct(sw.alias("sw"), sh.alias("sh"), wide.alias("tw"), high.alias("th"))


# ------------------------------------------------------------------ screen candidates
def valid_boundary(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Inside the frame, 30..95 % of both sides, aspect 0.2..1.5."""
    aspect = w.cast("double") / h
    # The shares and the aspects below.
    return (
        (x >= 0) & (y >= 0) & (x + w <= frame_w) & (y + h <= frame_h)
        & (w >= frame_w * 0.3) & (h >= frame_h * 0.3)
        & (w <= frame_w * 0.95) & (h <= frame_h * 0.95)
        & (aspect >= 0.2) & (aspect <= 1.5)
    )


def score_boundary(cands: DataFrame, rule: str) -> DataFrame:
    """Adds ``score`` (null = not a candidate) by one of three rules.

    Columns used: x, y, w, h, area, frame_w, frame_h.  ``centred``: .5 area + .3 aspect +
    .2 position.  ``edges``: area share times 1 or .5 by aspect.  ``rectangle``: area of
    well filled upright rectangles.
    """
    x, y, w, h, area = (F.col(c) for c in ("x", "y", "w", "h", "area"))
    fw, fh = F.col("frame_w"), F.col("frame_h")
    frame = fw * fh
    aspect = w.cast("double") / h
    # The weights, shares and aspects of the three rules.
    upright = (aspect >= 0.4) & (aspect <= 0.8)
    if rule == "centred":
        area_score = F.least(F.lit(1.0), area / (frame * 0.5))
        aspect_score = F.when(upright, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(aspect - 0.6)))
        mid_x, mid_y = F.floor(fw / 2), F.floor(fh / 2)
        off = F.sqrt(F.pow(x + F.floor(w / 2) - mid_x, 2) + F.pow(y + F.floor(h / 2) - mid_y, 2))
        position = 1.0 - off / F.sqrt(F.pow(mid_x, 2) + F.pow(mid_y, 2))
        score = F.when(area >= frame * 0.1, area_score * 0.5 + aspect_score * 0.3 + position * 0.2)
    elif rule == "edges":
        score = F.when(
            area >= frame * 0.1, F.least(F.lit(1.0), area / (frame * 0.4)) * F.when(upright, 1.0).otherwise(0.5)
        )
    elif rule == "rectangle":
        fits = (area > frame * 0.15) & (aspect > 0.3) & (aspect < 0.9) & (area / (w * h) > 0.6)
        score = F.when(fits, area.cast("double"))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return cands.withColumn("score", score)


def best_candidate(scored: DataFrame) -> DataFrame:
    """Highest score per image, the earlier candidate on a tie; partial aggregation only."""
    first = F.min_by(
        F.struct("cand_id", "x", "y", "w", "h", "score"), F.struct((-F.col("score")).alias("s"), F.col("cand_id"))
    )
    return scored.where("score is not null").groupBy("image_id").agg(first.alias("b")).select("image_id", "b.*")


def first_valid(images: DataFrame, cands: DataFrame, margins: dict = MARGINS) -> DataFrame:
    """Valid box of the most trusted method per image, else the margin box.

    ``images``: image_id, frame_w, frame_h.  ``cands``: image_id, prio, x, y, w, h.
    """
    known = cands.join(images, "image_id").where(
        valid_boundary(*[F.col(c) for c in ("x", "y", "w", "h", "frame_w", "frame_h")])
    )
    best = known.groupBy("image_id").agg(F.min_by(F.struct("x", "y", "w", "h", "prio"), F.struct("prio", "x", "y", "w", "h")).alias("b"))
    fallback = margin_box(F.col("frame_w"), F.col("frame_h"), margins)
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), fallback[c]).alias(c)
    return images.join(best, "image_id", "left").select(
        "image_id", *[pick(c) for c in ("x", "y", "w", "h")], F.col("b.prio").alias("prio")
    )


# --------------------------------------------------------------- inspection rectangles
def crack_crops(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Array of the top, middle and bottom square of the device."""
    # The shares of width and height below.
    rx, rw = x + int_of(w * 0.025), int_of(w * 0.95)
    ry, rh = y + int_of(h * 0.01), int_of(h * 0.98)
    mid0, mid1 = int_of(ry + rh / 2 - rw / 2), int_of(ry + rh / 2 + rw / 2)
    squares = [("top", ry, rw), ("mid", mid0, mid1 - mid0), ("bot", ry + rh - rw, rw)]
    return F.array(
        *[
            F.struct(F.lit(n).alias("part"), rx.alias("rx"), top.alias("ry"), rw.alias("rw"), high.alias("rh"))
            for n, top, high in squares
        ]
    )


def power_on_strips(x: Column, y: Column, w: Column, h: Column, frame_w: Column) -> Column:
    """Array of the four strips beside and inside the upper device edge."""
    # The shares of width and height below.
    ry, rh = y + int_of(h * 0.01), int_of(h * 0.052)
    inner = int_of(w * 0.12)
    strips = [
        ("left_out", F.lit(0).cast("bigint"), x),
        ("left_in", x + int_of(w * 0.14), inner),
        ("right_out", x + w, frame_w - (x + w)),
        ("right_in", x + int_of(w * 0.74), inner),
    ]
    return F.array(
        *[
            F.struct(F.lit(n).alias("part"), left.alias("rx"), ry.alias("ry"), wide.alias("rw"), rh.alias("rh"))
            for n, left, wide in strips
        ]
    )


# -------------------------------------------------------------------------- polygons
EDGE_ROWS_PER_CHUNK = 1 << 20


def fill_polygons(px: np.ndarray, py: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, row, first and last column of many filled integer polygons, outline included.

    Points of all polygons lie behind each other, ``counts`` per polygon.  Sorted edge
    crossings of a row pair up to inside spans; every edge adds the outline pixels it
    covers in the row; touching spans join.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    follow = np.arange(len(px)) + 1
    follow[ends - 1] = ends - counts
    ax, ay, bx, by = px, py, px[follow], py[follow]
    top, bottom = np.minimum(ay, by), np.maximum(ay, by)
    tall = bottom - top + 1
    e = np.repeat(np.arange(len(px)), tall)
    y = top[e] + np.arange(len(e)) - np.repeat(np.cumsum(tall) - tall, tall)
    slope = np.divide(bx - ax, by - ay, out=np.zeros(len(px)), where=by != ay)

    def x_at(row):
        return ax[e] + (row - ay[e]) * slope[e]

    level = (top == bottom)[e]
    upper, lower = x_at(np.maximum(y - 0.5, top[e])), x_at(np.minimum(y + 0.5, bottom[e]))
    left = np.where(level, np.minimum(ax, bx)[e], np.minimum(upper, lower))
    right = np.where(level, np.maximum(ax, bx)[e], np.maximum(upper, lower))
    # half-open edges: every row of a closed ring has an even number of crossings
    c = np.flatnonzero(~level & (y < bottom[e]))
    cx = x_at(y)[c]
    c, cx = (v[np.lexsort((cx, y[c], owner[e][c]))] for v in (c, cx))
    of = np.concatenate([owner[e], owner[e][c[0::2]]])
    row = np.concatenate([y, y[c[0::2]]])
    x0 = np.concatenate([np.rint(left), np.ceil(cx[0::2])]).astype(np.int64)
    x1 = np.concatenate([np.rint(right), np.floor(cx[1::2])]).astype(np.int64)
    keep = x1 >= x0
    of, row, x0, x1 = of[keep], row[keep], x0[keep], x1[keep]
    # one number line for all rows, with a gap between rows, so a running maximum joins spans
    min_x, min_y = int(px.min()), int(py.min())
    wide, high = int(px.max()) - min_x + 3, int(py.max()) - min_y + 1
    line = (of * high + row - min_y) * wide - min_x
    start, end = line + x0, line + x1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > end[:-1] + 1
    last = np.append(first[1:], True)
    line = start[first] // wide
    return line // high, line % high + min_y, start[first] % wide + min_x, end[last] % wide + min_x


def polygon_to_runs(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs (keys, y, x0, x1) of integer polygons ``points ARRAY<STRUCT<x,y>>``.

    Polygons are solved where they lie, many at a time, no shuffle; fewer than three
    points give no rows.
    """
    keys = list(keys)
    chosen = polygons.where(F.size("points") >= 3).select(
        *keys, F.transform("points", lambda p: p["x"]).alias("px"), F.transform("points", lambda p: p["y"]).alias("py")
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys = (np.asarray(batch.column(c).flatten(), np.int64) for c in ("px", "py"))
            counts = np.asarray(batch.column("px").value_lengths(), np.int64)
            starts = np.cumsum(counts) - counts
            work = np.cumsum(counts * (np.maximum.reduceat(ys, starts) - np.minimum.reduceat(ys, starts) + 1))
            chunk = work // EDGE_ROWS_PER_CHUNK
            for part in np.unique(chunk):
                chosen_rows = np.flatnonzero(chunk == part)
                lo, hi = chosen_rows[0], chosen_rows[-1]
                points = slice(starts[lo], starts[hi] + counts[hi])
                owner, y, x0, x1 = fill_polygons(xs[points], ys[points], counts[lo : hi + 1])
                columns = {k: batch.column(k).take(pa.array(owner + lo)) for k in keys}
                for name, values in zip(("y", "x0", "x1"), (y, x0, x1)):
                    columns[name] = pa.array(values.astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns)

    out = T.StructType(
        [chosen.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1")]
    )
    return chosen.mapInArrow(fill, out)


def bounds(points: Column) -> Column:
    """min_x, min_y, max_x, max_y of a point array."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")
    )
