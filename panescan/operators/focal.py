"""Neighbourhood filters on tiles with a halo.

Every tile sends the strips its neighbours need (rows = tiles, not pixels); each target
tile then meets at most a fixed number of pieces, whatever the image size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators import gray, raster
from panescan.operators.metrics import disc_half_widths
from panescan.session import cut_lineage

TILE_KEY = ("image_id", "layer", "ty", "tx")
TILE_ARROW = pa.schema(
    [("image_id", pa.int64()), ("layer", pa.string())]
    + [(c, pa.int32()) for c in ("ty", "tx", "y0", "x0", "h", "w")]
    + [("px", pa.binary())]
)

# --- fixed values: the 5-tap smoothing weights ------------------------------------------
BINOMIAL = np.array([1, 4, 6, 4, 1])


def footprint(size: int, shape: str) -> np.ndarray:
    """Square or elliptic window of odd ``size``."""
    if size % 2 == 0:
        raise ValueError("window size must be odd")
    if shape == "rect":
        return np.ones((size, size), bool)
    r = size // 2
    half = np.array(disc_half_widths(r))[:, None]
    return np.abs(np.arange(-r, r + 1))[None, :] <= half


def filter_array(padded: np.ndarray, h: int, w: int, stat: str, window: np.ndarray, rank: float = 0.5) -> np.ndarray:
    """Filter the (h, w) core of an array padded by the window radius."""
    offsets = np.argwhere(window)
    shifted = (padded[dy : dy + h, dx : dx + w] for dy, dx in offsets)
    if stat in ("min", "max"):
        pick = np.minimum if stat == "min" else np.maximum
        out = next(shifted).copy()
        for s in shifted:
            pick(out, s, out=out)
        return out
    if stat == "binomial":
        weights = np.outer(BINOMIAL, BINOMIAL)
        total = sum(weights[dy, dx] * padded[dy : dy + h, dx : dx + w].astype(np.int64) for dy, dx in offsets)
        return ((total + weights.sum() // 2) // weights.sum()).astype(np.uint8)
    if stat == "mean":
        total = np.zeros((h, w), np.int64)
        for s in shifted:
            total += s
        return np.floor(total / len(offsets) + 0.5).astype(np.uint8)
    n = len(offsets)
    k = n // 2 if stat == "median" else min(n - 1, int(n * rank))
    if n > 81 and window.all():
        return _rank_by_level(padded, h, w, window.shape[0], k)
    out = np.empty((h, w), np.uint8)
    band = max(1, (1 << 22) // (n * w))  # rows of windows in memory at once
    for top in range(0, h, band):
        rows = min(band, h - top)
        block = np.stack([padded[top + dy : top + dy + rows, dx : dx + w] for dy, dx in offsets])
        out[top : top + rows] = np.partition(block, k, axis=0)[k]
    return out


def _rank_by_level(padded: np.ndarray, h: int, w: int, size: int, k: int) -> np.ndarray:
    """k-th smallest of a large square window: cost grows with grey levels, not with the window."""
    out = np.zeros((h, w), np.uint8)
    open_cells = np.ones((h, w), bool)
    sums = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1), np.int32)
    for level in np.unique(padded):
        np.cumsum(np.cumsum(padded <= level, axis=0, dtype=np.int32), axis=1, out=sums[1:, 1:])
        below = sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]
        reached = open_cells & (below[:h, :w] > k)
        out[reached] = level
        open_cells &= ~reached
        if not open_cells.any():
            break
    return out


FRAMED = schema.TILE + ", fh int, fw int"
FRAMED_ARROW = pa.schema([*TILE_ARROW, ("fh", pa.int32()), ("fw", pa.int32())])


def with_frames(tiles: DataFrame, frame: tuple[int, int] | DataFrame) -> DataFrame:
    """Tiles with their image's height and width as ``fh`` and ``fw``.

    ``frame`` is a table (image_id, height, width), one row per image, or one size that all
    images share.  Images without a frame are an error: nothing may be cut or invented.
    """
    if isinstance(frame, DataFrame):
        sizes = frame.select("image_id", F.col("height").cast("int").alias("fh"), F.col("width").cast("int").alias("fw"))
        tiles = tiles.join(sizes, "image_id", "left")
    else:
        tiles = tiles.withColumns({"fh": F.lit(frame[0]), "fw": F.lit(frame[1])})
    inside = F.coalesce((F.col("y0") + F.col("h") <= F.col("fh")) & (F.col("x0") + F.col("w") <= F.col("fw")), F.lit(False))
    lost = F.raise_error(F.concat(F.lit("a tile lies outside the frame of image "), F.col("image_id").cast("string")))
    tiles = tiles.withColumn("fh", F.when(inside, F.col("fh")).otherwise(lost.cast("int")))
    return tiles.select(*TILE_ARROW.names, "fh", "fw")


def focal(tiles: DataFrame, size_px: int, frame: tuple[int, int] | DataFrame, stat: str, size: int, shape: str = "rect", rank: float = 0.5, border: str = "edge") -> DataFrame:
    """Filter a tiled layer; ``size_px`` is the tile edge, ``frame`` the images' sizes (``with_frames``).

    ``border`` is ``edge`` (replicate) or ``reflect``; ``binomial`` is the 5x5 smoothing.
    """
    margin = size // 2
    window = footprint(size, shape)
    reach = -(-margin // size_px)

    def pieces_of(t: dict) -> Iterator[dict]:
        a = raster.tile_array(t["px"], t["h"], t["w"])
        last_ty, last_tx = (t["fh"] - 1) // size_px, (t["fw"] - 1) // size_px
        for ty in range(max(0, t["ty"] - reach), min(last_ty, t["ty"] + reach) + 1):
            for tx in range(max(0, t["tx"] - reach), min(last_tx, t["tx"] + reach) + 1):
                top = max(0, ty * size_px - margin - t["y0"])
                bottom = min(t["h"], (ty + 1) * size_px + margin - t["y0"])
                left = max(0, tx * size_px - margin - t["x0"])
                right = min(t["w"], (tx + 1) * size_px + margin - t["x0"])
                if top < bottom and left < right:
                    yield {
                        "image_id": t["image_id"], "layer": t["layer"], "ty": ty, "tx": tx,
                        "y0": t["y0"] + top, "x0": t["x0"] + left, "h": bottom - top, "w": right - left,
                        "px": a[top:bottom, left:right].tobytes(), "fh": t["fh"], "fw": t["fw"],
                    }

    def filtered(key: tuple, pieces: Iterator[dict]) -> dict:
        image_id, layer, ty, tx = key
        y0, x0 = ty * size_px, tx * size_px
        first = next(pieces)
        height, width = first["fh"], first["fw"]
        h, w = min(size_px, height - y0), min(size_px, width - x0)
        top, left = max(0, y0 - margin), max(0, x0 - margin)
        bottom, right = min(height, y0 + h + margin), min(width, x0 + w + margin)
        area = np.zeros((bottom - top, right - left), np.uint8)
        for p in chain([first], pieces):
            area[p["y0"] - top : p["y0"] - top + p["h"], p["x0"] - left : p["x0"] - left + p["w"]] = raster.tile_array(p["px"], p["h"], p["w"])
        pads = ((top - (y0 - margin), y0 + h + margin - bottom), (left - (x0 - margin), x0 + w + margin - right))
        done = filter_array(np.pad(area, pads, mode=border), h, w, stat, window, rank)
        return {"image_id": image_id, "layer": layer, "ty": ty, "tx": tx, "y0": y0, "x0": x0, "h": h, "w": w, "px": done.tobytes()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (t for batch in batches for t in batch.to_pylist())
        yield from _batched((p for t in rows for p in pieces_of(t)), FRAMED_ARROW)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (p for batch in batches for p in batch.to_pylist())
        yield from _batched(filtered(key, pieces) for key, pieces in groupby(rows, key=itemgetter(*TILE_KEY)))

    # pieces of one target tile lie next to each other after the sort, so tiles stream through
    met = with_frames(tiles, frame).mapInArrow(send, FRAMED).repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    return met.mapInArrow(combine, schema.TILE)


def _batched(rows: Iterator[dict], arrow: pa.Schema = TILE_ARROW) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row["px"])
        if weight > 1 << 22 or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def opened(tiles: DataFrame, size_px: int, frame, size: int, shape: str = "rect") -> DataFrame:
    return focal(focal(tiles, size_px, frame, "min", size, shape), size_px, frame, "max", size, shape)


def closed(tiles: DataFrame, size_px: int, frame, size: int, shape: str = "rect") -> DataFrame:
    return focal(focal(tiles, size_px, frame, "max", size, shape), size_px, frame, "min", size, shape)


def extract_defect_masks(tiles: DataFrame, size_px: int, frame, background: int = 51, label_variant: bool = False) -> DataFrame:
    """Pixels (image_id, layer, y, x) with ``diff`` and the ``low`` and ``high`` defect masks.

    Background: dilate 5, median, then for samples close 5 (disc) and smooth 5.  The
    difference to the image is stretched per image and smoothed; its Otsu level t gives
    ``high``; ``low`` uses t-10 and grows by 3.  The label variant marks ``high`` above
    max(15, t-40) and has no ``low``.  A 3x3 median takes the place of the
    edge-preserving filter on samples.
    """
    from panescan.operators import tiles as on_tiles  # that module builds on this one

    place, image = ("image_id", "layer", "ty", "tx"), ["image_id", "layer"]
    back = focal(focal(tiles, size_px, frame, "max", 5), size_px, frame, "median", background)
    if not label_variant:
        back = closed(back, size_px, frame, 5, "disc")
        back = focal(back, size_px, frame, "binomial", 5, border="reflect")
    gap = cut_lineage(on_tiles.abs_diff(tiles, back, place))  # used three times, like ``smooth``
    packed = on_tiles.minmax_normalize(gap)
    if label_variant:
        smooth = cut_lineage(focal(packed, size_px, frame, "binomial", 5, border="reflect"))
    else:
        smooth = cut_lineage(focal(packed, size_px, frame, "median", 3))
    counts = on_tiles.histogram(smooth)
    levels = counts.join(gray.otsu_threshold(counts, image), image)
    t, v = F.col("threshold"), F.col("value")

    def above(level) -> DataFrame:
        return on_tiles.recode(smooth, levels.withColumn("to", (v > level).cast("int")), "to")

    if label_variant:
        return on_tiles.stacked_pixels(place, high=above(F.greatest(F.lit(15), t - 40)), diff=gap)
    low = focal(above(t - 10), size_px, frame, "max", 3)
    return on_tiles.stacked_pixels(place, high=above(t), low=low, diff=gap)
