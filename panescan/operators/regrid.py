"""Operators that move cells between tile grids: resize, downscale, paste, palette and the augmentation chain.

Every source tile works out by index arithmetic which target tiles its cells fall into and sends
each of them one part; a target tile adds up its parts as they stream in.  Tiles travel, pixels do
not, and neither grid needs to divide the other.  A large image spreads over its tiles.

Area means are sums of whole numbers: source and target cells are measured in the units in which
both have whole lengths, so parts of a cell that lie in several tiles add up exactly, in any order.
Target tiles that no source tile reaches have no row, and cells without a source are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby
from math import gcd
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan import schema
from panescan.functions.hashing import uniform
from panescan.operators import gray
from panescan.operators.focal import TILE_ARROW, TILE_KEY, _batched, with_frames
from panescan.operators.raster import tile_array
from panescan.operators.tiles import GRID, _beside, _laid

Size = tuple[int | Column, int | Column] | DataFrame

PART = schema.TILE + ", ch int, cw int, unit long"
PART_ARROW = pa.schema([*TILE_ARROW, ("ch", pa.int32()), ("cw", pa.int32()), ("unit", pa.int64())])


def _given(tiles: DataFrame, values: Sequence | DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds whole numbers as ``names``: numbers or columns for all tiles, or ``columns`` of a table with one row per image."""
    if not isinstance(values, DataFrame):
        return tiles.withColumns({n: gray.number(v).cast("int") for n, v in zip(names, values)})
    return tiles.join(values.select("image_id", *[F.col(c).cast("int").alias(n) for c, n in zip(columns, names)]), "image_id")


def _cells(lo: int, hi: int, size_px: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Tile number, first and last bound of what [lo, hi) has in each tile of a canvas of length ``end``."""
    lo, hi = max(lo, 0), min(hi, end)
    for k in range(lo // size_px, -(-hi // size_px) if hi > lo else 0):
        yield k, max(lo, k * size_px), min(hi, (k + 1) * size_px)


def _exchange(tiles: DataFrame, size_px: int, parts: Callable[[dict], Iterator[dict]], finish: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Parts sent by source tiles, added up per target tile and divided by their unit, halves up."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (t for batch in batches for t in batch.to_pylist())
        yield from _batched((p for t in rows for p in parts(t)), PART_ARROW)

    def whole(key: tuple, group: Iterator[dict]) -> dict:
        first = next(group)
        y0, x0, unit = key[2] * size_px, key[3] * size_px, first["unit"]
        h, w = min(size_px, first["ch"] - y0), min(size_px, first["cw"] - x0)
        total = np.zeros((h, w), np.int64)
        for p in chain([first], group):
            n = p["h"] * p["w"]
            sums = np.frombuffer(p["px"], f"<u{len(p['px']) // n}").reshape(p["h"], p["w"])
            total[p["y0"] - y0 : p["y0"] - y0 + p["h"], p["x0"] - x0 : p["x0"] - x0 + p["w"]] += sums.astype(np.int64)
        levels = (2 * total + unit) // (2 * unit)
        levels = levels if finish is None else finish(levels)
        return dict(zip(TILE_ARROW.names, (*key, y0, x0, h, w, levels.astype(np.uint8).tobytes())))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (p for batch in batches for p in batch.to_pylist())
        yield from _batched(whole(key, group) for key, group in groupby(rows, key=itemgetter(*TILE_KEY)))

    # parts of one target tile lie next to each other after the sort, so tiles stream through
    met = tiles.mapInArrow(send, PART).repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    return met.mapInArrow(combine, schema.TILE)


def _part(t: dict, ty: int, tx: int, top: int, left: int, cells: np.ndarray, unit: int = 1) -> dict:
    place = {"ty": ty, "tx": tx, "y0": top, "x0": left, "h": cells.shape[0], "w": cells.shape[1]}
    return {"image_id": t["image_id"], "layer": t["layer"], **place, "px": cells.tobytes(), "ch": t["ch"], "cw": t["cw"], "unit": unit}


# ------------------------------------------------------------------------------ resizing
class _Axis:
    """One axis of a resize from ``n`` source to ``m`` target cells, for the source cells [s0, s1) of a tile."""

    def __init__(self, n: int, m: int, s0: int, s1: int):
        self.n, self.m, self.s0, self.s1 = n, m, s0, s1
        shared = gcd(n, m) or 1
        self.of_source, self.of_target = m // shared, n // shared  # lengths of a cell in common units

    def reached(self, area: bool) -> tuple[int, int]:
        """Target cells that take something from the tile."""
        if self.n == 0 or self.m == 0:
            return 0, 0
        lo = self.s0 * self.m // self.n if area else -(-self.s0 * self.m // self.n)
        return lo, min(self.m, -(-self.s1 * self.m // self.n))

    def picked(self, lo: int, hi: int) -> np.ndarray:
        """Nearest: place in the tile of the source cell that each target cell reads."""
        return np.arange(lo, hi) * self.n // self.m - self.s0

    def weights(self, lo: int, hi: int) -> tuple[slice, np.ndarray]:
        """Area: the tile's source cells under [lo, hi) and their share of every target cell, in common units."""
        first = max(self.s0, lo * self.of_target // self.of_source)
        last = min(self.s1, -(-hi * self.of_target // self.of_source))
        s, t = np.arange(first, last)[None, :], np.arange(lo, hi)[:, None]
        shared = np.minimum((s + 1) * self.of_source, (t + 1) * self.of_target) - np.maximum(s * self.of_source, t * self.of_target)
        return slice(first - self.s0, last - self.s0), np.maximum(shared, 0).astype(np.float64)


def _resized(t: dict, size_px: int, area: bool) -> Iterator[dict]:
    """Parts of a tile of an image of sh x sw cells that becomes th x tw and lies at (oy, ox) of a ch x cw canvas."""
    a = tile_array(t["px"], t["h"], t["w"])
    ys, xs = _Axis(t["sh"], t["th"], t["y0"], t["y0"] + t["h"]), _Axis(t["sw"], t["tw"], t["x0"], t["x0"] + t["w"])
    (top, bottom), (left, right) = ys.reached(area), xs.reached(area)
    unit = ys.of_target * xs.of_target if area else 1
    width = next(b for b in (1, 2, 4, 8) if 255 * unit < 1 << 8 * b)
    oy, ox = t["oy"], t["ox"]
    for ty, u, d in _cells(top + oy, bottom + oy, size_px, t["ch"]):
        for tx, v, r in _cells(left + ox, right + ox, size_px, t["cw"]):
            if area:  # products of whole numbers below 2**53 are exact in doubles
                rows, by_row = ys.weights(u - oy, d - oy)
                columns, by_column = xs.weights(v - ox, r - ox)
                cells = by_row @ a[rows, columns] @ by_column.T
            else:
                cells = a[ys.picked(u - oy, d - oy)[:, None], xs.picked(v - ox, r - ox)[None, :]]
            yield _part(t, ty, tx, u, v, cells.astype(f"<u{width}"), unit)


def resize_array(a: np.ndarray, h: int, w: int, how: str) -> np.ndarray:
    """What ``resize`` makes of one whole image, for images small enough to lie in one row."""
    ys, xs = _Axis(a.shape[0], h, 0, a.shape[0]), _Axis(a.shape[1], w, 0, a.shape[1])
    if a.shape == (h, w):
        return a
    if how == "nearest":
        return a[ys.picked(0, h)[:, None], xs.picked(0, w)[None, :]]
    (_, by_row), (_, by_column) = ys.weights(0, h), xs.weights(0, w)
    unit = ys.of_target * xs.of_target
    return ((2 * (by_row @ a @ by_column.T).astype(np.int64) + unit) // (2 * unit)).astype(np.uint8)


def _resize(placed: DataFrame, size_px: int, area: bool, finish=None) -> DataFrame:
    return _exchange(placed, size_px, lambda t: _resized(t, size_px, area), finish)


def resize(tiles: DataFrame, frame: tuple[int, int] | DataFrame, target: Size, size_px: int, how: str = "nearest") -> DataFrame:
    """Images of size ``frame`` brought to ``target``, as tiles of edge ``size_px``.

    ``frame`` as in ``focal.with_frames``.  ``target`` is (height, width) as numbers or columns
    of ``image_id``, ``fh`` and ``fw`` (the image's own size), or a table (image_id, height, width);
    an image without a target has no tiles.  ``nearest`` is for masks: row i reads row floor(i*h/H).
    ``area`` is the exact mean over the cell's part of the image, in whole levels, halves up, for
    growing as for shrinking.
    """
    if how not in ("nearest", "area"):
        raise ValueError(f"unknown resize: {how}")
    sized = _given(with_frames(tiles, frame), target, ("height", "width"), ("th", "tw"))
    placed = sized.withColumns({"sh": F.col("fh"), "sw": F.col("fw"), "oy": F.lit(0), "ox": F.lit(0), "ch": F.col("th"), "cw": F.col("tw")})
    return _resize(placed, size_px, how == "area")


def downscale(tiles: DataFrame, frame: tuple[int, int] | DataFrame, factor: int, size_px: int) -> DataFrame:
    """Area mean by a whole factor, in whole levels, halves up; a remainder row or column is cut off."""
    sized = with_frames(tiles, frame)
    for cut, (full, small) in {"sh": ("fh", "th"), "sw": ("fw", "tw")}.items():
        sized = sized.withColumn(small, F.floor(F.col(full) / factor).cast("int")).withColumn(cut, F.col(small) * factor)
    placed = sized.withColumns({"oy": F.lit(0), "ox": F.lit(0), "ch": F.col("th"), "cw": F.col("tw")})
    return _resize(placed, size_px, True)


def paste(tiles: DataFrame, frame: tuple[int, int] | DataFrame, rect: Sequence | DataFrame, canvas: Size, size_px: int, how: str = "nearest") -> DataFrame:
    """Masks of size ``frame`` resized to their rectangle on a canvas, cut at its border and made 0/1.

    ``rect`` is (x, y, w, h) or a table (image_id, x, y, w, h); images without a rectangle are not
    pasted.  ``canvas`` is its size like the target of ``resize``.  With ``area`` a cell is set
    where the mean of its levels does not round to 0.  Tiles that the rectangle misses have no row.
    """
    sized = _given(with_frames(tiles, frame), rect, ("x", "y", "w", "h"), ("ox", "oy", "tw", "th"))
    placed = _given(sized, canvas, ("height", "width"), ("ch", "cw")).withColumns({"sh": F.col("fh"), "sw": F.col("fw")})
    return _resize(placed, size_px, how == "area", lambda levels: levels > 0)


# ---------------------------------------------------------------------------- palette
def palette_to_class(red: DataFrame, green: DataFrame, blue: DataFrame, device: DataFrame | None = None) -> DataFrame:
    """``masks.palette_to_class`` on tiles of the three channels, all on one grid and of equal size per tile.

    Cells of other colours, and cells where ``device`` is 0 or has no tile, become 0.
    """
    palette = np.array([(r << 16 | g << 8 | b, c) for r, g, b, _, c in schema.PALETTE])
    codes, classes = palette[np.argsort(palette[:, 0])].T
    names = {"green": green, "blue": blue} | ({"device": device} if device is not None else {})
    met = _beside(red, GRID, **names).where("green is not null and blue is not null")
    guarded = device is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def classed():
            for t in (t for batch in batches for t in batch.to_pylist()):
                code = tile_array(t["px"], t["h"], t["w"]).astype(np.int32) << 16
                code |= _laid(t, "green").astype(np.int32) << 8 | _laid(t, "blue")
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                out = np.where(codes[at] == code, classes[at], 0)
                if guarded:
                    out = out * (_laid(t, "device") > 0)
                yield {n: t[n] for n in TILE_ARROW.names} | {"px": out.astype(np.uint8).tobytes()}

        yield from _batched(classed())

    return met.mapInArrow(run, schema.TILE)


# ------------------------------------------------------------------------- augmentation
TURNS = ("hflip", "vflip", "rot90", "transpose")
Step = tuple[str, float]  # operation, chance


def with_draws(images: DataFrame, steps: Sequence[Step], seed: int, limit: float = 0.2) -> DataFrame:
    """Adds what the drawn steps of an image make together, a function of seed, step and ``image_id`` alone.

    A step is (``hflip``, ``vflip``, ``rot90``, ``transpose`` or ``levels``, chance).  The turns make one
    symmetry of the square: transpose first if ``turned``, then mirror rows if ``mirror_y`` and columns if
    ``mirror_x``.  ``levels`` draws brightness and contrast in +-``limit``; ``tones`` lists them step by
    step, 0 where not drawn.
    """
    turned = mirror_y = mirror_x = F.lit(False)
    tones = []
    for i, (op, chance) in enumerate(steps):
        draw = lambda what: uniform(seed, F.lit(what), F.lit(i), F.col("image_id"))  # noqa: B023, E731
        hit = draw(op) < chance
        if op == "levels":
            tones += [F.when(hit, draw(n) * (2 * limit) - limit).otherwise(F.lit(0.0)) for n in ("brightness", "contrast")]
        elif op == "hflip":
            mirror_x = mirror_x != hit
        elif op == "vflip":
            mirror_y = mirror_y != hit
        elif op in TURNS:  # a transposition swaps the mirrors; the quarter turn mirrors the rows after it
            swapped = F.when(hit, mirror_x).otherwise(mirror_y), F.when(hit, mirror_y).otherwise(mirror_x)
            turned, (mirror_y, mirror_x) = turned != hit, swapped
            mirror_y = mirror_y != hit if op == "rot90" else mirror_y
        else:
            raise ValueError(f"unknown step: {op}")
    tone = F.array(*tones) if tones else F.array().cast("array<double>")
    return images.withColumns({"turned": turned, "mirror_y": mirror_y, "mirror_x": mirror_x, "tones": tone})


def augmented_frames(frames: DataFrame, steps: Sequence[Step], seed: int) -> DataFrame:
    """Sizes (image_id, height, width) after the chain."""
    drawn = with_draws(frames, steps, seed)
    swap = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a)
    return drawn.select("image_id", swap("height", "width"), swap("width", "height"))


def augment(tiles: DataFrame, frame: tuple[int, int] | DataFrame, steps: Sequence[Step], seed: int, size_px: int, limit: float = 0.2) -> DataFrame:
    """A chain of augmentation steps, each drawn per image with its own chance, in one move and one level table.

    Levels change by v*(1+contrast) + 255*brightness, cut to 0..255 and rounded (half to even) after each step.
    All layers of an image are turned alike; a mask that must keep its classes takes a chain without
    ``levels`` at the same places: a step of chance 0 keeps the numbering of the others.
    """
    drawn = with_draws(with_frames(tiles, frame), steps, seed, limit)

    def moved(t: dict) -> Iterator[dict]:
        lut = np.arange(256.0)
        for brightness, contrast in zip(t["tones"][::2], t["tones"][1::2]):
            lut = np.rint(np.clip(lut * (1 + contrast) + 255 * brightness, 0, 255))
        a = lut.astype(np.uint8)[tile_array(t["px"], t["h"], t["w"])]
        y0, x0, ch, cw = t["y0"], t["x0"], t["fh"], t["fw"]
        if t["turned"]:
            a, y0, x0, ch, cw = a.T, x0, y0, cw, ch
        if t["mirror_y"]:
            a, y0 = a[::-1], ch - y0 - a.shape[0]
        if t["mirror_x"]:
            a, x0 = a[:, ::-1], cw - x0 - a.shape[1]
        t = t | {"ch": ch, "cw": cw}
        for ty, u, d in _cells(y0, y0 + a.shape[0], size_px, ch):
            for tx, v, r in _cells(x0, x0 + a.shape[1], size_px, cw):
                yield _part(t, ty, tx, u, v, a[u - y0 : d - y0, v - x0 : r - x0])

    return _exchange(drawn, size_px, moved)
