"""Grey-value and mask operators on tiles: one Arrow row per tile, NumPy inside.

What depends on a pixel's level alone is worked out on the level table of its image (at most
256 rows, by the operators of ``gray`` and ``masks``) and applied by ``recode``; what combines
layers joins tiles, never pixels.  Layers that meet lie on the same tile grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators import gray, masks
from panescan.operators.focal import TILE_ARROW, _batched
from panescan.operators.raster import tile_array

IMAGE = ("image_id", "layer")
GRID = ("image_id", "ty", "tx")


def _each(tiles: DataFrame, change: Callable[[dict], bytes]) -> DataFrame:
    """Tiles whose levels are replaced by what ``change`` makes of a row; other columns of the row are inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (t for batch in batches for t in batch.to_pylist())
        yield from _batched({c: t[c] for c in TILE_ARROW.names} | {"px": change(t)} for t in rows)

    return tiles.mapInArrow(run, schema.TILE)


def histogram(tiles: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Exact count per level: at most 256 rows per tile before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                n = np.bincount(np.frombuffer(t["px"], np.uint8), minlength=256)
                levels = np.flatnonzero(n)
                columns = [pa.array([t[k]] * len(levels), batch.schema.field(k).type) for k in IMAGE]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(levels, pa.int32()), pa.array(n[levels], pa.int64())], [*IMAGE, "value", "n"])

    counted = tiles.select(*IMAGE, "px").mapInArrow(count, "image_id long, layer string, value int, n long")
    return counted.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def recode(tiles: DataFrame, levels: DataFrame, to: str, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Every level replaced by its image's entry in ``levels`` (keys, value, ``to``); a null entry drops the image's tiles."""
    table = levels.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("value").cast("int"), F.coalesce(F.col(to).cast("int"), F.lit(-1))))).alias("to"),
        F.bool_or(F.col(to).isNull()).alias("lost"),
    )

    def change(t: dict) -> bytes:
        lut = np.zeros(256, np.uint8)
        for value, new in t["to"]:
            lut[value] = new
        return lut[np.frombuffer(t["px"], np.uint8)].tobytes()

    return _each(tiles.join(table.where("not lost").drop("lost"), list(keys)), change)


def minmax_normalize(tiles: DataFrame) -> DataFrame:
    """Each image stretched to 0..255 in whole levels (half to even); a constant image becomes 0."""
    levels = histogram(tiles).withColumn("level", F.col("value"))
    to = gray.minmax_normalize(levels, IMAGE).select(*IMAGE, F.rint("value").alias("to"), F.col("level").alias("value"))
    return recode(tiles, to, "to")


def normalize_mask(tiles: DataFrame, variant: str, num_classes: int = 4) -> DataFrame:
    """``masks.normalize_mask`` on tiles: the rule runs over the levels; masks that stay invalid have no tiles."""
    return recode(tiles, masks.normalize_mask(histogram(tiles), variant, IMAGE, num_classes), "class_id")


def _beside(base: DataFrame, on: Sequence[str] = GRID, **layers: DataFrame) -> DataFrame:
    """Tiles with other layers' tiles at the same place as structs (null where there is none)."""
    for name, tiles in layers.items():
        piece = F.struct("y0", "x0", "h", "w", "px").alias(name)
        base = base.join(tiles.select(*on, piece), list(on), "left")
    return base


def _laid(t: dict, name: str) -> np.ndarray:
    """A layer's piece on the area of tile ``t``, 0 elsewhere; a piece may be smaller than its tile."""
    area, piece = np.zeros((t["h"], t["w"]), np.int16), t[name]
    if piece is not None:
        top, left = piece["y0"] - t["y0"], piece["x0"] - t["x0"]
        area[top : top + piece["h"], left : left + piece["w"]] = tile_array(piece["px"], piece["h"], piece["w"])
    return area


def _own(t: dict) -> np.ndarray:
    return tile_array(t["px"], t["h"], t["w"]).astype(np.int16)


def abs_diff(a: DataFrame, b: DataFrame, on: Sequence[str] = GRID) -> DataFrame:
    """Absolute difference of two layers that cover the same images; ``on`` has ``layer`` where each has several."""
    return _each(_beside(a, on, other=b), lambda t: np.abs(_own(t) - _laid(t, "other")).astype(np.uint8).tobytes())


def stacked_pixels(on: Sequence[str] = (*GRID, "layer"), **layers: DataFrame) -> DataFrame:
    """Pixels (image_id, layer, y, x) with a value column per named layer, out of tiles laid on each other."""
    base, *others = layers
    met = _beside(layers[base], on, **{n: layers[n] for n in others})
    columns = pa.schema([(c, TILE_ARROW.field(c).type) for c in IMAGE] + [(c, pa.int32()) for c in ("y", "x", *layers)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (t for batch in batches for t in batch.to_pylist()):
            n = t["h"] * t["w"]
            ys, xs = np.divmod(np.arange(n, dtype=np.int32), t["w"])
            levels = [_own(t), *(_laid(t, name) for name in others)]
            parts = [np.full(n, t["image_id"]), [t["layer"]] * n, ys + t["y0"], xs + t["x0"], *(a.ravel().astype(np.int32) for a in levels)]
            yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(parts, columns)], schema=columns)

    return met.mapInArrow(spread, "image_id long, layer string, " + ", ".join(f"{c} int" for c in ("y", "x", *layers)))


def superimpose(base: DataFrame, diff: DataFrame, cover: DataFrame, protect: DataFrame | None = None) -> DataFrame:
    """Subtract ``diff`` where ``cover`` is set (and ``protect`` is not), cut to 0..255."""
    guarded = protect is not None
    layers = {"diff": diff, "cover": cover} | ({"protect": protect} if guarded else {})

    def change(t: dict) -> bytes:
        on = _laid(t, "cover") > 0
        if guarded:
            on &= _laid(t, "protect") == 0
        return np.clip(_own(t) - _laid(t, "diff") * on, 0, 255).astype(np.uint8).tobytes()

    return _each(_beside(base, **layers), change)


def crop(tiles: DataFrame, x, y, w, h) -> DataFrame:
    """Half-open rectangle of numbers or columns, moved to the origin; tiles outside it are pruned unread.

    Border tiles are cut, so the pieces keep ``ty`` and ``tx`` of the tiles they come from.
    """
    c = F.col
    place = {"rx": x, "ry": y, "rw": w, "rh": h}
    inside = tiles.withColumns({n: gray.number(v).cast("int") for n, v in place.items()})
    inside = inside.where((c("x0") < c("rx") + c("rw")) & (c("x0") + c("w") > c("rx")) & (c("y0") < c("ry") + c("rh")) & (c("y0") + c("h") > c("ry")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for t in (t for batch in batches for t in batch.to_pylist()):
                top, left = max(t["y0"], t["ry"]), max(t["x0"], t["rx"])
                bottom, right = min(t["y0"] + t["h"], t["ry"] + t["rh"]), min(t["x0"] + t["w"], t["rx"] + t["rw"])
                px = tile_array(t["px"], t["h"], t["w"])[top - t["y0"] : bottom - t["y0"], left - t["x0"] : right - t["x0"]]
                moved = {"y0": top - t["ry"], "x0": left - t["rx"], "h": bottom - top, "w": right - left, "px": px.tobytes()}
                yield {n: t[n] for n in TILE_ARROW.names} | moved

        yield from _batched(pieces())

    return inside.mapInArrow(cut, schema.TILE)


def bright_line_flag(tiles: DataFrame, rects: DataFrame, delta: float = 50.0) -> DataFrame:
    """``gray.bright_line_flag``: tiles meet the rectangles of their image and send sums per row."""
    placed = rects.select("image_id", "rect_id", *[F.col(c).cast("int").alias(f"r{c}") for c in "xywh"])
    met = tiles.join(placed, "image_id").where("x0 < rx + rw and x0 + w > rx and y0 < ry + rh and y0 + h > ry and rw > 0 and rh > 0")
    rect_type = rects.schema["rect_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                top, left = max(t["y0"], t["ry"]), max(t["x0"], t["rx"])
                bottom, right = min(t["y0"] + t["h"], t["ry"] + t["rh"]), min(t["x0"] + t["w"], t["rx"] + t["rw"])
                part = tile_array(t["px"], t["h"], t["w"])[top - t["y0"] : bottom - t["y0"], left - t["x0"] : right - t["x0"]]
                rows = part.sum(1, dtype=np.int64).tolist()
                out += [{"image_id": t["image_id"], "rect_id": t["rect_id"], "y": top + i, "total": s, "n": right - left} for i, s in enumerate(rows)]
            types = [("image_id", pa.int64()), ("rect_id", batch.schema.field("rect_id").type), ("y", pa.int32()), ("total", pa.int64()), ("n", pa.int64())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(types))

    parts = met.mapInArrow(sums, f"image_id long, rect_id {rect_type}, y int, total long, n long")
    rows = parts.groupBy("image_id", "rect_id", "y").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return gray.bright_rows(rows, rects, delta)
