"""Raster forms and the row sweep.

``sweep`` is the work horse for class masks: runs become +/- events along a row and
running sums turn them into segments.  Overlays, unions, intersections, dilation and
region overlap all cost one shuffle on (image, row) and O(n log n) per row; no range
join and no pair list.  A row is bounded by the frame width, so a single huge image
still spreads over as many tasks as it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panescan import schema

ROW = ("image_id", "layer", "y")


# ---------------------------------------------------------------- sweep primitives
def run_events(runs: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    """Two events per run: ``+measure`` at ``x0`` and ``-measure`` behind ``x1``."""
    start = F.struct(F.col("x0").cast("int").alias("x"), *[m.alias(n) for n, m in measures.items()])
    end = F.struct(
        (F.col("x1") + 1).cast("int").alias("x"), *[(-m).alias(n) for n, m in measures.items()]
    )
    return runs.select(*keys, F.inline(F.array(start, end)))


def sweep(events: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Segments ``keys, x0, x1, measures`` with the running sum of every measure."""
    order = Window.partitionBy(*keys).orderBy("x")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    segments = events.select(
        *keys,
        F.col("x").alias("x0"),
        (F.lead("x").over(order) - 1).alias("x1"),
        *[F.sum(m).over(upto).alias(m) for m in measures],
    )
    return segments.where("x1 >= x0")


def length() -> Column:
    return (F.col("x1") - F.col("x0") + 1).cast("bigint")


# ------------------------------------------------------------------- form changes
def pixels_to_runs(pixels: DataFrame, keys: Sequence[str] = ("image_id", "layer")) -> DataFrame:
    """Maximal runs of equal value along each row; one shuffle, one sort."""
    row = [*keys, "y"]
    order = Window.partitionBy(*row).orderBy("x")
    before = F.struct(F.lag("x").over(order).alias("x"), F.lag("value").over(order).alias("v"))
    after = F.struct(F.lead("x").over(order).alias("x"), F.lead("value").over(order).alias("v"))
    marked = pixels.select(*row, "x", "value", before.alias("b"), after.alias("a")).select(
        *row,
        "x",
        "value",
        (~F.coalesce((F.col("b.x") == F.col("x") - 1) & (F.col("b.v") == F.col("value")), F.lit(False))).alias("first"),
        (~F.coalesce((F.col("a.x") == F.col("x") + 1) & (F.col("a.v") == F.col("value")), F.lit(False))).alias("last"),
    )
    ends = marked.where("first or last")
    return (
        ends.withColumn("x1", F.when(F.col("last"), F.col("x")).otherwise(F.lead("x").over(order)))
        .where("first")
        .select(*keys, F.col("value").cast("int").alias("class_id"), "y", F.col("x").alias("x0"), "x1")
    )


def coalesce_runs(runs: DataFrame, keys: Sequence[str] = ("image_id", "layer")) -> DataFrame:
    """Join neighbouring runs of one class; runs of a row must not overlap."""
    row = [*keys, "y"]
    order = Window.partitionBy(*row).orderBy("x0")
    joins_before = (F.lag("x1").over(order) == F.col("x0") - 1) & (F.lag("class_id").over(order) == F.col("class_id"))
    joins_after = (F.lead("x0").over(order) == F.col("x1") + 1) & (F.lead("class_id").over(order) == F.col("class_id"))
    ends = runs.select(
        *row,
        "class_id",
        "x0",
        "x1",
        (~F.coalesce(joins_before, F.lit(False))).alias("first"),
        (~F.coalesce(joins_after, F.lit(False))).alias("last"),
    ).where("first or last")
    return (
        ends.withColumn("x1", F.when(F.col("last"), F.col("x1")).otherwise(F.lead("x1").over(order)))
        .where("first")
        .select(*keys, "class_id", "y", "x0", "x1")
    )


def runs_to_pixels(runs: DataFrame, keys: Sequence[str] = ("image_id", "layer")) -> DataFrame:
    return runs.select(
        *keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.col("class_id").alias("value")
    )


def pixels_to_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Pack full rectangular pixel blocks into row-major ``uint8`` tiles (at most size*size rows per group)."""
    grouped = (
        pixels.withColumn("ty", (F.col("y") / size).cast("int"))
        .withColumn("tx", (F.col("x") / size).cast("int"))
        .groupBy("image_id", "layer", "ty", "tx")
        .agg(
            F.min("y").cast("int").alias("y0"),
            F.min("x").cast("int").alias("x0"),
            (F.max("y") - F.min("y") + 1).cast("int").alias("h"),
            (F.max("x") - F.min("x") + 1).cast("int").alias("w"),
            F.array_sort(F.collect_list(F.struct("y", "x", F.col("value").cast("int").alias("v")))).alias("cells"),
        )
    )
    hexed = F.concat_ws("", F.transform("cells", lambda c: F.lpad(F.hex(c["v"]), 2, "0")))
    return grouped.select("image_id", "layer", "ty", "tx", "y0", "x0", "h", "w", F.unhex(hexed).alias("px"))


def tile_array(px: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(px, dtype=np.uint8).reshape(h, w)


ROWS_PER_BATCH = 1 << 18


def _emit(pieces: list[tuple], names: list[str]) -> pa.RecordBatch:
    """One batch out of per-tile pieces (image_id, layer, columns...)."""
    sizes = np.array([len(p[2]) for p in pieces])
    columns = {
        "image_id": pa.array(np.repeat(np.array([p[0] for p in pieces], np.int64), sizes)),
        "layer": pa.array(np.repeat(np.array([p[1] for p in pieces], object), sizes), pa.string()),
    }
    for i, name in enumerate(names, start=2):
        columns[name] = pa.array(np.concatenate([p[i] for p in pieces]).astype(np.int32))
    return pa.RecordBatch.from_pydict(columns)


def _expand_tiles(batches: Iterator[pa.RecordBatch], cells, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Apply ``cells(tile) -> column arrays`` and emit batches of bounded size."""
    held, rows = [], 0
    for batch in batches:
        for t in batch.to_pylist():
            held.append((t["image_id"], t["layer"], *cells(t)))
            rows += len(held[-1][2])
            if rows >= ROWS_PER_BATCH:
                yield _emit(held, names)
                held, rows = [], 0
    if held:
        yield _emit(held, names)


def _cells_of(t: dict) -> tuple:
    h, w = t["h"], t["w"]
    return np.repeat(np.arange(h), w) + t["y0"], np.tile(np.arange(w), h) + t["x0"], np.frombuffer(t["px"], np.uint8)


def _tile_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _expand_tiles(batches, _cells_of, ["y", "x", "value"])


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    return tiles.mapInArrow(_tile_cells, "image_id long, layer string, y int, x int, value int")


def _runs_of(t: dict) -> tuple:
    a = tile_array(t["px"], t["h"], t["w"])
    first = np.ones(a.shape, bool)
    first[:, 1:] = a[:, 1:] != a[:, :-1]
    last = np.ones(a.shape, bool)
    last[:, :-1] = first[:, 1:]
    ys, xs = np.nonzero(first)
    return a[ys, xs], ys + t["y0"], xs + t["x0"], np.nonzero(last)[1] + t["x0"]


def _tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _expand_tiles(batches, _runs_of, ["class_id", "y", "x0", "x1"])


def tiles_to_runs(tiles: DataFrame) -> DataFrame:
    """Per-tile run detection without exploding pixels, then joined over tile borders."""
    return coalesce_runs(tiles.mapInArrow(_tile_runs, schema.RUN))


# ----------------------------------------------------------------- overlay of layers
def overlay(runs: DataFrame, left: str, right: str, value: str = "class_id") -> DataFrame:
    """Full outer pixel alignment of two layers: segments with both values, 0 where a layer has no run."""
    is_left, is_right = F.col("layer") == left, F.col("layer") == right
    events = run_events(
        runs.where(is_left | is_right),
        ("image_id", "y"),
        a=F.when(is_left, F.col(value)).otherwise(F.lit(0)).cast("bigint"),
        b=F.when(is_right, F.col(value)).otherwise(F.lit(0)).cast("bigint"),
    )
    return sweep(events, ("image_id", "y"), ("a", "b"))
