"""Overlap voting of patch predictions: pixel form and tile form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan import schema
from panescan.functions.scores import argmax


def legacy_probs(p: Column, num_classes: int = schema.CLASS_COUNT) -> Column:
    """A one-number patch score as class scores: 1-p background, p at index 1, 0 elsewhere."""
    return F.array(1 - p, p, *[F.lit(0.0)] * (num_classes - 2))


def vote_pixels(scores: DataFrame, frames: DataFrame | None = None, num_classes: int = schema.CLASS_COUNT) -> DataFrame:
    """Mean score and mean one-hot per class, cover count and winning class per pixel.

    ``scores``: image_id, y, x, probs, status.  Rows of failed patches do not vote and
    pixels beyond the frame are cut.  With ``frames`` (image_id, w, h) uncovered pixels
    come back with zero scores, count 1 and class 0.
    """
    valid = scores.where(F.coalesce("status", F.lit("ok")) == "ok")
    sums = valid.select("image_id", "y", "x", "probs", argmax(F.col("probs")).alias("c")).groupBy("image_id", "y", "x").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("probs")[i]).alias(f"s{i}") for i in range(num_classes)],
        *[F.sum((F.col("c") == i).cast("bigint")).alias(f"h{i}") for i in range(num_classes)],
    )
    if frames is not None:
        row, col = F.sequence(F.lit(0), F.col("h").cast("int") - 1), F.sequence(F.lit(0), F.col("w").cast("int") - 1)
        grid = frames.where("w > 0 and h > 0").select("image_id", F.explode(row).alias("y"), col.alias("xs"))
        grid = grid.select("image_id", "y", F.explode("xs").alias("x"))
        sums = grid.join(sums, ["image_id", "y", "x"], "left").na.fill(0).withColumn("n", F.greatest("n", F.lit(1)))
    means = sums.select(
        "image_id", "y", "x", "n",
        F.array(*[F.col(f"s{i}") / F.col("n") for i in range(num_classes)]).alias("probs"),
        F.array(*[F.col(f"h{i}") / F.col("n") for i in range(num_classes)]).alias("votes"),
    )
    return means.withColumn("class_id", argmax(F.col("probs")))


# ------------------------------------------------------------------------- tile form
SCORED = "image_id long, patch_id long, x0 int, y0 int, h int, w int, status string, probs binary"
VOTED = "image_id long, layer string, ty int, tx int, y0 int, x0 int, h int, w int, px binary, probs binary, cover binary"
_PIECE = pa.schema(
    [("image_id", pa.int64())] + [(c, pa.int32()) for c in ("ty", "tx", "y0", "x0", "h", "w", "fh", "fw")] + [("probs", pa.binary())]
)
_PIECE_DDL = "image_id long, ty int, tx int, y0 int, x0 int, h int, w int, fh int, fw int, probs binary"
_VOTED = pa.schema(
    [("image_id", pa.int64()), ("layer", pa.string())]
    + [(c, pa.int32()) for c in ("ty", "tx", "y0", "x0", "h", "w")]
    + [(c, pa.binary()) for c in ("px", "probs", "cover")]
)
BYTES_PER_BATCH, ROWS_PER_BATCH = 1 << 24, 4096


def _batched(rows: Iterator[dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches bounded by bytes, and by rows too: a row of a few bytes is a dict of a kilobyte until then."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 64
        if weight > BYTES_PER_BATCH or len(held) >= ROWS_PER_BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _scores(data: bytes, classes: int, h: int, w: int) -> np.ndarray:
    """Class-major scores; float32 or float64, as their bytes tell."""
    kind = np.float64 if len(data) == 8 * classes * h * w else np.float32
    return np.frombuffer(data, kind).reshape(classes, h, w)


def vote_tiles(scored: DataFrame, frames: DataFrame, tile: int, num_classes: int = schema.CLASS_COUNT) -> DataFrame:
    """Voted tiles of each frame: class map, mean scores (float32, class-major) and cover count.

    ``scored`` holds one row per patch with float32 or float64 scores (class-major); the vote is on what they
    are, and only the mean scores of the result are float32.  A patch is cut to
    the frame tiles it meets; a tile sums its pieces as they stream in, so its memory is one
    tile whatever the overlap.  ``frames``: image_id, h, w.
    """
    n_cls = num_classes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for p in batch.to_pylist():
                    fh, fw = p["fh"], p["fw"]
                    scores = _scores(p["probs"], n_cls, p["h"], p["w"])
                    y_end, x_end = min(p["y0"] + p["h"], fh), min(p["x0"] + p["w"], fw)
                    for ty in range(p["y0"] // tile, -(-y_end // tile)):
                        for tx in range(p["x0"] // tile, -(-x_end // tile)):
                            top, left = max(p["y0"], ty * tile), max(p["x0"], tx * tile)
                            bottom, right = min(y_end, ty * tile + tile), min(x_end, tx * tile + tile)
                            part = scores[:, top - p["y0"] : bottom - p["y0"], left - p["x0"] : right - p["x0"]]
                            yield {
                                "image_id": p["image_id"], "ty": ty, "tx": tx, "y0": top, "x0": left,
                                "h": bottom - top, "w": right - left, "fh": fh, "fw": fw, "probs": part.tobytes(),
                            }

        yield from _batched(pieces(), _PIECE)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles():
            rows = (r for batch in batches for r in batch.to_pylist())
            for (image_id, ty, tx), group in groupby(rows, key=itemgetter("image_id", "ty", "tx")):
                total = cover = None
                for r in group:
                    y0, x0 = ty * tile, tx * tile
                    if total is None:
                        h, w = min(tile, r["fh"] - y0), min(tile, r["fw"] - x0)
                        total, cover = np.zeros((n_cls, h, w), np.float64), np.zeros((h, w), np.int32)
                    if r["probs"] is None:
                        continue
                    area = np.s_[r["y0"] - y0 : r["y0"] - y0 + r["h"], r["x0"] - x0 : r["x0"] - x0 + r["w"]]
                    total[(slice(None), *area)] += _scores(r["probs"], n_cls, r["h"], r["w"])
                    cover[area] += 1
                cover = np.maximum(cover, 1)
                mean = total / cover
                yield {
                    "image_id": image_id, "layer": "pred", "ty": ty, "tx": tx, "y0": y0, "x0": x0, "h": h, "w": w,
                    "px": mean.argmax(axis=0).astype(np.uint8).tobytes(),
                    "probs": mean.astype(np.float32).tobytes(), "cover": cover.tobytes(),
                }

        yield from _batched(tiles(), _VOTED)

    fr = frames.where("w > 0 and h > 0").select("image_id", F.col("h").cast("int").alias("fh"), F.col("w").cast("int").alias("fw"))
    valid = scored.where(F.coalesce("status", F.lit("ok")) == "ok").join(fr, "image_id").where("x0 < fw and y0 < fh")
    pieces = valid.select("image_id", "x0", "y0", "h", "w", "probs", "fh", "fw").mapInArrow(cut, _PIECE_DDL)
    last = lambda c: F.floor((F.col(c) - 1) / tile).cast("int")
    zero = F.lit(0).cast("int")
    empty = (
        fr.select("*", F.explode(F.sequence(zero, last("fh"))).alias("ty"))
        .select("*", F.explode(F.sequence(zero, last("fw"))).alias("tx"))
        .select("image_id", "ty", "tx", zero.alias("y0"), zero.alias("x0"), zero.alias("h"), zero.alias("w"), "fh", "fw", F.lit(None).cast("binary").alias("probs"))
    )
    key = ["image_id", "ty", "tx"]
    return pieces.unionByName(empty).repartition(*key).sortWithinPartitions(*key).mapInArrow(combine, VOTED)


def pack_patches(pixels: DataFrame, num_classes: int = schema.CLASS_COUNT) -> DataFrame:
    """Score pixels (image_id, patch_id, y, x, probs) of full rectangular patches as patch rows; scores stay doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def patches():
            rows = (r for batch in batches for r in batch.to_pylist())
            for (image_id, patch_id), group in groupby(rows, key=itemgetter("image_id", "patch_id")):
                cells = list(group)  # one patch
                ys, xs = [c["y"] for c in cells], [c["x"] for c in cells]
                h, w = max(ys) - min(ys) + 1, max(xs) - min(xs) + 1
                scores = np.array([c["probs"] for c in cells], np.float64).reshape(h, w, num_classes)
                yield {
                    "image_id": image_id, "patch_id": patch_id, "x0": min(xs), "y0": min(ys), "h": h, "w": w,
                    "status": "ok", "probs": scores.transpose(2, 0, 1).tobytes(),
                }

        yield from _batched(patches(), _SCORED)

    key = ["image_id", "patch_id"]
    chosen = pixels.select("image_id", F.col("patch_id").cast("bigint").alias("patch_id"), "y", "x", "probs")
    return chosen.repartition(*key).sortWithinPartitions(*key, "y", "x").mapInArrow(pack, SCORED)


_SCORED = pa.schema(
    [("image_id", pa.int64()), ("patch_id", pa.int64())]
    + [(c, pa.int32()) for c in ("x0", "y0", "h", "w")]
    + [("status", pa.string()), ("probs", pa.binary())]
)
