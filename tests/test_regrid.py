"""Tile re-gridding against dense NumPy, over grids that do not divide each other."""

import numpy as np
import pytest
from helpers import dense, pixel_rows
from pyspark.sql import functions as F

from panescan import schema
from panescan.functions.hashing import uniform
from panescan.operators import raster, regrid

RNG = np.random.default_rng(41)
SHAPES = [(1, 1), (7, 5), (16, 9), (31, 40)]


def laid(spark, arrays, edge, layer="g"):
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(i, layer): a for i, a in arrays.items()}), edge)
    frames = spark.createDataFrame([(i, *a.shape) for i, a in arrays.items()], "image_id long, height int, width int")
    return tiles, frames


def images(low=0, high=256):
    return {i: RNG.integers(low, high, s) for i, s in enumerate(SHAPES)}


def seen(tiles, image_id, shape):
    return dense(raster.tiles_to_pixels(tiles).where(F.col("image_id") == image_id), shape)


def share(n, m):
    """Share of every source cell in every target cell, in units of 1/(n*m)."""
    out = np.zeros((m, n), object)
    for t in range(m):
        for s in range(n):
            out[t, s] = max(0, min((s + 1) * m, (t + 1) * n) - max(s * m, t * n))
    return out


def area(a, h, w):
    unit = a.shape[0] * a.shape[1]
    total = share(a.shape[0], h).dot(a.astype(object)).dot(share(a.shape[1], w).T)
    return np.array([[(2 * int(v) + unit) // (2 * unit) for v in row] for row in total], int).reshape(h, w)


def nearest(a, h, w):
    return a[np.arange(h)[:, None] * a.shape[0] // h, np.arange(w)[None, :] * a.shape[1] // w]


@pytest.mark.parametrize("target", [(5, 3), (13, 50), (31, 40), (1, 1)])
@pytest.mark.parametrize("edges", [(4, 7), (64, 5), (5, 64)])
def test_resize(spark, target, edges):
    arrays = images()
    tiles, frames = laid(spark, arrays, edges[0])
    for how, brute in (("nearest", nearest), ("area", area)):
        out = regrid.resize(tiles, frames, target, edges[1], how).cache()
        for i, a in arrays.items():
            assert (seen(out, i, target) == brute(a, *target)).all(), (how, i)
        assert {(r["h"], r["w"]) for r in out.where("ty = 0 and tx = 0").collect()} == {(min(target[0], edges[1]), min(target[1], edges[1]))}
        assert out.count() == out.select("image_id", "ty", "tx").distinct().count()


def test_resize_to_nothing_and_without_target(spark):
    tiles, frames = laid(spark, images(), 4)
    assert regrid.resize(tiles, frames, (0, 3), 4).count() == 0
    assert regrid.resize(tiles, frames, frames.where("image_id = 1"), 4).select("image_id").distinct().collect() == [(1,)]
    assert regrid.resize(tiles.limit(0), frames, (3, 3), 4, "area").count() == 0
    with pytest.raises(ValueError, match="unknown resize"):
        regrid.resize(tiles, frames, (3, 3), 4, "cubic")


@pytest.mark.parametrize("factor", [1, 2, 3, 25])
def test_downscale(spark, factor):
    arrays = images()
    tiles, frames = laid(spark, arrays, 7)
    out = regrid.downscale(tiles, frames, factor, 4).cache()
    for i, a in arrays.items():
        h, w = a.shape[0] // factor, a.shape[1] // factor
        whole = a[: h * factor, : w * factor].reshape(h, factor, w, factor).mean(axis=(1, 3))
        assert (seen(out, i, (h, w)) == np.floor(whole + 0.5)).all()


@pytest.mark.parametrize("how", ["nearest", "area"])
def test_paste_is_cut_at_the_canvas(spark, how):
    arrays = {i: a * 255 for i, a in images(0, 2).items()}
    tiles, frames = laid(spark, arrays, 4)
    rects = {0: (2, 3, 4, 4), 1: (-3, -2, 9, 8), 2: (8, 9, 11, 13), 3: (40, 0, 3, 3)}
    table = spark.createDataFrame([(i, *r) for i, r in rects.items()], "image_id long, x int, y int, w int, h int")
    out = regrid.paste(tiles, frames, table, (17, 13), 5, how).cache()
    for i, (x, y, w, h) in rects.items():
        sized = (nearest if how == "nearest" else area)(arrays[i], h, w) > 0
        canvas = np.zeros((100, 100), int)
        canvas[30 + y : 30 + y + h, 30 + x : 30 + x + w] = sized
        assert (seen(out, i, (17, 13)) == canvas[30:47, 30:43]).all(), i
    assert out.where("image_id = 3").count() == 0


def test_palette_colours(spark):
    known = [(r, g, b) for r, g, b, _, _ in schema.PALETTE]
    near = [(r ^ 1, g, b) for r, g, b in known] + [(0, 0, 0), (255, 255, 255)]
    picks = np.array(known + near)
    at = RNG.integers(0, len(picks), (9, 11))
    r, g, b = (laid(spark, {1: picks[at][..., c]}, 4)[0] for c in range(3))
    device = np.zeros((9, 11), int)
    device[2:, 3:] = 255
    wanted = np.array([c for *_, c in schema.PALETTE] + [0] * len(near))[at]
    assert (seen(regrid.palette_to_class(r, g, b), 1, at.shape) == wanted).all()
    on = laid(spark, {1: device}, 4, "device")[0]
    assert (seen(regrid.palette_to_class(r, g, b, on), 1, at.shape) == wanted * (device > 0)).all()
    assert (seen(regrid.palette_to_class(r, g, b, on.where("ty > 0")), 1, at.shape)[:4] == 0).all()


TURN = {"hflip": lambda a: a[:, ::-1], "vflip": lambda a: a[::-1], "rot90": np.rot90, "transpose": np.transpose}


def test_augmentation_is_the_steps_in_turn(spark):
    steps = [("transpose", 0.5), ("levels", 0.7), ("rot90", 0.6), ("hflip", 0.5), ("rot90", 0.5), ("vflip", 0.5), ("levels", 0.5)]
    arrays = {i: RNG.integers(0, 256, (7, 10)) for i in range(24)}
    tiles, frames = laid(spark, arrays, 4)
    draws = {}
    for k, (op, chance) in enumerate(steps):
        names = [op] if op != "levels" else [op, "brightness", "contrast"]
        rows = frames.select("image_id", *[uniform(5, F.lit(n), F.lit(k), F.col("image_id")).alias(n) for n in names]).collect()
        draws[k] = {r["image_id"]: r for r in rows}
    out = regrid.augment(tiles, frames, steps, 5, 3).cache()
    sizes = {r["image_id"]: (r["height"], r["width"]) for r in regrid.augmented_frames(frames, steps, 5).collect()}
    for i, a in arrays.items():
        for k, (op, chance) in enumerate(steps):
            drawn = draws[k][i]
            if drawn[op] < chance and op == "levels":
                brightness, contrast = (drawn[n] * 0.4 - 0.2 for n in ("brightness", "contrast"))
                a = np.rint(np.clip(a * (1 + contrast) + 255 * brightness, 0, 255)).astype(int)
            elif drawn[op] < chance:
                a = TURN[op](a)
        assert sizes[i] == a.shape
        assert (seen(out, i, a.shape) == a).all(), i
    again = regrid.augment(tiles.repartition(5), frames, steps, 5, 3)
    assert sorted(again.collect()) == sorted(out.collect())


def test_every_symmetry_and_no_step(spark):
    a = RNG.integers(0, 256, (5, 6))
    tiles, frames = laid(spark, {1: a}, 4)
    assert (seen(regrid.augment(tiles, frames, [], 1, 4), 1, a.shape) == a).all()
    for chain in (["rot90"], ["rot90"] * 2, ["rot90"] * 3, ["hflip", "rot90"], ["vflip", "rot90"], ["transpose", "hflip"], ["rot90"] * 4):
        wanted = a
        for op in chain:
            wanted = TURN[op](wanted)
        out = regrid.augment(tiles, frames, [(op, 1.1) for op in chain], 1, 4)
        assert (seen(out, 1, wanted.shape) == wanted).all(), chain
    with pytest.raises(ValueError, match="unknown step"):
        regrid.augment(tiles, frames, [("shear", 0.5)], 1, 4)
