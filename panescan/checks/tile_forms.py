"""Registered queries: the tile forms of the grey-value and mask operators, against the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan.checks import gray_layers, mask_layers
from panescan.checks.derived import gray
from panescan.checks.registry import registry
from panescan.operators import gray as g
from panescan.operators import raster, tiles

QUERIES, SQL, query = registry()
EDGE = 4


def tiled(pixels, layer="g"):
    return raster.pixels_to_tiles(pixels.select("image_id", F.lit(layer).alias("layer"), "y", "x", "value"), EDGE)


def shown(out):
    return raster.tiles_to_pixels(out).drop("layer")


@query("level_histogram_tiles", "gray", gray_layers.HIST + " select image_id, value, n::bigint n from h")
def level_histogram_tiles(spark, sf_dir):
    return tiles.histogram(tiled(gray(spark, sf_dir)), ("image_id",))


@query("minmax_normalize_tiles", "gray", """, q as (select image_id,y,x, case when image_id%5=0 then 7 else value//2 end v from gray),
 m as (select image_id, min(v) lo, max(v) hi from q group by 1)
select image_id, y, x, round_even(case when hi>lo then (v-lo)*255.0e0/(hi-lo) else 0 end,0)::int as value from q join m using (image_id)""")
def minmax_normalize_tiles(spark, sf_dir):
    level = F.when(F.col("image_id") % 5 == 0, 7).otherwise(F.floor(F.col("value") / 2)).cast("int")
    return shown(tiles.minmax_normalize(tiled(gray(spark, sf_dir).withColumn("value", level))))


@query("abs_diff_tiles", "gray", """select a.image_id, a.y, a.x, abs(a.value-b.value)::int as value from gray a
 join gray b on a.image_id=b.image_id and a.y=b.x and a.x=b.y""")
def abs_diff_tiles(spark, sf_dir):
    p = gray(spark, sf_dir)
    return shown(tiles.abs_diff(tiled(p), tiled(g.flip_and_turn(p, "transpose", 8, 8), "t")))


@query("crop_rect_tiles", "gray", "select image_id, y-1 y, x-(image_id%4)::int x, value from gray where y>=1 and y<5 and x>=image_id%4 and x<image_id%4+3")
def crop_rect_tiles(spark, sf_dir):
    return shown(tiles.crop(tiled(gray(spark, sf_dir)), F.col("image_id") % 4, 1, 3, 4))


def over(guard: str) -> str:
    return f"""select g.image_id, g.y, g.x, greatest(0,g.value-coalesce(abs(s.value-90)*(s.value>60 {guard})::int,0))::int as value
 from gray g left join gray s on s.image_id=g.image_id and s.y=g.y and s.x+2=g.x and s.x<4"""


def layers(spark, sf_dir):
    """Own left half, shifted by two columns, as difference and cover tiles; bright pixels are protected."""
    p = gray(spark, sf_dir)
    left = p.where("x < 4").withColumn("x", F.col("x") + 2)
    diff = left.withColumn("value", F.abs(F.col("value") - 90))
    cover = left.withColumn("value", (F.col("value") > 60).cast("int"))
    bright = p.withColumn("value", (F.col("value") > 200).cast("int"))
    return tiled(p), tiled(diff), tiled(cover), tiled(bright)


@query("superimpose_tiles", "gray", over(""))
def superimpose_tiles(spark, sf_dir):
    return shown(tiles.superimpose(*layers(spark, sf_dir)[:3]))


@query("superimpose_protected_tiles", "gray", over("and g.value<=200"))
def superimpose_protected_tiles(spark, sf_dir):
    return shown(tiles.superimpose(*layers(spark, sf_dir)))


@query("bright_line_flag_tiles")
def bright_line_flag_tiles(spark, sf_dir):
    return tiles.bright_line_flag(tiled(gray(spark, sf_dir)), gray_layers.bright_rects(spark, sf_dir))


SQL["bright_line_flag_tiles"] = gray_layers.SQL["bright_line_flag"]


@query("mask_rule_dataset_tiles", None, "select image_id, (pos//8)::int y, (pos%8)::int x, class_id::int as value from (" + mask_layers.SQL["mask_rule_dataset"] + ") where class_id is not null")
def mask_rule_dataset_tiles(spark, sf_dir):
    raw = mask_layers.raw_masks(spark, sf_dir).selectExpr("image_id", "pos div 8 y", "pos % 8 x", "value")
    return shown(tiles.normalize_mask(tiled(raw), "dataset"))
