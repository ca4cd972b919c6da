"""Registered queries: resize, downscale, paste, palette and the augmentation chain on tiles of unequal grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan.checks import gray_layers, mask_layers
from panescan.checks.derived import gray
from panescan.checks.gray_layers import SIZED, SIZES, sized
from panescan.checks.registry import registry
from panescan.operators import raster, regrid

QUERIES, SQL, query = registry()
C = F.col
FROM, TO = 3, 4  # edges of the source and the target tiles


def framed(spark, sf_dir):
    """Tiles and frames of images of several sizes."""
    p = sized(spark, sf_dir)
    frames = p.groupBy("image_id").agg(F.first("h").alias("height"), F.first("w").alias("width"))
    return tiled(p), frames


def tiled(pixels, layer="g", edge=FROM):
    return raster.pixels_to_tiles(pixels.select("image_id", F.lit(layer).alias("layer"), "y", "x", "value"), edge)


def shown(tiles):
    return raster.tiles_to_pixels(tiles).drop("layer")


@query("downscale_tiles", "gray", SIZED + " select image_id, y//3 y, x//3 x, ((2*sum(value)+9)//18)::int as value from sized where y<h//3*3 and x<w//3*3 group by all")
def downscale_tiles(spark, sf_dir):
    tiles, frames = framed(spark, sf_dir)
    return shown(regrid.downscale(tiles, frames, 3, TO))


@query("resize_tiles")
def resize_tiles(spark, sf_dir):
    tiles, frames = framed(spark, sf_dir)
    return shown(regrid.resize(tiles, frames, (11, C("fw") + 3), TO))


SQL["resize_tiles"] = gray_layers.SQL["resize_by_frame"]


def area_sums(rows: str, columns: str) -> str:
    """Sums over target cells, weighted by what they share with source cells in units of 1/(h*H) and 1/(w*W)."""
    return f"""{SIZES}, t as (select image_id, h, w, ({rows})::bigint th, ({columns})::bigint tw from sizes),
 o as (select t.image_id, t.h, t.w, a.y ty, b.x tx, value*(least((g.y+1)*th,(a.y+1)*t.h)-greatest(g.y*th,a.y*t.h))*(least((g.x+1)*tw,(b.x+1)*t.w)-greatest(g.x*tw,b.x*t.w)) s
  from t, range(80) a(y), range(80) b(x), sized g where a.y<th and b.x<tw and g.image_id=t.image_id
   and g.y*th<(a.y+1)*t.h and (g.y+1)*th>a.y*t.h and g.x*tw<(b.x+1)*t.w and (g.x+1)*tw>b.x*t.w),
 m as (select image_id, h, w, ty, tx, (2*sum(s)+any_value(h*w))//(2*any_value(h*w)) v from o group by image_id, h, w, ty, tx)"""


@query("resize_area_tiles", "gray", area_sums("11", "(w+1)//2") + " select image_id, ty::int y, tx::int x, v::int as value from m")
def resize_area_tiles(spark, sf_dir):
    tiles, frames = framed(spark, sf_dir)
    target = frames.select("image_id", F.lit(11).alias("height"), F.expr("(width + 1) div 2").alias("width"))
    return shown(regrid.resize(tiles, frames, target, TO, "area"))


def masked(spark, sf_dir, level, on):
    """Masks of bright cells that hold ``on``."""
    p = sized(spark, sf_dir).withColumn("value", F.when(C("value") > level, on).otherwise(0))
    return tiled(p), framed(spark, sf_dir)[1]


@query("paste_tiles")
def paste_tiles(spark, sf_dir):
    mask, frames = masked(spark, sf_dir, 100, 1)
    pasted = regrid.paste(mask, frames, (-1, 1, C("fw"), 2 * C("fh")), (C("fh") + 2, C("fw") - 1), TO)
    return shown(pasted).where("value > 0")


SQL["paste_tiles"] = gray_layers.SQL["paste_by_frame"]


@query("paste_area_tiles", "gray", area_sums("h+1", "(w+1)//2").replace("value*(", "(value>200)::int*(", 1)
       + " select image_id, (ty-1)::int y, (tx+2)::int x, 1 as value from m where v>0 and ty>=1 and ty-1<h-1 and tx+2<w")
def paste_area_tiles(spark, sf_dir):
    mask, frames = masked(spark, sf_dir, 200, 1)
    rects = frames.select("image_id", F.lit(2).alias("x"), F.lit(-1).alias("y"), F.expr("(width + 1) div 2").alias("w"), (C("height") + 1).alias("h"))
    canvas = frames.select("image_id", (C("height") - 1).alias("height"), "width")
    return shown(regrid.paste(mask, frames, rects, canvas, TO, "area")).where("value > 0")


@query("palette_tiles")
def palette_tiles(spark, sf_dir):
    p = gray(spark, sf_dir)
    level = C("value") % len(mask_layers.PALETTE_LIST) + 1
    channels = [tiled(p.withColumn("value", F.element_at(F.array(*[F.lit(c[i]) for c in mask_layers.PALETTE_LIST]), level))) for i in range(3)]
    device = tiled(p.withColumn("value", F.when((C("x") + C("y")) % 3 == 0, 0).otherwise(1)), "device")
    return shown(regrid.palette_to_class(*channels, device)).withColumnRenamed("value", "class_id")


SQL["palette_tiles"] = mask_layers.SQL["palette_to_class"]

CHAIN = [("hflip", 0.5), ("rot90", 0.5), ("levels", 0.5), ("vflip", 0.5), ("transpose", 0.5), ("levels", 0.5)]


def chain_sql() -> str:
    """Every step in turn, on pixels that carry the size of their image."""
    sql, former = SIZED, "sized"
    number = lambda what, i: f"('0x'||substr(md5('11-{what}-{i}-'||image_id),1,8))::bigint/4294967296.0e0"
    maps = {
        "hflip": ("y", "w-1-x", "h", "w", "value"), "vflip": ("h-1-y", "x", "h", "w", "value"),
        "rot90": ("w-1-x", "y", "w", "h", "value"), "transpose": ("x", "y", "w", "h", "value"),
    }
    for i, (op, chance) in enumerate(CHAIN):
        br, co = (f"({number(n, i)}*0.4e0-0.2e0)" for n in ("brightness", "contrast"))
        new = maps.get(op, ("y", "x", "h", "w", f"round_even(greatest(0.0e0,least(255.0e0,value*(1+{co})+255*{br})),0)::int"))
        picked = ", ".join(f"case when hit then {a} else {b} end {b}" for a, b in zip(new, ("y", "x", "h", "w", "value")))
        sql += f", d{i} as (select *, {number(op, i)} < {chance}e0 as hit from {former}), s{i} as (select image_id, {picked} from d{i})"
        former = f"s{i}"
    return sql + f" select image_id, y::int y, x::int x, value::int as value, h::int h, w::int w from {former}"


@query("augment_chain", "gray", chain_sql())
def augment_chain(spark, sf_dir):
    tiles, frames = framed(spark, sf_dir)
    sizes = regrid.augmented_frames(frames, CHAIN, 11).select("image_id", C("height").alias("h"), C("width").alias("w"))
    return shown(regrid.augment(tiles, frames, CHAIN, 11, TO)).join(sizes, "image_id")
