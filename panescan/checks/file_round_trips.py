"""Registered queries: what the sinks write into a run's own folder, read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panescan.checks import files_plans
from panescan.checks.derived import boxes, class_runs, gray, r6
from panescan.checks.registry import registry
from panescan.checks.scoring_streams import photo_frames, photo_tiles
from panescan.operators import raster, scoring
from panescan.session import checkpoint_folder
from panescan.sources import catalog, files, labels, sinks
from panescan.streaming import monitors

QUERIES, SQL, query = registry()
C = F.col


def folder(spark, name):
    return f"{checkpoint_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def photos(spark, sf_dir):
    """The grey images as bitmaps in a folder per parity of their id."""
    path = folder(spark, "photos")
    whole = photo_tiles(spark, sf_dir, 8).withColumn("name", F.concat(C("image_id") % 2, F.lit("/p"), C("image_id"), F.lit(".bmp")))
    files.write_files(files.bitmap_files(whole), path, names=whole)
    return path


@query("scan_written_photos", "gray", "select image_id, y, x, value from gray")
def scan_written_photos(spark, sf_dir):
    images = catalog.scan_images(spark, photos(spark, sf_dir), recursive=True)
    tiles = catalog.images_to_tiles(images, 5)
    ids = images.select("image_id", F.substring("stem", 2, 20).cast("bigint").alias("photo"))
    px = raster.tiles_to_pixels(tiles).join(ids, "image_id")
    return px.select(C("photo").alias("image_id"), "y", "x", "value")


@query("stream_written_photos", "gray", "select distinct image_id, 54+8*24 as length, '424d' as head from gray")
def stream_written_photos(spark, sf_dir):
    arrived = monitors.stream_images(spark, photos(spark, sf_dir), "*.bmp", max_files=400)
    rows = arrived.select("path", "length", F.lower(F.hex(F.substring("content", 1, 2))).alias("head"))
    out = monitors.drain(rows, folder(spark, "arrived"))
    return out.select(F.regexp_extract("path", r"p(\d+)\.bmp$", 1).cast("bigint").alias("image_id"), C("length").cast("int").alias("length"), "head")


@query("written_labels", "frames", "select image_id, x::int x, y::int y, w::int w, h::int h from frames")
def written_labels(spark, sf_dir):
    path = folder(spark, "labels")
    documents = files_plans.QUERIES["detail_json"](spark, sf_dir)
    labels.write_labels(documents, path)
    rows = labels.read_rows(spark, path, "image_id bigint, x int, y int, w int, h int")
    return rows.select("image_id", "x", "y", "w", "h")


@query("written_yolo", "boxes", """, n as (select *, case when image_id%3=0 then 'a' else 'b' end origin, 'p'||(image_id//3) stem from boxes),
 c as (select stem, min(origin||image_id)<>max(origin||image_id) shared from n group by stem),
 l as (select stem, shared, image_id, row_number() over (partition by image_id order by ann_id)-1 line, round_even(x/25.0e0,0) sx, round_even(y/25.0e0,0) sy, round_even(w/25.0e0,0) sw, round_even(h/25.0e0,0) sh,
  origin from n join c using (stem))
select case when shared then stem||'-'||substr(md5('{"origin":"'||origin||'","file_name":"'||image_id%3||'/'||stem||'.bmp"}'),1,16) else stem end||'.txt' as name, line::int line, 0 cls,
 round((sx+sw/2.0e0)/120,6) cx, round((sy+sh/2.0e0)/160,6) cy, round(sw/120.0e0,6) nw, round(sh/160.0e0,6) nh from l""")
def written_yolo(spark, sf_dir):
    """Photos of equal name in different folders: each has its own file, of thousands of lines."""
    path = folder(spark, "yolo")
    i = C("image_id")
    name = F.concat(i % 3, F.lit("/p"), F.expr("image_id div 3"), F.lit(".bmp"))
    rows = boxes(spark, sf_dir).select(
        "image_id", F.when(i % 3 == 0, "a").otherwise("b").alias("origin"), name.alias("file_name"), C("ann_id").alias("ann_no"),
        F.lit(3000).alias("width"), F.lit(4000).alias("height"), *[C(c).cast("double").alias(c) for c in "xywh"],
    )
    labels.write_yolo(labels.coco_to_yolo(rows), path)
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("name"), "value")
    lines = text.select("name", F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("line", "text"))
    numbers = F.split("text", " ")
    return lines.select("name", "line", numbers[0].cast("int").alias("cls"), *[r6(numbers[k + 1].cast("double"), c) for k, c in enumerate(("cx", "cy", "nw", "nh"))])


@query("written_patches", "mask", """, m as (select * from mask where layer='pred'),
 a as (select image_id, 'multiclass' layer, value, count(*) pixels from m where value>0 group by all union all select image_id, 'combined', 1, count(*) from m where value>0 group by 1
  union all select image_id, 'class_'||value, value, count(*) from m where value>0 group by all)
select image_id, layer, case when layer like 'class%' then 0 else value end::int class_id, pixels::bigint pixels from a""")
def written_patches(spark, sf_dir):
    path = folder(spark, "patches")
    runs = class_runs(spark, sf_dir).where("layer = 'pred'").drop("layer")
    tiles = photo_tiles(spark, sf_dir, 8)
    sinks.write_patches(tiles, runs, boxes(spark, sf_dir), path)
    kept = spark.read.parquet(f"{path}/masks").groupBy("image_id", "layer", "class_id").agg(F.sum(raster.length()).alias("pixels"))
    shown = F.when(C("layer").startswith("class"), 0).otherwise(C("class_id")).cast("int").alias("class_id")
    return kept.select("image_id", "layer", shown, "pixels")


@query("padded_patches", "gray", """, p as (select distinct image_id, r*2+c patch_id, r*5 y0, c*5 x0 from gray, range(2) a(r), range(2) b(c))
select p.image_id, patch_id::bigint patch_id, (y0+dy)::int y, (x0+dx)::int x, coalesce(value,0)::int as value
 from p cross join range(5) u(dy) cross join range(5) v(dx) left join gray g on g.image_id=p.image_id and g.y=y0+dy and g.x=x0+dx""")
def padded_patches(spark, sf_dir):
    patches = scoring.cut_patches(photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), 5, 0)
    tiles = patches.select("image_id", C("patch_id").cast("string").alias("layer"), F.lit(0).alias("ty"), F.lit(0).alias("tx"), "y0", "x0", "h", "w", "px")
    return raster.tiles_to_pixels(tiles).withColumn("layer", C("layer").cast("bigint")).withColumnRenamed("layer", "patch_id")
