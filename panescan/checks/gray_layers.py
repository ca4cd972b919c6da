"""Registered queries: grey-value layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan.checks.derived import gray, r6, table
from panescan.checks.registry import registry
from panescan.functions.hashing import uniform
from panescan.operators import focal as fo
from panescan.operators import gray as g
from panescan.operators import raster

QUERIES, SQL, query = registry()
XY = "image_id, y, x"


def colours(spark, sf_dir):
    """Three channels per pixel: the grey level, its transpose and its complement."""
    p = gray(spark, sf_dir)
    return p.select("image_id", "y", "x", F.col("value").alias("r"), (F.col("value") * 7 % 256).alias("g"), (255 - F.col("value")).alias("b"))


@query("to_gray", "gray", f"""select {XY}, round(value*0.299e0+(value*7%256)*0.587e0+(255-value)*0.114e0)::int as value from gray""")
def to_gray(spark, sf_dir):
    return colours(spark, sf_dir).select("image_id", "y", "x", g.luma(F.col("r"), F.col("g"), F.col("b")).alias("value"))


@query("normalize_levels", "gray", f"""select {XY}, round(value/255.0e0,6) unit, round((value/255.0e0-0.33e0)/0.33e0,6) std_gray,
 round((value/255.0e0-0.485e0)/0.229e0,6) std_red from gray""")
def normalize_levels(spark, sf_dir):
    v = F.col("value")
    return gray(spark, sf_dir).select(
        "image_id", "y", "x", r6(g.normalize(v), "unit"), r6(g.normalize(v, "standard"), "std_gray"), r6(g.normalize(v, "standard", 0), "std_red")
    )


@query("minmax_normalize", "gray", f""", q as (select image_id,y,x, case when image_id%5=0 then 7 else value//2 end v from gray),
 m as (select image_id, min(v) lo, max(v) hi from q group by 1)
select {XY}, round(case when hi>lo then (v-lo)*255.0e0/(hi-lo) else 0 end,6) as value from q join m using (image_id)""")
def minmax_normalize(spark, sf_dir):
    flat = gray(spark, sf_dir).withColumn(
        "value", F.when(F.col("image_id") % 5 == 0, 7).otherwise(F.floor(F.col("value") / 2)).cast("int")
    )
    return g.minmax_normalize(flat).select("image_id", "y", "x", r6("value", "value"))


@query("abs_diff", "gray", f"""select a.image_id, a.y, a.x, abs(a.value-b.value)::double as value from gray a
 join gray b on a.image_id=b.image_id and a.y=b.x and a.x=b.y""")
def abs_diff(spark, sf_dir):
    p = gray(spark, sf_dir)
    return g.abs_diff(p, g.flip_and_turn(p, "transpose", 8, 8))


@query("threshold_levels", "gray", f"select {XY}, case when value>128 then 255 else 0 end as value from gray")
def threshold_levels(spark, sf_dir):
    return gray(spark, sf_dir).select("image_id", "y", "x", g.threshold(F.col("value"), 128).alias("value"))


HIST = ", h as (select image_id, value, count(*) n from gray group by all)"


@query("level_histogram", "gray", HIST + " select image_id, value, n::bigint n from h")
def level_histogram(spark, sf_dir):
    return g.histogram(gray(spark, sf_dir))


@query("otsu_threshold", "gray", HIST + """, c as (select image_id, value, sum(n) over w w0, sum(n*value) over w s0,
  sum(n) over (partition by image_id) w, sum(n*value) over (partition by image_id) s from h
  window w as (partition by image_id order by value)),
 v as (select image_id, value, case when w>w0 then (s0*w-s*w0)::double*(s0*w-s*w0)/(w0::double*(w-w0)) else 0 end score from c)
select image_id, arg_min(value, row(-score, value))::int threshold from v group by 1""")
def otsu_threshold(spark, sf_dir):
    return g.otsu_threshold(g.histogram(gray(spark, sf_dir)))


@query("area_threshold", "gray", """, d as (select image_id, (value*value/255)::int//(1+image_id%3) as value from gray),
 lv as (select i.image_id, t.t, (select count(*) from d where d.image_id=i.image_id and d.value<=t.t)/64.0e0 cdf
   from (select distinct image_id from d) i, range(65) t(t)),
 f as (select image_id, max(t) filter (cdf<=0.62e0) ok, max(cdf) filter (t=64) c64 from lv group by 1)
select image_id, (case when c64<=0.62e0 then 64 when ok is null then null when ok>40 then greatest(40,ok-4) else ok end)::int threshold from f""")
def area_threshold(spark, sf_dir):
    squared = F.floor(F.rint(F.col("value") * F.col("value") / 255) / (1 + F.col("image_id") % 3)).cast("int")
    return g.area_threshold(g.histogram(gray(spark, sf_dir).withColumn("value", squared)))


@query("downscale_area", "gray", f"select image_id, y//3 y, x//3 x, round(avg(value),6) as value from gray where y<6 and x<6 group by all")
def downscale_area(spark, sf_dir):
    return g.downscale(gray(spark, sf_dir), 3, 8, 8).select("image_id", "y", "x", r6("value", "value"))


@query("resize_nearest", "gray", """, t as (select i.image_id, y::int y, x::int x from (select distinct image_id from gray) i, range(11) a(y), range(5) b(x))
select t.image_id, t.y, t.x, g.value from t join gray g on g.image_id=t.image_id and g.y=t.y*8//11 and g.x=t.x*8//5""")
def resize_nearest(spark, sf_dir):
    return g.resize_nearest(gray(spark, sf_dir), (8, 8), (11, 5))


@query("crop_rect", "gray", "select image_id, y-1 y, x-(image_id%4)::int x, value from gray where y>=1 and y<5 and x>=image_id%4 and x<image_id%4+3")
def crop_rect(spark, sf_dir):
    return g.crop(gray(spark, sf_dir), F.col("image_id") % 4, F.lit(1), F.lit(3), F.lit(4))


@query("paste_mask", "gray", """, t as (select i.image_id, y::int y, x::int x from (select distinct image_id from gray) i, range(12) a(y), range(6) b(x))
select t.image_id, (t.y+4)::int y, (t.x-2)::int x, 1 as value from t join gray g on g.image_id=t.image_id and g.y=t.y*8//12 and g.x=t.x*8//6
 where g.value>100 and t.y+4<14 and t.x-2>=0""")
def paste_mask(spark, sf_dir):
    m = gray(spark, sf_dir).withColumn("value", (F.col("value") > 100).cast("int"))
    return g.paste(m, -2, 4, 14, 10, (8, 8), (12, 6))


def sized(spark, sf_dir):
    """The grey levels laid out anew: heights 2 to 32 and widths 64 // height, by image."""
    pos, h = F.col("y") * 8 + F.col("x"), F.expr("shiftleft(1, cast(1 + image_id % 5 as int))")
    rows = gray(spark, sf_dir).select("image_id", pos.alias("pos"), "value", h.alias("h")).withColumn("w", F.expr("64 div h").cast("int"))
    return rows.select("image_id", F.expr("pos div w").cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), "value", "h", "w")


SIZED = """, p as (select image_id, y*8+x pos, value, (2**(1+image_id%5))::int h, (64//(2**(1+image_id%5))::int)::int w from gray),
 sized as (select image_id, (pos//w)::int y, (pos%w)::int x, value, h, w from p)"""
SIZES = SIZED + ", sizes as (select distinct image_id, h, w from sized)"


@query("downscale_by_frame", "gray", SIZED + " select image_id, y//3 y, x//3 x, round(avg(value),6) as value from sized where y<h//3*3 and x<w//3*3 group by all")
def downscale_by_frame(spark, sf_dir):
    return g.downscale(sized(spark, sf_dir), 3, F.col("h"), F.col("w")).select("image_id", "y", "x", r6("value", "value"))


@query("resize_by_frame", "gray", SIZES + """ select i.image_id, a.y::int y, b.x::int x, g.value from sizes i, range(11) a(y), range(40) b(x), sized g
 where b.x<i.w+3 and g.image_id=i.image_id and g.y=a.y*i.h//11 and g.x=b.x*i.w//(i.w+3)""")
def resize_by_frame(spark, sf_dir):
    return g.resize_nearest(sized(spark, sf_dir), (F.col("h"), F.col("w")), (11, F.col("w") + 3))


@query("paste_by_frame", "gray", SIZES + """ select i.image_id, (a.y+1)::int y, (b.x-1)::int x, 1 as value from sizes i, range(64) a(y), range(64) b(x), sized g
 where a.y<2*i.h and b.x<i.w and g.image_id=i.image_id and g.y=a.y*i.h//(2*i.h) and g.x=b.x and g.value>100 and a.y+1<i.h+2 and b.x>=1 and b.x-1<i.w-1""")
def paste_by_frame(spark, sf_dir):
    h, w = F.col("h"), F.col("w")
    mask = sized(spark, sf_dir).withColumn("value", (F.col("value") > 100).cast("int"))
    return g.paste(mask, -1, 1, h + 2, w - 1, (h, w), (2 * h, w))


@query("turn_by_frame", "gray", SIZED + " select image_id, w-1-x y, y x, value from sized")
def turn_by_frame(spark, sf_dir):
    return g.flip_and_turn(sized(spark, sf_dir), "rot90", F.col("h"), F.col("w")).drop("h", "w")


@query("augment_layers", "gray", """, d as (select *, ('0x'||substr(md5('7-'||op||'-'||image_id),1,8))::bigint/4294967296.0e0 < 0.5e0 as drawn
 from gray, (values ('hflip'),('vflip'),('rot90'),('transpose')) o(op))
select image_id, op, case when not drawn or op='hflip' then y when op='vflip' then 7-y when op='rot90' then 7-x else x end y,
 case when not drawn or op='vflip' then x when op='hflip' then 7-x else y end x, value from d""")
def augment_layers(spark, sf_dir):
    p = gray(spark, sf_dir)
    parts = []
    for op in ("hflip", "vflip", "rot90", "transpose"):
        drawn = uniform(7, F.lit(op), F.col("image_id")) < 0.5
        turned = g.flip_and_turn(p.where(drawn), op, 8, 8).unionByName(p.where(~drawn))  # an image that is not drawn stays as it is
        parts.append(turned.withColumn("op", F.lit(op)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("brightness_contrast", "gray", f""", u as (select *, ('0x'||substr(md5('3-b-'||image_id),1,8))::bigint/4294967296.0e0*0.4e0-0.2e0 br,
  ('0x'||substr(md5('3-c-'||image_id),1,8))::bigint/4294967296.0e0*0.4e0-0.2e0 co from gray)
select {XY}, round(greatest(0.0e0,least(255.0e0,value*(1+co)+255*br)),6) as value from u""")
def brightness_contrast(spark, sf_dir):
    br = uniform(3, F.lit("b"), F.col("image_id")) * 0.4 - 0.2
    co = uniform(3, F.lit("c"), F.col("image_id")) * 0.4 - 0.2
    return gray(spark, sf_dir).select("image_id", "y", "x", r6(g.brightness_contrast(F.col("value"), br, co), "value"))


NEAR = """, n as (select g.image_id, g.y, g.x, b.value v from gray g, range(-1,2) dy(dy), range(-1,2) dx(dx), gray b
  where b.image_id=g.image_id and b.y=least(7,greatest(0,g.y+dy.dy)) and b.x=least(7,greatest(0,g.x+dx.dx)))"""


@query("focal_filters", "gray", NEAR + """, s as (select image_id,y,x,min(v) lo,max(v) hi,floor(sum(v)/9.0e0+0.5)::int mean,list_sort(list(v)) l from n group by all)
select image_id,y,x,lo::int lo,hi::int hi,mean,l[5]::int median,l[8]::int upper from s""")
def focal_filters(spark, sf_dir):
    """3x3 filters on 4-pixel tiles, so every window near a tile border needs its halo."""
    tiles = raster.pixels_to_tiles(gray(spark, sf_dir).withColumn("layer", F.lit("g")), 4)
    stats = {"lo": ("min", 0), "hi": ("max", 0), "mean": ("mean", 0), "median": ("median", 0), "upper": ("rank", 0.8)}
    out = None
    for name, (stat, rank) in stats.items():
        px = raster.tiles_to_pixels(fo.focal(tiles, 4, (8, 8), stat, 3, rank=rank))
        px = px.select("image_id", "y", "x", F.col("value").alias(name))
        out = px if out is None else out.join(px, ["image_id", "y", "x"])
    return out


@query("focal_by_frame", "gray", SIZED + """ select g.image_id, g.y, g.x, max(b.value)::int as value from sized g, range(-1,2) dy(dy), range(-1,2) dx(dx), sized b
 where b.image_id=g.image_id and b.y=least(g.h-1,greatest(0,g.y+dy.dy)) and b.x=least(g.w-1,greatest(0,g.x+dx.dx)) group by all""")
def focal_by_frame(spark, sf_dir):
    p = sized(spark, sf_dir)
    frames = p.groupBy("image_id").agg(F.first("h").alias("height"), F.first("w").alias("width"))
    tiles = raster.pixels_to_tiles(p.select("image_id", F.lit("g").alias("layer"), "y", "x", "value"), 4)
    return raster.tiles_to_pixels(fo.focal(tiles, 4, frames, "max", 3)).drop("layer")


@query("focal_opening", "gray", NEAR + """, e as (select image_id,y,x,min(v) v from n group by all),
 m as (select g.image_id, g.y, g.x, max(b.v)::int as value from e g, range(-1,2) dy(dy), range(-1,2) dx(dx), e b
  where b.image_id=g.image_id and b.y=least(7,greatest(0,g.y+dy.dy)) and b.x=least(7,greatest(0,g.x+dx.dx)) group by all) select * from m""")
def focal_opening(spark, sf_dir):
    tiles = raster.pixels_to_tiles(gray(spark, sf_dir).withColumn("layer", F.lit("g")), 4)
    return raster.tiles_to_pixels(fo.opened(tiles, 4, (8, 8), 3)).drop("layer")


@query("extract_defect_masks")
def extract_defect_masks(spark, sf_dir):
    tiles = raster.pixels_to_tiles(gray(spark, sf_dir).withColumn("layer", F.lit("photo")), 8)
    return fo.extract_defect_masks(tiles, 8, (8, 8), background=5).drop("layer")


def placed(p):
    """Difference pixels of each image's own left half, shifted by two columns."""
    return p.where("x < 4").select(
        "image_id", "y", (F.col("x") + 2).alias("x"), (F.col("value") - 90).alias("diff"), (F.col("value") > 60).cast("int").alias("cover")
    )


@query("superimpose_sample", "gray", """select g.image_id, g.y, g.x, greatest(0,least(255,g.value-coalesce((s.value-90)*(s.value>60)::int,0)))::int as value
 from gray g left join gray s on s.image_id=g.image_id and s.y=g.y and s.x+2=g.x and s.x<4""")
def superimpose_sample(spark, sf_dir):
    p = gray(spark, sf_dir)
    return g.superimpose(p, placed(p))


@query("superimpose_protected", "gray", """select g.image_id, g.y, g.x, greatest(0,least(255,g.value-case when g.value>200 then 0 else coalesce((s.value-90)*(s.value>60)::int,0) end))::int as value
 from gray g left join gray s on s.image_id=g.image_id and s.y=g.y and s.x+2=g.x and s.x<4""")
def superimpose_protected(spark, sf_dir):
    p = gray(spark, sf_dir)
    return g.superimpose_protected(p, placed(p), p.where("value > 200").select("image_id", "y", "x"))


@query("bright_line_flag", "gray", """, r as (select image_id, rect_id, (rect_id*2)::int rx, (image_id%3)::int ry, (2+rect_id%2)::int w, (5-rect_id)::int h
   from (select distinct image_id from gray), range(6) q(rect_id)),
 m as (select r.image_id, rect_id, y, avg(value) a from r join gray g on g.image_id=r.image_id and x>=rx and x<rx+w and y>=ry and y<ry+h group by all),
 f as (select image_id, rect_id, max(a)>avg(a)+50 hit from m group by all)
select r.image_id, coalesce(bool_or(hit),false) power_on from (select distinct image_id from r) r left join f using (image_id) group by 1""")
def bright_line_flag(spark, sf_dir):
    return g.bright_line_flag(gray(spark, sf_dir), bright_rects(spark, sf_dir))


def bright_rects(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("image_id"))
    return v.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("rect_id")).select(
        "image_id", "rect_id", (F.col("rect_id") * 2).alias("x"), (F.col("image_id") % 3).alias("y"),
        (2 + F.col("rect_id") % 2).alias("w"), (5 - F.col("rect_id")).alias("h"),
    )


@query("three_raster_forms", "gray", "select image_id, y, x, value from gray")
def three_raster_forms(spark, sf_dir):
    """Pixels to tiles to runs and back give the pixels again."""
    tiles = raster.pixels_to_tiles(gray(spark, sf_dir).withColumn("layer", F.lit("g")), 4)
    return raster.runs_to_pixels(raster.tiles_to_runs(tiles)).drop("layer")
