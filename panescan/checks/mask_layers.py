"""Registered queries: building, merging, colouring and auditing class masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan import schema
from panescan.checks.derived import MASK_H, MASK_W, class_runs, gray, table
from panescan.checks.registry import registry
from panescan.operators import masks, metrics, raster

QUERIES, SQL, query = registry()


def by_row(runs, *extra):
    """Pixel counts per image, row and class: small rows that still fix the geometry."""
    start_sum = F.sum((F.col("x0") + F.col("x1")).cast("bigint") * raster.length() / 2).cast("bigint")
    return runs.groupBy("image_id", *extra, "y", "class_id").agg(F.sum(raster.length()).alias("n"), start_sum.alias("sum_x"))


def defects(spark, sf_dir, layer=None):
    runs = class_runs(spark, sf_dir).where("class_id > 0")
    return runs if layer is None else runs.where(F.col("layer") == layer)


BY_ROW = "select image_id, y, c::int class_id, count(*)::bigint n, sum(x)::bigint sum_x from m where c>0 group by image_id, y, c"
WIDE = """, w as (select image_id,y,x,max(value) filter (layer='pred') p,max(value) filter (layer='truth') t from mask group by all)"""


@query("mask_runs", "mask", """, g as (select *, x - row_number() over (partition by image_id,layer,y,value order by x) k from mask)
select image_id, layer, value::int class_id, y, min(x)::int x0, max(x)::int x1 from g group by image_id, layer, y, value, k""")
def mask_runs(spark, sf_dir):
    px = raster.runs_to_pixels(class_runs(spark, sf_dir))
    return raster.pixels_to_runs(px)


@query("merge_highest", "mask", WIDE + ", m as (select image_id,y,x,greatest(p,t) c from w) " + BY_ROW)
def merge_highest(spark, sf_dir):
    return by_row(masks.merge_masks(class_runs(spark, sf_dir), "highest"))


@query("merge_scratch_first", "mask", WIDE + ", m as (select image_id,y,x,case when p=1 or t=1 then 1 when p=2 or t=2 then 2 when p=3 or t=3 then 3 else 0 end c from w) " + BY_ROW)
def merge_scratch_first(spark, sf_dir):
    return by_row(masks.merge_masks(class_runs(spark, sf_dir), "scratch_first"))


@query("binary_union", "mask", WIDE + ", m as (select image_id,y,x,(p>0 or t>0)::int c from w) " + BY_ROW)
def binary_union(spark, sf_dir):
    return by_row(masks.binary_union(class_runs(spark, sf_dir)))


@query("split_by_class", "mask", """select image_id, 'class_'||value as layer, count(*)::bigint pixels from mask where layer='pred' and value>0 group by image_id, value""")
def split_by_class(spark, sf_dir):
    return masks.split_by_class(defects(spark, sf_dir, "pred")).groupBy("image_id", "layer").agg(F.sum(raster.length()).alias("pixels"))


@query("mask_intersection", "mask", WIDE + ", m as (select image_id,y,x,case when t>0 then p else 0 end c from w) " + BY_ROW)
def mask_intersection(spark, sf_dir):
    pred, truth = defects(spark, sf_dir, "pred"), defects(spark, sf_dir, "truth")
    return by_row(masks.intersect_runs(pred, truth))


@query("mask_difference", "mask", WIDE + ", m as (select image_id,y,x,case when t>0 then 0 else p end c from w) " + BY_ROW)
def mask_difference(spark, sf_dir):
    pred, truth = defects(spark, sf_dir, "pred"), defects(spark, sf_dir, "truth")
    return by_row(masks.except_runs(pred, truth))


@query("layer_union_all", "mask", """select layer, value::int class_id, count(*)::bigint pixels from
 (select 'a' as layer, value from mask where layer='pred' and value>0 union all select 'b', value from mask where value>0) group by all""")
def layer_union_all(spark, sf_dir):
    a = defects(spark, sf_dir, "pred").withColumn("layer", F.lit("a"))
    b = defects(spark, sf_dir).withColumn("layer", F.lit("b"))
    return a.unionByName(b).groupBy("layer", "class_id").agg(F.sum(raster.length()).alias("pixels"))


@query("error_map", "mask", WIDE + """select image_id, p::int pred, t::int truth, case when p=t and p>0 then 'TP' when p=t then 'TN' when t=0 then 'FP'
 when p=0 then 'FN' else 'MIX' end code, count(*)::bigint pixels from w group by all""")
def error_map(spark, sf_dir):
    seg = raster.overlay(class_runs(spark, sf_dir), "pred", "truth")
    return seg.groupBy(
        "image_id", F.col("a").cast("int").alias("pred"), F.col("b").cast("int").alias("truth"), masks.error_code(F.col("a"), F.col("b")).alias("code")
    ).agg(F.sum(raster.length()).alias("pixels"))


RAW = """raw as (select vec_id::bigint image_id, (generate_subscripts(embedding,1)-1)::int pos, vec_id%7 k,
   (floor(abs(unnest(embedding)::double)*1000)::bigint)%1000 r from embeddings),
 rv as (select image_id, pos, (case k when 0 then r%2*255 when 1 then r%3 when 2 then r%4 when 3 then [0,1,255][r%3+1] when 4 then r%256 when 5 then [0,2,3,255][r%4+1] else 0 end)::int as value from raw),
 f as (select image_id, count(distinct value) n, max(value) hi, max(case when value<255 then value end) hb, bool_and(value in (0,255)) o, bool_or(value=255) h from rv group by 1) """


def raw_masks(spark, sf_dir):
    """Raw level masks of every kind: 0/255, 0..2, 0..3, with 255, full range, empty."""
    e = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("bigint") % 1000)
    r, k = F.col("r"), F.col("k")
    value = (
        F.when(k == 0, r % 2 * 255).when(k == 1, r % 3).when(k == 2, r % 4)
        .when(k == 3, F.element_at(F.array(F.lit(0), F.lit(1), F.lit(255)), (r % 3 + 1).cast("int")))
        .when(k == 4, r % 256)
        .when(k == 5, F.element_at(F.array(F.lit(0), F.lit(2), F.lit(3), F.lit(255)), (r % 4 + 1).cast("int")))
        .otherwise(0)
    )
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").cast("bigint").alias("image_id"), (F.col("vec_id") % 7).alias("k"), F.posexplode(e).alias("pos", "r"))
        .select("image_id", "pos", value.cast("int").alias("value"))
    )


def rule_query(name, variant, case, num_classes=4):
    @query(name, None, "with " + RAW + f"select image_id, pos, value, ({case})::int class_id from rv join f using (image_id)")
    def run(spark, sf_dir):
        return masks.normalize_mask(raw_masks(spark, sf_dir), variant, num_classes=num_classes)

    return run


DATASET = """case when n<=2 and o then (value>0)::int when hi<=3 then value when hi=255 then (case when value=255 then 1 else least(value,2) end) else least(value,2) end"""
rule_query("mask_rule_dataset", "dataset", DATASET)
rule_query(
    "mask_rule_dataset_three_classes", "dataset",
    f"case when (case when n<=2 and o then (hi>0)::int when hi<=3 then hi when hi=255 then greatest(1,least(hb,2)) else 2 end)<3 then {DATASET} end", 3,
)
rule_query("mask_rule_truth_multi", "truth_multi", "least(value,4)")
rule_query("mask_rule_truth_multi_to_binary", "truth_multi_to_binary", "(value>0)::int")
rule_query("mask_rule_truth_binary", "truth_binary", "case when n=2 and h then (value>127)::int else (value>0)::int end")
rule_query("mask_rule_generic", "generic", "case when n=2 and h then (value>127)::int else least(value,2) end")
rule_query("mask_rule_full_multi", "full_multi", "least(value,3)")
rule_query("mask_rule_full_binary", "full_binary", "case when (case when hi>1 then value>127 else value=1 end) then 2 else 0 end")


def audit(right: str) -> str:
    return "with " + RAW + f""", d as (select image_id, value, count(*) n from rv group by all)
select image_id, sum(n)::bigint n_pixels, bool_and(value=0) background_only,
 coalesce(array_to_string(list_sort(list(value) filter (value not in (0,1,2,3)))[1:5],','),'') unexpected,
 count(*) filter (value not in (0,1,2,3))::bigint n_unexpected, sum(n)=8*{right} shape_ok, sum(n)=8*{right} and count(*) filter (value not in (0,1,2,3))=0 ok from d group by image_id"""


@query("mask_audit", None, audit("8"))
def mask_audit(spark, sf_dir):
    return masks.mask_audit(raw_masks(spark, sf_dir), [0, 1, 2, 3], ["image_id"], (8, 8))


@query("mask_audit_by_frame", None, audit("(8+image_id%2)"))
def mask_audit_by_frame(spark, sf_dir):
    return masks.mask_audit(raw_masks(spark, sf_dir), [0, 1, 2, 3], ["image_id"], (8, 8 + F.col("image_id") % 2))


PAL = "(values " + ",".join(f"({r},{g},{b},{c})" for r, g, b, _, c in schema.PALETTE) + ",(255,255,255,0)) pal(r,g,b,c)"
PALETTE_LIST = [(r, g, b) for r, g, b, _, _ in schema.PALETTE] + [(255, 255, 255)]


@query("palette_to_class", "gray", f""", pal as (select row_number() over () - 1 i, * from {PAL})
select image_id, y, x, (case when (x+y)%3=0 then 0 else c end)::int class_id from gray join pal on i=value%8""")
def palette_to_class(spark, sf_dir):
    p = gray(spark, sf_dir)
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in PALETTE_LIST]), F.col("value") % 8 + 1)
    colours = p.select("image_id", "y", "x", pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))
    return masks.palette_to_class(colours, p.where("(x + y) % 3 <> 0"))


@query("colorize_classes", "mask", """select image_id, value::int class_id, [0,0,255,0][value+1]::int r, [0,255,0,0][value+1]::int g, [0,0,0,255][value+1]::int b, count(*)::bigint pixels
 from mask where layer='pred' group by all""")
def colorize_classes(spark, sf_dir):
    runs = masks.colorize(class_runs(spark, sf_dir).where("layer = 'pred'"))
    return runs.groupBy("image_id", "class_id", "r", "g", "b").agg(F.sum(raster.length()).alias("pixels"))


BASE = [(0, 0, 0), (255, 255, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 165, 0), (128, 0, 128), (255, 192, 203), (165, 42, 42)]


def _channel(i):
    fixed = "[" + ",".join(str(c[i]) for c in BASE) + "]"
    return f"(case when k<=10 then {fixed}[k+1] else ('0x'||substr(md5('class_'||k),{2 * i + 1},2))::int end)::int {'rgb'[i]}"


@query("colorize_categories", "boxes", f", k as (select ann_id, (h%14)::int k from boxes) select ann_id, k category, {_channel(0)}, {_channel(1)}, {_channel(2)} from k")
def colorize_categories(spark, sf_dir):
    from panescan.checks.derived import boxes

    ids = boxes(spark, sf_dir).select("ann_id", (F.col("h") % 14).cast("int").alias("category"))
    return masks.colorize(ids, masks.CATEGORY_COLOURS, "category")


@query("overlay_blend", "gray", """, c as (select g.*, (y*x)%4 k, [0,0,255,0][(y*x)%4+1] cr from gray g)
select image_id, y, x, (case when k>0 then floor(value*0.3e0+cr*0.7e0) else value end)::int inference,
 (case when k>0 then floor(value*0.6e0+cr*0.4e0) else value end)::int generator,
 (case when k>0 then floor(value*0.5e0+cr*0.5e0) else value end)::int history, (case when k>0 then greatest(value,cr) else value end)::int brighter from c""")
def overlay_blend(spark, sf_dir):
    layer = masks.colorize(gray(spark, sf_dir).withColumn("class_id", F.col("y") * F.col("x") % 4))
    covered = F.col("class_id") > 0
    v, r = F.col("value"), F.col("r")
    return layer.select(
        "image_id", "y", "x",
        *[masks.overlay_colour(v, r, covered, kind).alias(kind) for kind in ("inference", "generator", "history")],
        masks.overlay_colour(v, r, covered, "max").alias("brighter"),
    )


@query("mask_dilation", "mask", """, m as (select distinct image_id, y+dy y, x+dx x, value c from mask, (values (-3,0),(-2,2),(-1,3),(0,3),(1,3),(2,2),(3,0)) d(dy,hw), range(-3,4) e(dx)
  where layer='truth' and value>0 and abs(dx)<=hw and y+dy between 0 and 39 and x+dx between 0 and 49)
 select image_id, y, c::int class_id, count(*)::bigint n from m group by all""")
def mask_dilation(spark, sf_dir):
    grown = metrics.dilate_runs(defects(spark, sf_dir, "truth"), 3, MASK_H, MASK_W)
    row = ("image_id", "class_id", "y")
    cover = raster.sweep(raster.run_events(grown, row, n=F.lit(1).cast("bigint")), row, ["n"]).where("n > 0")
    return cover.groupBy(*row).agg(F.sum(raster.length()).alias("n"))
