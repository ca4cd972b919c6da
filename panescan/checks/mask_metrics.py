"""Registered queries: class masks against truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan.checks.derived import MASK_H, MASK_W, class_runs, r6, table
from panescan.checks.registry import registry
from panescan.operators import metrics, raster, summary

QUERIES, SQL, query = registry()

JOINED = """, j as (select p.image_id, p.y, p.x, p.value p, t.value t from
 (select * from mask where layer='pred') p join (select * from mask where layer='truth') t using (image_id,y,x)),
cls as (select * from range(4) c(class_id)),
s as (select image_id, class_id, count(*) filter (p=class_id and t=class_id) i, count(*) filter (p=class_id) pn,
 count(*) filter (t=class_id) tn from j, cls group by all)
"""


def counts(spark, sf_dir):
    return metrics.confusion_counts(raster.overlay(class_runs(spark, sf_dir), "pred", "truth"))


@query("class_stats", "mask", """, c as (select image_id, layer, class_id, count(*) filter (value=class_id) n
  from mask, range(4) r(class_id) group by all)
select image_id, layer, class_id::int class_id, ['background','condensation','dirt','scratch'][class_id+1] class_name,
 n::bigint pixels, round(n/2000.0e0*100,6) percentage from c""")
def class_stats(spark, sf_dir):
    return summary.class_stats(class_runs(spark, sf_dir), MASK_H * MASK_W).select(
        "image_id", "layer", "class_id", "class_name", "pixels", r6("percentage", "percentage")
    )


@query("class_stats_empty_masks", "mask", """, c as (select image_id, layer, class_id, count(*) filter (case when image_id%3=0 then 0 else value end=class_id) n
  from mask, range(4) r(class_id) group by all)
select image_id, layer, class_id::int class_id, ['background','condensation','dirt','scratch'][class_id+1] class_name,
 n::bigint pixels, round(n/2000.0e0*100,6) percentage from c""")
def class_stats_empty_masks(spark, sf_dir):
    """Every third image has no run at all; its masks are listed and so are all background."""
    runs = class_runs(spark, sf_dir)
    masks = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("image_id"), F.explode(F.array(F.lit("pred"), F.lit("truth"))).alias("layer")
    )
    return summary.class_stats(runs.where("image_id % 3 <> 0"), MASK_H * MASK_W, masks=masks).select(
        "image_id", "layer", "class_id", "class_name", "pixels", r6("percentage", "percentage")
    )


@query("class_distribution", "mask", """select value::int class_id, count(*)::bigint pixels,
 round(count(*)/sum(count(*)) over ()::double,6) share from mask group by value""")
def class_distribution(spark, sf_dir):
    return summary.class_distribution(class_runs(spark, sf_dir)).select("class_id", "pixels", r6("share", "share"))


@query("aligned_truth", "mask", JOINED + """select image_id, y, p pred, t truth, count(*)::bigint n from j group by all""")
def aligned_truth(spark, sf_dir):
    seg = raster.overlay(class_runs(spark, sf_dir), "pred", "truth")
    return seg.groupBy("image_id", "y", F.col("a").cast("int").alias("pred"), F.col("b").cast("int").alias("truth")).agg(
        F.sum(raster.length()).alias("n")
    )


@query("confusion_matrix", "mask", JOINED + """, g as (select image_id, a.c truth, b.c pred,
  count(*) filter (t=a.c and p=b.c) n from j, range(4) a(c), range(4) b(c) group by all)
select image_id, truth::int truth, pred::int pred, n::bigint n,
  case when sum(n) over (partition by image_id,truth)>0 then round(n/(sum(n) over (partition by image_id,truth))::double,6) end share from g""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(counts(spark, sf_dir), 4).select("image_id", "truth", "pred", "n", r6("share", "share"))


@query("iou_dice", "mask", JOINED + """select image_id, class_id::int class_id, i::bigint inter, pn::bigint pred_n, tn::bigint true_n,
 round(case when pn+tn-i>0 then i/(pn+tn-i)::double else 1 end,6) iou, round(2*i/(pn+tn+1e-8),6) dice from s""")
def iou_dice(spark, sf_dir):
    return metrics.iou_dice(counts(spark, sf_dir), 4).select(
        "image_id", "class_id", "inter", "pred_n", "true_n", r6("iou", "iou"), r6("dice", "dice")
    )


@query("mean_iou_dice", "mask", JOINED + """select image_id, round(avg(case when pn+tn-i>0 then i/(pn+tn-i)::double else 1 end),6) mean_iou,
 round(avg(2*i/(pn+tn+1e-8)),6) mean_dice from s where class_id<>0 group by image_id""")
def mean_iou_dice(spark, sf_dir):
    per_class = metrics.iou_dice(counts(spark, sf_dir), 4, ignore=0)
    return metrics.mean_iou_dice(per_class).select("image_id", r6("mean_iou", "mean_iou"), r6("mean_dice", "mean_dice"))


@query("full_metrics", "mask", JOINED + """select image_id, ['background','condensation','dirt','scratch'][class_id+1] class_name,
 i::bigint intersection_pixels, pn::bigint predicted_pixels, tn::bigint truth_pixels,
 round(case when pn+tn-i>0 then i/(pn+tn-i)::double else 1 end,6) iou, round(case when pn+tn>0 then 2*i/(pn+tn)::double else 1 end,6) dice from s""")
def full_metrics(spark, sf_dir):
    return metrics.full_metrics(counts(spark, sf_dir), 4).select(
        "image_id", "class_name", F.col("inter").alias("intersection_pixels"), F.col("pred_n").alias("predicted_pixels"),
        F.col("true_n").alias("truth_pixels"), r6("iou", "iou"), r6("dice", "dice"),
    )


DISC = "(values (-3,0),(-2,2),(-1,3),(0,3),(1,3),(2,2),(3,0)) d(dy,hw)"


def dilated(bottom: str, right: str) -> str:
    return f""", grown as (select distinct image_id, layer, value class_id, y+dy y, x+dx x from mask,
   {DISC}, range(-3,4) e(dx) where abs(dx)<=hw and y+dy between 0 and {bottom} and x+dx between 0 and {right}),
s as (select image_id, class_id, count(*) filter (n=2) i, count(*) filter (p) pn, count(*) filter (t) tn from
 (select image_id, class_id, y, x, count(*) n, bool_or(layer='pred') p, bool_or(layer='truth') t from grown group by all) group by all)
select image_id, class_id::int class_id, round(case when pn>0 and tn>0 then i/(pn+tn-i)::double else 0 end,6) iou,
 round(case when pn>0 and tn>0 then 2*i/(pn+tn)::double else 0 end,6) dice from s"""


@query("dilated_metrics", "mask", dilated("39", "49"))
def dilated_metrics(spark, sf_dir):
    sums = metrics.dilated_sums(class_runs(spark, sf_dir), "pred", "truth", 3, MASK_H, MASK_W)
    return metrics.dilated_metrics(sums).select("image_id", "class_id", r6("iou", "iou"), r6("dice", "dice"))


@query("dilated_metrics_by_frame", "mask", dilated("39+image_id%3", "49+image_id%4"))
def dilated_metrics_by_frame(spark, sf_dir):
    """Frames that reach beyond the masks by up to two rows and three columns, by image."""
    h, w = MASK_H + F.col("image_id") % 3, MASK_W + F.col("image_id") % 4
    sums = metrics.dilated_sums(class_runs(spark, sf_dir), "pred", "truth", 3, h, w)
    return metrics.dilated_metrics(sums).select("image_id", "class_id", r6("iou", "iou"), r6("dice", "dice"))


@query("binary_pixel_metrics", "mask", JOINED + """, b as (select image_id, count(*) filter (p>0 and t>0) tp,
 count(*) filter (p>0 and t=0) fp, count(*) filter (p=0 and t>0) fn from j group by 1)
select image_id, tp::bigint tp, fp::bigint fp, fn::bigint fn, round(case when tp+fp>0 then tp/(tp+fp)::double else 0 end,6) "precision",
 round(case when tp+fn>0 then tp/(tp+fn)::double else 0 end,6) recall, round(case when tp+fp+fn>0 then tp/(tp+fp+fn)::double else 0 end,6) iou,
 round(case when 2*tp+fp+fn>0 then 2*tp/(2*tp+fp+fn)::double else 0 end,6) dice from b""")
def binary_pixel_metrics(spark, sf_dir):
    seg = raster.overlay(class_runs(spark, sf_dir), "pred", "truth")
    out = metrics.binary_metrics(seg, F.col("a") > 0, F.col("b") > 0, ["image_id"], raster.length())
    return out.select("image_id", "tp", "fp", "fn", *[r6(c, c) for c in ("precision", "recall", "iou", "dice")])
