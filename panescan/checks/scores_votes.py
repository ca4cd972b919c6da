"""Registered queries: class scores, voting, patch and batch summaries, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan import schema
from panescan.checks.derived import class_runs, paths, r6, score_pixels, table
from panescan.checks.registry import registry
from panescan.functions import scores as sc
from panescan.operators import metrics, raster, summary, voting

QUERIES, SQL, query = registry()
C = F.col
P = ("p0", "p1", "p2", "p3")


def split_probs(name="probs"):
    return [r6(F.col(name)[i], p) for i, p in enumerate(P)]


@query("softmax_argmax", "score", ", c as (select * from scorec) select image_id, patch_id, y, x, cls::int class_id, " + ", ".join(f"round({p},6) {p}" for p in P) + " from c")
def softmax_argmax(spark, sf_dir):
    return score_pixels(spark, sf_dir).select("image_id", "patch_id", "y", "x", sc.argmax(C("probs")).alias("class_id"), *split_probs())


STATUS = "case when (image_id*16+patch_id)%11=0 then 'error' else 'ok' end"


def with_status(df):
    return df.withColumn("status", F.when((C("image_id") * 16 + C("patch_id")) % 11 == 0, "error").otherwise("ok"))


VOTE = f""", ok as (select * from scorec where {STATUS}='ok' and y<12 and x<12),
 fr as (select i.image_id, y::int y, x::int x from (select distinct image_id from score) i, range(12) a(y), range(12) b(x)),
 vt as (select f.image_id, f.y, f.x, greatest(count(o.p0),1) n, coalesce(sum(p0),0)/greatest(count(o.p0),1) p0, coalesce(sum(p1),0)/greatest(count(o.p0),1) p1,
   coalesce(sum(p2),0)/greatest(count(o.p0),1) p2, coalesce(sum(p3),0)/greatest(count(o.p0),1) p3,
   count(*) filter (cls=0)/greatest(count(o.p0),1)::double h0, count(*) filter (cls=1)/greatest(count(o.p0),1)::double h1, count(*) filter (cls=2)/greatest(count(o.p0),1)::double h2,
   count(*) filter (cls=3)/greatest(count(o.p0),1)::double h3 from fr f left join ok o on o.image_id=f.image_id and o.y=f.y and o.x=f.x group by all),
 vc as (select *, case when p0>=p1 and p0>=p2 and p0>=p3 then 0 when p1>=p2 and p1>=p3 then 1 when p2>=p3 then 2 else 3 end cls from vt)
"""


def vote_frames(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 16").cast("bigint").alias("image_id")).distinct()
    return ids.select("image_id", F.lit(12).alias("h"), F.lit(12).alias("w"))


def voted(spark, sf_dir):
    inside = with_status(score_pixels(spark, sf_dir))
    return voting.vote_pixels(inside, vote_frames(spark, sf_dir))


@query("vote_pixels", "score", VOTE + "select image_id, y, x, n::bigint n, cls::int class_id, " + ", ".join(f"round({p},6) {p}" for p in P)
       + ", " + ", ".join(f"round(h{i},6) h{i}" for i in range(4)) + " from vc")
def vote_pixels(spark, sf_dir):
    v = voted(spark, sf_dir)
    return v.select("image_id", "y", "x", "n", "class_id", *split_probs(), *[r6(C("votes")[i], f"h{i}") for i in range(4)])


@query("vote_tiles", "score", VOTE + "select image_id, y, x, cls::int as value from vc")
def vote_tiles(spark, sf_dir):
    """The same vote on packed patches and 5-pixel frame tiles."""
    packed = with_status(voting.pack_patches(score_pixels(spark, sf_dir)).drop("status"))
    tiles = voting.vote_tiles(packed, vote_frames(spark, sf_dir), 5)
    return raster.tiles_to_pixels(tiles.drop("probs", "cover")).drop("layer")


PCT = f""", pp as (select image_id, patch_id, {STATUS} status, count(*) pixels, {', '.join(f'count(*) filter (cls={c})/count(*)::double*100 pct{c}' for c in range(4))} from scorec group by image_id, patch_id)"""


def patch_rows(spark, sf_dir):
    px = score_pixels(spark, sf_dir).withColumn("class_id", sc.argmax(C("probs")))
    return with_status(summary.patch_class_shares(px))


@query("patch_stats", "score", PCT + """ select image_id, count(*)::bigint total_patches, count(*) filter (status='ok')::bigint valid_patches,
  count(*) filter (status='ok' and pct1+pct2+pct3>0.01e0)::bigint patches_with_defects, """
       + ", ".join(f"round(avg(case when status='ok' then pct{c} end),6) avg{c}, round(max(case when status='ok' then pct{c} end),6) max{c}, round(min(case when status='ok' then pct{c} end),6) min{c}, round(stddev_pop(case when status='ok' then pct{c} end),6) std{c}" for c in range(4))
       + " from pp group by image_id")
def patch_stats(spark, sf_dir):
    out = summary.patch_stats(patch_rows(spark, sf_dir))
    return out.select("image_id", "total_patches", "valid_patches", "patches_with_defects", *[r6(f"{k}{c}", f"{k}{c}") for c in range(4) for k in ("avg", "max", "min", "std")])


@query("confidence_bands", "score", VOTE + " select image_id, max(n)::bigint max_cover, min(n)::bigint min_cover, round(avg(n),6) avg_cover, c::int class_id, round(avg(p),6) avg_confidence, round(max(p),6) max_confidence, count(*) filter (p>0.8e0)::bigint high, count(*) filter (p>0.5e0 and p<=0.8e0)::bigint medium, count(*) filter (p<=0.5e0)::bigint low from (select image_id, n, unnest([p0,p1,p2,p3]) p, unnest([0,1,2,3]) c from vc) group by image_id, c")
def confidence_bands(spark, sf_dir):
    out = summary.confidence_bands(voted(spark, sf_dir))
    return out.select("image_id", "max_cover", "min_cover", r6("avg_cover", "avg_cover"), "class_id", r6("avg_confidence", "avg_confidence"), r6("max_confidence", "max_confidence"), "high", "medium", "low")


@query("top_scores", "score", VOTE + "select image_id, y, x, round(greatest(p0,p1,p2,p3),6) top_all, round(greatest(p1,p2,p3),6) top_defect from vc")
def top_scores(spark, sf_dir):
    return voted(spark, sf_dir).select(
        "image_id", "y", "x", r6(summary.top_score(C("probs")), "top_all"), r6(summary.top_score(C("probs"), True), "top_defect")
    )


@query("perf_stats", None, """select user_id::bigint run_id, round(coalesce(sum(v),0),6) total_time, round(coalesce(avg(v),0),6) avg_time,
 round(case when sum(v)>0 then count(v)/sum(v) else 0 end,6) per_second from (select user_id, case when event_id%4=0 then null else abs(value)/100 end v from events) group by 1""")
def perf_stats(spark, sf_dir):
    seconds = F.when(C("event_id") % 4 != 0, F.abs("value") / 100)
    out = summary.perf_stats(table(spark, sf_dir, "events").withColumn("run_id", C("user_id").cast("bigint")), seconds, ["run_id"])
    return out.select("run_id", *[r6(c, c) for c in ("total_time", "avg_time", "per_second")])


IMG = f""", im as (select image_id, layer, {', '.join(f'count(*) filter (value={c})/2000.0e0*100 pct{c}' for c in range(4))} from mask group by image_id, layer)"""


def image_shares(spark, sf_dir):
    stats = summary.class_stats(class_runs(spark, sf_dir), 2000)
    return stats.groupBy("image_id", "layer").agg(*[F.max(F.when(C("class_id") == c, C("percentage"))).alias(f"pct{c}") for c in range(4)])


@query("batch_summary", "mask", IMG + " select layer, count(*)::bigint total_images, c::int class_id, ['background','condensation','dirt','scratch'][c+1] class_name, round(avg(p),6) \"avg\", round(stddev_pop(p),6) std, round(min(p),6) \"min\", round(max(p),6) \"max\", round(median(p),6) median from (select layer, unnest([pct0,pct1,pct2,pct3]) p, unnest([0,1,2,3]) c from im) group by layer, c")
def batch_summary(spark, sf_dir):
    out = summary.batch_summary(image_shares(spark, sf_dir), ["layer"])
    return out.select("layer", "total_images", "class_id", "class_name", *[r6(c, c) for c in ("avg", "std", "min", "max", "median")])


@query("truth_batch_summary", None, """with r as (select d.doc_id, d.source, case when l.doc_id is null then 'error' else 'completed' end status, case when n_chars%3=0 then 'binary' else 'multiclass' end sample_type,
  (n_chars%101)/100.0e0 mean_iou, (n_chars%89)/88.0e0 mean_dice, (n_chars%7)/6.0e0 pr, greatest(0,(n_chars%50)-25)/25.0e0 dirt_iou from documents d left join labels l using (doc_id))
select source, count(*)::bigint total_samples, count(*) filter (status='completed')::bigint successful_samples, count(*) filter (status='error')::bigint error_samples,
 count(*) filter (status='completed' and sample_type='multiclass')::bigint multiclass_samples, count(*) filter (status='completed' and sample_type='binary')::bigint binary_samples,
 round(avg(mean_iou) filter (status='completed'),6) avg_mean_iou, round(stddev_pop(mean_iou) filter (status='completed'),6) std_mean_iou, round(min(mean_iou) filter (status='completed'),6) min_mean_iou,
 round(max(mean_iou) filter (status='completed'),6) max_mean_iou, round(avg(mean_dice) filter (status='completed'),6) avg_mean_dice, round(avg(pr) filter (status='completed' and sample_type='binary'),6) avg_precision,
 round(avg(dirt_iou) filter (status='completed' and dirt_iou>0),6) avg_dirt_iou from r group by source""")
def truth_batch_summary(spark, sf_dir):
    n = C("n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("completed").alias("found"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left").select(
        "source", F.coalesce("found", F.lit("error")).alias("status"), F.when(n % 3 == 0, "binary").otherwise("multiclass").alias("sample_type"),
        (n % 101 / 100.0).alias("mean_iou"), (n % 89 / 88.0).alias("mean_dice"), (n % 7 / 6.0).alias("precision"), (F.greatest(F.lit(0), n % 50 - 25) / 25.0).alias("dirt_iou"),
    )
    out = summary.truth_batch_summary(rows, ["dirt_iou"], ["source"])
    counts = [c for c in out.columns if c.endswith("samples")]
    return out.select("source", *counts, *[r6(c, c) for c in out.columns if c not in counts and c != "source"])


@query("binary_label_metrics", None, """with j as (select source, quality=1 p, toxic=1 t from documents join labels using (doc_id)), s as (select source, count(*) filter (p and t) tp, count(*) filter (p and not t) fp, count(*) filter (not p and t) fn from j group by 1)
select source, tp::bigint tp, fp::bigint fp, fn::bigint fn, round(case when tp+fp>0 then tp/(tp+fp)::double else 0 end,6) "precision", round(case when tp+fn>0 then tp/(tp+fn)::double else 0 end,6) recall,
 round(case when tp+fp+fn>0 then tp/(tp+fp+fn)::double else 0 end,6) iou, round(case when 2*tp+fp+fn>0 then 2*tp/(2*tp+fp+fn)::double else 0 end,6) dice from s""")
def binary_label_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    out = metrics.binary_metrics(rows, C("quality") == 1, C("toxic") == 1, ["source"])
    return out.select("source", "tp", "fp", "fn", *[r6(c, c) for c in ("precision", "recall", "iou", "dice")])


@query("source_stats", "paths", """, s as (select split_part(path,'/',1) as source, split_part(path,'/',1)||'/'||split_part(path,'/',2) as source_key from paths where path like '%/patch\\_%' escape '\\')
select source, count(*)::bigint patches, count(distinct source_key)::bigint sources from s group by rollup(source)""")
def source_stats(spark, sf_dir):
    parts = F.split("path", "/")
    rows = paths(spark, sf_dir).where(C("path").contains("/patch_")).select(parts[0].alias("source"), F.concat_ws("/", parts[0], parts[1]).alias("source_key"))
    return summary.source_stats(rows)


@query("dataset_totals", "mask", """, t as (select image_id, count(*) total_pixels, count(*) filter (value=1) n1, count(*) filter (value=2) n2, count(*) filter (value=3) n3, image_id%17 placed from mask where layer='truth' group by image_id)
select count(*)::bigint images, sum(total_pixels)::bigint pixels, round(avg(placed),6) avg_placed, sum(n1)::bigint n1, sum(n2)::bigint n2, sum(n3)::bigint n3, round(sum(n1)/sum(total_pixels)::double*100,6) pct1,
 round(sum(n2)/sum(total_pixels)::double*100,6) pct2, round(sum(n3)/sum(total_pixels)::double*100,6) pct3 from t""")
def dataset_totals(spark, sf_dir):
    stats = class_runs(spark, sf_dir).where("layer = 'truth'").groupBy("image_id").agg(
        F.sum(raster.length()).alias("total_pixels"), *[F.sum(F.when(C("class_id") == c, raster.length()).otherwise(0)).alias(f"n{c}") for c in (1, 2, 3)]
    ).withColumn("placed", C("image_id") % 17)
    return summary.dataset_totals(stats).select("images", "pixels", r6("avg_placed", "avg_placed"), "n1", "n2", "n3", *[r6(f"pct{c}", f"pct{c}") for c in (1, 2, 3)])


CROPS = """, cr as (select image_id, patch_id, max(p1) confidence, case when image_id%9=0 then 'error' else 'ok' end status from score group by all),
 ic as (select image_id, round(max(confidence),3) confidence from cr where status='ok' group by image_id)"""


def crop_scores(spark, sf_dir):
    return score_pixels(spark, sf_dir).groupBy("image_id", "patch_id").agg(F.max(C("probs")[1]).alias("confidence")).withColumn(
        "status", F.when(C("image_id") % 9 == 0, "error").otherwise("ok")
    )


@query("image_confidence", "score", CROPS + "select * from ic")
def image_confidence(spark, sf_dir):
    return summary.image_confidence(crop_scores(spark, sf_dir))


@query("detection_ratio", "score", CROPS + "select count(*)::bigint images, count(*) filter (confidence>0.32e0)::bigint detected, round(100.0e0*count(*) filter (confidence>0.32e0)/count(*),2) ratio from ic")
def detection_ratio(spark, sf_dir):
    return summary.detection_ratio(summary.image_confidence(crop_scores(spark, sf_dir)), 0.32)


W = [0.3, 1.0, 1.0, 1.2]


@query("score_losses", "score", """, b as (select *, [0.3e0,1.0e0,1.0e0,1.2e0][truth+1] w, [p0,p1,p2,p3][truth+1] pt from score),
 s as (select image_id, count(*) n, sum(-w*ln(pt))/sum(w) ce, sum(w*pow(1-pt,2)*-ln(pt))/count(*) focal, """
       + ", ".join(f"sum(case when truth={c} then p{c} else 0 end) i{c}, sum(p{c}) s{c}, count(*) filter (truth={c}) t{c}" for c in range(4))
       + """ from b group by image_id), d as (select *, 1-(""" + "+".join(f"(2*i{c}+1e-6)/(s{c}+t{c}+1e-6)" for c in range(4)) + """)/4.0e0 dice_loss from s)
select image_id, n::bigint n, round(ce,6) ce, round(dice_loss,6) dice_loss, round(focal,6) focal, round(0.5e0*ce+0.3e0*dice_loss+0.2e0*focal,6) combined from d""")
def score_losses(spark, sf_dir):
    out = metrics.score_losses(score_pixels(spark, sf_dir), schema.LOSS_WEIGHTS, keys=["image_id"])
    return out.select("image_id", "n", *[r6(c, c) for c in ("ce", "dice_loss", "focal", "combined")])


@query("binary_losses", "score", """, b as (select image_id, p1+p2+p3 p, (truth>0)::int t from score), s as (select image_id, avg(-(t*ln(p)+(1-t)*ln(1-p))) bce, 1-(2*sum(p*t)+1)/(sum(p)+sum(t)+1) d from b group by 1)
select image_id, round(bce,6) bce, round(d,6) dice_loss, round(0.5e0*bce+0.5e0*d,6) combined from s""")
def binary_losses(spark, sf_dir):
    p = C("probs")[1] + C("probs")[2] + C("probs")[3]
    out = metrics.binary_losses(score_pixels(spark, sf_dir), p, C("truth") > 0, keys=["image_id"])
    return out.select("image_id", *[r6(c, c) for c in ("bce", "dice_loss", "combined")])


@query("defect_histogram", "score", PCT + """, e as (select min(least(pct2,pct3)) lo, max(greatest(pct2,pct3)) hi from pp), l as (select 'pct2' series, pct2 v from pp union all select 'pct3', pct3 from pp)
select series, least(14, case when hi>lo then floor((v-lo)/((hi-lo)/15.0e0)) else 0 end)::int bin, count(*)::bigint n from l, e group by all""")
def defect_histogram(spark, sf_dir):
    return summary.equal_width_histogram(patch_rows(spark, sf_dir), ["pct2", "pct3"], 15)


@query("visible_shares", "mask", """select image_id, value::int class_id, round(count(*)/2000.0e0*100,6) percentage from mask where layer='pred' group by all having count(*)/2000.0e0*100>5""")
def visible_shares(spark, sf_dir):
    stats = summary.class_stats(class_runs(spark, sf_dir).where("layer = 'pred'"), 2000, ["image_id"])
    return summary.visible_shares(stats, 5.0).select("image_id", "class_id", r6("percentage", "percentage"))


@query("top_detections", "score", """, d as (select image_id, patch_id*16+(y%4)*4+x%4 + 1000*y + x det_id, p2 conf from score)
select image_id, det_id::bigint det_id, round(conf,6) conf, row_number() over (partition by image_id order by conf desc, det_id)::int rank from d where conf>=0.26e0 qualify row_number() over (partition by image_id order by conf desc, det_id)<=15""")
def top_detections(spark, sf_dir):
    det = (C("patch_id") * 16 + (C("y") % 4) * 4 + C("x") % 4 + 1000 * C("y") + C("x")).cast("bigint")
    found = score_pixels(spark, sf_dir).select("image_id", det.alias("det_id"), C("probs")[2].alias("conf"))
    return summary.top_detections(found, 0.26, 15).select("image_id", "det_id", r6("conf", "conf"), "rank")
