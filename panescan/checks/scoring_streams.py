"""Registered queries: pluggable scoring, end-to-end inspection, streams over the event table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from panescan.checks.derived import gray, r6, table
from panescan.checks.registry import registry
from panescan.operators import raster, scoring, summary
from panescan.plans.inspect import inspect
from panescan.schema import LABELS
from panescan.session import checkpoint_folder
from panescan.streaming import monitors

QUERIES, SQL, query = registry()
C = F.col


def level_scorer():
    """Scores by grey level alone, so SQL can follow: softmax of 2, 4v, 9v-3, 16v-9; dark corners fail."""

    def predict(images: np.ndarray) -> np.ndarray:
        if images[0, 0, 0] < 0.15:
            raise ValueError("dark corner")
        v = images.astype(np.float64)
        logits = np.stack([np.full_like(v, 2.0), 4 * v, 9 * v - 3, 16 * v - 9], axis=1)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


LEVEL = """, fl as (select image_id, y//4*2+x//4 patch_id, bool_or(y%4=0 and x%4=0 and value/255.0e0<0.15e0) bad from gray group by all),
 lv as (select g.image_id, (y//4*2+x//4)::bigint patch_id, y, x, bad, 2.0e0 l0, 4*value/255.0e0 l1, 9*value/255.0e0-3 l2, 16*value/255.0e0-9 l3 from gray g join fl on fl.image_id=g.image_id and fl.patch_id=y//4*2+x//4),
 ex as (select *, exp(l0) e0, exp(l1) e1, exp(l2) e2, exp(l3) e3 from lv)"""


def photo_tiles(spark, sf_dir, size=3):
    return raster.pixels_to_tiles(gray(spark, sf_dir).withColumn("layer", F.lit("photo")), size)


def photo_frames(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(C("vec_id").cast("bigint").alias("image_id"))
    return ids.select("image_id", *[F.lit(v).alias(c) for c, v in (("x", 0), ("y", 0), ("w", 8), ("h", 8))])


def cubic_scorer():
    """Scores that float32 holds exactly, q = level/256: 1-q, q(1-q), q*q(1-q), q*q*q."""

    def predict(images: np.ndarray) -> np.ndarray:
        if images[0, 0, 0] < 0.15:
            raise ValueError("dark corner")
        q = np.rint(images.astype(np.float64) * 255) / 256
        return np.stack([1 - q, q * (1 - q), q * q * (1 - q), q * q * q], axis=1)

    return predict


@query("score_patches", "gray", LEVEL + """select image_id, patch_id, y, x, 1-q p0, q*(1-q) p1, q*q*(1-q) p2, q*q*q p3 from (select lv.*, g.value/256.0e0 q from lv join gray g using (image_id, y, x)) where not bad""")
def score_patches(spark, sf_dir):
    patches = scoring.cut_patches(photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), 4, 0)
    px = scoring.score_pixels(scoring.score(patches, cubic_scorer))
    return px.select("image_id", "patch_id", "y", "x", *[C("probs")[i].alias(f"p{i}") for i in range(4)])


@query("score_status", "gray", LEVEL + """select image_id, patch_id::bigint patch_id, case when bad then 'error' else 'ok' end status, case when bad then 'ValueError: dark corner' end error from fl""")
def score_status(spark, sf_dir):
    patches = scoring.cut_patches(photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), 4, 0)
    return scoring.score(patches, level_scorer).select("image_id", "patch_id", "status", "error")


def stacked_scorer():
    """The cubic scorer over stacks: one dark corner fails the whole stack."""

    def predict(images: np.ndarray) -> np.ndarray:
        if (images[:, 0, 0] < 0.15).any():
            raise ValueError("dark corner")
        q = np.rint(images.astype(np.float64) * 255) / 256
        return np.stack([1 - q, q * (1 - q), q * q * (1 - q), q * q * q], axis=1)

    return predict


@query("score_stacked", None, SQL["score_patches"])
def score_stacked(spark, sf_dir):
    """Stacks of up to 32 patches, halved where a patch fails."""
    patches = scoring.cut_patches(photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), 4, 0)
    px = scoring.score_pixels(scoring.score(patches, stacked_scorer, stack_bytes=32 * 64))
    return px.select("image_id", "patch_id", "y", "x", *[C("probs")[i].alias(f"p{i}") for i in range(4)])


def sixteenths_scorer():
    """Scores in sixteenths, which the smooth resize keeps exact: 1-q, q, 0, 0."""

    def predict(images: np.ndarray) -> np.ndarray:
        q = np.rint(images.astype(np.float64) * 255) // 16 / 16
        return np.stack([1 - q, q, 0 * q, 0 * q], axis=1)

    return predict


KEYS = "case when d<=1 then 1.25e0*d*d*d-2.25e0*d*d+1 when d<2 then -0.75e0*(d*d*d-5*d*d+8*d-4) else 0 end"


@query("score_small_smooth", "gray", f""", a as (select image_id, y//4*2+x//4 patch_id, y%4//2 sy, x%4//2 sx, (2*sum(value)+4)//8//16/16.0e0 q from gray group by all),
 tap as (select t, least(1,greatest(0,s)) s, sum({KEYS}) k from (select t, s, abs((t+0.5e0)/2-0.5e0-s) d from range(4) u(t), range(-3,6) v(s)) group by all)
select image_id, patch_id::bigint patch_id, (patch_id//2*4+ty.t)::int y, (patch_id%2*4+tx.t)::int x, sum((1-q)*ty.k*tx.k) p0, sum(q*ty.k*tx.k) p1
 from a join tap ty on ty.s=sy join tap tx on tx.s=sx group by all""")
def score_small_smooth(spark, sf_dir):
    """Patches go to the model at half size by area mean; scores come back smoothly."""
    patches = scoring.cut_patches(photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), 4, 0)
    px = scoring.score_pixels(scoring.score(patches, sixteenths_scorer, (2, 2), "area", "cubic", 1 << 20))
    return px.select("image_id", "patch_id", "y", "x", C("probs")[0].alias("p0"), C("probs")[1].alias("p1"))


@query("class_check", "gray", LEVEL + """, n as (select count(*) filter (bad) errors from fl)
select m.model, m.k::int num_classes, errors::bigint errors, m.w warnings from n, (values ('four',4,[]::varchar[]),('two',2,['model has 2 classes but 4 names are given','model has only 2 classes'])) m(model,k,w)""")
def class_check(spark, sf_dir):
    """Two models checked against the four class names by what their scores turn out to hold."""
    patches = scoring.cut_patches(photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), 4, 0)
    found = None
    for model, scorer in (("four", level_scorer), ("two", pair_scorer)):
        checked = scoring.check_classes(scoring.score(patches, scorer), [n for n, _, _ in LABELS])[1].withColumn("model", F.lit(model))
        found = checked if found is None else found.unionByName(checked)
    return found


def pair_scorer():
    """The first two scores of the level scorer."""
    predict = level_scorer()
    return lambda images: predict(images)[:, :2]


CLS = LEVEL + """, cl as (select image_id, y, x, case when bad then 0 when l0>=l1 and l0>=l2 and l0>=l3 then 0 when l1>=l2 and l1>=l3 then 1 when l2>=l3 then 2 else 3 end c from lv)"""


@query("inspect_full_batch", "gray", CLS + """select image_id, 'pred' as layer, k::int class_id, ['background','condensation','dirt','scratch'][k+1] class_name, count(*) filter (c=k)::bigint pixels, round(count(*) filter (c=k)/64.0e0*100,6) percentage from cl, range(4) r(k) group by image_id, k""")
def inspect_full_batch(spark, sf_dir):
    out = inspect(photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), level_scorer, patch_size=4, overlap=0, tile=8)
    return out["class_stats"].select("image_id", "layer", "class_id", "class_name", "pixels", r6("percentage", "percentage"))


@query("inspect_patches_against_truth", "gray", CLS + """, tr as (select image_id, y, x, least(3, value//64)::int t from gray),
 j as (select cl.image_id*1048576+(cl.y//4*2+cl.x//4) image_id, c p, t from cl join tr using (image_id,y,x)),
 s as (select image_id, k, count(*) filter (p=k and t=k) i, count(*) filter (p=k) pn, count(*) filter (t=k) tn from j, range(4) r(k) group by all)
select image_id, k::int class_id, i::bigint inter, pn::bigint pred_n, tn::bigint true_n, round(case when pn+tn-i>0 then i/(pn+tn-i)::double else 1 end,6) iou, round(case when pn+tn>0 then 2*i/(pn+tn)::double else 1 end,6) dice from s""")
def inspect_patches_against_truth(spark, sf_dir):
    patch = F.floor(C("y") / 4) * 2 + F.floor(C("x") / 4)
    truth = gray(spark, sf_dir).select(
        "image_id", patch.alias("patch_id"), F.lit("truth").alias("layer"), (C("y") % 4).alias("y"), (C("x") % 4).alias("x"), F.least(F.lit(3), F.floor(C("value") / 64)).cast("int").alias("value")
    )
    out = inspect(
        photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), level_scorer, patch_size=4, overlap=0, tile=8, full=False, truth=raster.pixels_to_runs(truth, ("image_id", "patch_id", "layer"))
    )
    own = (C("image_id") * F.lit(1 << 20) + C("patch_id")).alias("image_id")
    return out["metrics"].select(own, "class_id", "inter", "pred_n", "true_n", r6("iou", "iou"), r6("dice", "dice"))


TRUTH_OF = """, tr as (select image_id, y//4*2+x//4 patch_id, y, x, least(3, value//64)::int t from gray),
 j as (select {unit}, c p, t from cl join tr using (image_id, y, x)),
 s as (select {keys}, k, count(*) filter (p=k and t=k) i, count(*) filter (p=k) pn, count(*) filter (t=k) tn from j, range(4) r(k) group by all)
select {keys}, k::int class_id, i::bigint inter, pn::bigint pred_n, tn::bigint true_n, round(case when pn+tn-i>0 then i/(pn+tn-i)::double else 1 end,6) iou, round(case when pn+tn>0 then 2*i/(pn+tn)::double else 1 end,6) dice from s where {where}"""
STATS_OF = """select {keys}, 'pred' as layer, k::int class_id, ['background','condensation','dirt','scratch'][k+1] class_name, count(*) filter (c=k)::bigint pixels,
 round(count(*) filter (c=k)*100.0e0/count(*),6) percentage from (select *, y//4*2+x//4 patch_id from cl), range(4) r(k) where {where} group by {keys}, k"""
ONE = 5  # the photo of the single modes


def mode(name: str, full: bool, truth: bool, single: bool) -> None:
    """Registers one mode of the inspection: its metrics where there is truth, its class shares where there is none."""
    keys = "image_id" if full else "image_id, patch_id"
    unit = keys if full else "image_id, patch_id::bigint patch_id"
    text = (TRUTH_OF if truth else STATS_OF.replace("{keys}, 'pred'", "{unit}, 'pred'")).format(keys=keys, unit=unit, where=f"image_id = {ONE}" if single else "true")

    @query(name, "gray", CLS + text)
    def run(spark, sf_dir):
        given = None
        if truth:
            y, x = (C("y"), C("x")) if full else (C("y") % 4, C("x") % 4)
            patch = (F.floor(C("y") / 4) * 2 + F.floor(C("x") / 4)).alias("patch_id")
            level = F.least(F.lit(3), F.floor(C("value") / 64)).cast("int").alias("value")
            own = ("image_id", "layer") if full else ("image_id", "patch_id", "layer")
            cells = gray(spark, sf_dir).select("image_id", patch, F.lit("truth").alias("layer"), y.alias("y"), x.alias("x"), level)
            given = raster.pixels_to_runs(cells, own)
        out = inspect(
            photo_tiles(spark, sf_dir), photo_frames(spark, sf_dir), level_scorer, patch_size=4, overlap=0, tile=8, full=full, truth=given, only_image=ONE if single else None
        )
        ids = keys.split(", ")
        if truth:
            return out["metrics"].select(*ids, "class_id", "inter", "pred_n", "true_n", r6("iou", "iou"), r6("dice", "dice"))
        return out["class_stats"].select(*ids, "layer", "class_id", "class_name", "pixels", r6("percentage", "percentage"))


mode("inspect_full_against_truth", full=True, truth=True, single=False)
mode("inspect_patches_batch", full=False, truth=False, single=False)
mode("inspect_full_one", full=True, truth=False, single=True)
mode("inspect_full_one_against_truth", full=True, truth=True, single=True)
mode("inspect_patches_one", full=False, truth=False, single=True)
mode("inspect_patches_one_against_truth", full=False, truth=True, single=True)


def bright_detector():
    """Boxes around the four brightest pixels of the small photo, confidence by level."""

    def predict(image: np.ndarray) -> np.ndarray:
        g = image[..., 0]
        best = np.argsort(-g.ravel().astype(int), kind="stable")[:4]
        y, x = best // g.shape[1], best % g.shape[1]
        return np.stack([x, y, x + 1, y + 1, g[y, x] / 255.0, np.zeros(len(y))], axis=1)

    return predict


@query("detect_boxes", "gray", """, sm as (select image_id, y//2 y, x//2 x, floor(avg(value)+0.5)::int v from gray group by all),
 d as (select *, row_number() over (partition by image_id order by v desc, y*4+x)-1 i from sm qualify i<4)
select image_id, i::bigint det_id, x*2.0e0 x0, y*2.0e0 y0, (x+1)*2.0e0 x1, (y+1)*2.0e0 y1, round(v/255.0e0,6) conf, (i+1)::int rank from d where v/255.0e0>=0.636e0""")
def detect_boxes(spark, sf_dir):
    photos = raster.pixels_to_tiles(gray(spark, sf_dir).withColumn("layer", F.lit("photo")), 8)
    found = scoring.detect(photos, bright_detector, 2).where("status = 'ok'")
    return summary.top_detections(found).select("image_id", "det_id", "x0", "y0", "x1", "y1", r6("conf", "conf"), "rank")


# ------------------------------------------------------------------------------ streams
def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", C("ts").cast("timestamp"))


def run_folder(spark, name):
    return f"{checkpoint_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def window_sql(step):
    return f"""with w as (select ts, event_type, value, time_bucket(interval '{step} minutes', ts, timestamp '1970-01-01')::timestamp b from events),
 s as (select b + to_minutes(-k*{step}) window_start, b + to_minutes(-k*{step}+10) window_end, event_type, value from w, range({10 // step}) r(k))
select strftime(window_start, '%Y-%m-%d %H:%M:%S') window_start, event_type, count(*)::bigint n, round(avg(value),6) "avg", round(stddev_pop(value),6) std, round(min(value),6) "min", round(max(value),6) "max"
 from s group by all having max(window_end) <= (select max(ts) - interval '10 minutes' from events)"""


def summary_stream(spark, sf_dir, name, slide):
    stream = monitors.running_summary(event_stream(spark, sf_dir), "value", ["event_type"], "10 minutes", slide)
    out = monitors.drain(stream, run_folder(spark, name))
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", *[r6(c, c) for c in ("avg", "std", "min", "max")]
    )


@query("stream_summary_tumbling", None, window_sql(10))
def stream_summary_tumbling(spark, sf_dir):
    return summary_stream(spark, sf_dir, "tumbling", None)


@query("stream_summary_sliding", None, window_sql(5))
def stream_summary_sliding(spark, sf_dir):
    return summary_stream(spark, sf_dir, "sliding", "5 minutes")


@query("stream_memory_alarms", None, """select user_id::bigint run_id, count(*)::bigint samples, round(arg_min(value,row(ts,event_id)),6) first_mb, round(arg_max(value,row(ts,event_id)),6) last_mb, round(max(value),6) peak_mb,
 round(arg_max(value,row(ts,event_id))-arg_min(value,row(ts,event_id)),6) increase, max(value)-arg_min(value,row(ts,event_id))>20 alarm from events group by user_id""")
def stream_memory_alarms(spark, sf_dir):
    samples = event_stream(spark, sf_dir).select(C("user_id").cast("bigint").alias("run_id"), "ts", C("event_id").cast("bigint").alias("tie"), C("value").alias("mb"))
    out = monitors.drain(monitors.memory_alarms(samples, 20.0), run_folder(spark, "memory"))
    return out.select("run_id", "samples", *[r6(c, c) for c in ("first_mb", "last_mb", "peak_mb", "increase")], "alarm")


@query("stream_early_stops", None, """with o as (select user_id::bigint run_id, event_id::bigint epoch, value, row_number() over (partition by user_id order by event_id) k from events),
 f as (select run_id, 1::bigint k, value best, 0::bigint c, null::bigint stop from o where k=1 union all
  select f.run_id, o.k, case when o.value < f.best-5 then o.value else f.best end, case when o.value < f.best-5 then 0 else f.c+1 end,
   coalesce(f.stop, case when (case when o.value < f.best-5 then 0 else f.c+1 end)>=12 then o.epoch end) from f join o on o.run_id=f.run_id and o.k=f.k+1)
select run_id, max(stop)::bigint stop_epoch from f where stop is not null group by run_id""".replace("with ", "with recursive ", 1))
def stream_early_stops(spark, sf_dir):
    epochs = event_stream(spark, sf_dir).select(C("user_id").cast("bigint").alias("run_id"), C("event_id").cast("bigint").alias("epoch"), "value")
    return monitors.drain(monitors.early_stops(epochs, 12, 5.0), run_folder(spark, "stops"))
