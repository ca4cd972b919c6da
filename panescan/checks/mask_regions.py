"""Registered queries: connected regions, object matching, device boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan.checks.derived import class_runs, gray, r6
from panescan.checks.registry import registry
from panescan.operators import gray as g
from panescan.operators import masks, raster, regions

QUERIES, SQL, query = registry()
C = F.col


def region_ctes(source: str, reach: int = 0) -> str:
    """Runs and their components by a recursive label walk; ``source`` has image_id, layer, c, y, x."""
    return f""", rr as (select image_id, layer, c, y, min(x) x0, max(x) x1 from (select *, x-row_number() over (partition by image_id,layer,c,y order by x) k from {source}) group by image_id, layer, c, y, k),
 n as (select *, y*16777216+x0 id from rr),
 e as (select a.image_id, a.layer, a.c, a.id u, b.id v from n a join n b on a.image_id=b.image_id and a.layer=b.layer and a.c=b.c and b.y=a.y+1 and b.x0<=a.x1+{reach} and a.x0<=b.x1+{reach}),
 ee as (select * from e union all select image_id, layer, c, v, u from e),
 walk as (select image_id, layer, c, id, id r from n union select w.image_id, w.layer, w.c, ee.v, w.r from walk w join ee on ee.image_id=w.image_id and ee.layer=w.layer and ee.c=w.c and ee.u=w.id where w.r<ee.v),
 lab as (select image_id, layer, c, id, min(r) region from walk group by all),
 lr as (select n.*, region from n join lab using (image_id, layer, c, id)),
 reg as (select image_id, layer, c::int class_id, region::bigint region, sum(x1-x0+1)::bigint area, min(y)::int min_y, min(x0)::int min_x, max(y)::int max_y, max(x1)::int max_x,
   sum((x1-x0+1)*y)::double/sum(x1-x0+1) cy, sum((x1-x0+1)*(x0+x1)/2.0e0)/sum(x1-x0+1) cx from lr group by image_id, layer, c, region)
"""


def recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


DEFECT = ", dm as (select image_id, layer, value c, y, x from mask where value>0)"
COLS = ["image_id", "layer", "class_id", "region", "area", "min_y", "min_x", "max_y", "max_x"]
REGION_SELECT = "select image_id, layer, class_id, region, area, min_y, min_x, max_y, max_x, round(cy,6) cy, round(cx,6) cx from reg"


def region_query(name, connectivity, block, min_area=0):
    @query(name, "mask", DEFECT + region_ctes("dm", 0 if connectivity == 4 else 1) + REGION_SELECT + f" where area>={min_area}")
    def run(spark, sf_dir):
        found = regions.connected_regions(class_runs(spark, sf_dir), connectivity, min_area, block)
        return found.select(*COLS, r6("cy", "cy"), r6("cx", "cx"))


region_query("connected_regions", 4, 1024)
region_query("connected_regions_across_blocks", 4, 16)
region_query("connected_regions_corners", 8, 16)
region_query("objects", 4, 1024, 10)


@query("region_summary", "mask", DEFECT + region_ctes("dm") + """, w as (select distinct image_id, layer, k.c from mask, (values (1),(2),(3)) k(c))
select w.image_id, w.layer, w.c::int class_id, count(area)::bigint num, coalesce(sum(area),0)::bigint total, coalesce(max(area),0)::bigint largest, coalesce(min(area),0)::bigint smallest,
 round(coalesce(avg(area),0),6) mean, round(coalesce(median(area),0),6) median from w left join reg r on r.image_id=w.image_id and r.layer=w.layer and r.class_id=w.c group by all""")
def region_summary(spark, sf_dir):
    runs = class_runs(spark, sf_dir)
    found = regions.connected_regions(runs)
    return regions.region_summary(found, runs.select("image_id", "layer").distinct()).select(
        "image_id", "layer", "class_id", "num", "total", "largest", "smallest", r6("mean", "mean"), r6("median", "median")
    )


@query("combined_defect_regions", "mask", ", dm as (select image_id, layer, 1 c, y, x from mask where value>0)" + region_ctes("dm")
       + "select image_id, layer, region, area, min_y, min_x, max_y, max_x from reg")
def combined_defect_regions(spark, sf_dir):
    union = masks.binary_union(class_runs(spark, sf_dir), ("image_id", "layer"))
    return regions.connected_regions(union, 4, 0, 32).select("image_id", "layer", "region", "area", "min_y", "min_x", "max_y", "max_x")


@query("largest_region", "mask", DEFECT + region_ctes("dm") + """select image_id, layer, class_id, region, area from reg
 qualify row_number() over (partition by image_id, layer order by area desc, region, class_id)=1""")
def largest_region(spark, sf_dir):
    return regions.largest_region(regions.connected_regions(class_runs(spark, sf_dir)))


PAIRS = """, obj as (select * from reg where area>=10),
 px as (select image_id, layer, c, y, unnest(range(x0,x1+1)) x, region from lr),
 ov as (select p.image_id, p.c, p.region p, t.region t, count(*) inter from (select * from px where layer='pred') p join (select * from px where layer='truth') t using (image_id,c,y,x) group by all),
 pr as (select ov.image_id, ov.c::int class_id, p::bigint p, t::bigint t, inter/(a.area+b.area-inter)::double iou from ov
   join obj a on a.image_id=ov.image_id and a.class_id=ov.c and a.region=p and a.layer='pred' join obj b on b.image_id=ov.image_id and b.class_id=ov.c and b.region=t and b.layer='truth')
"""


def matched(spark, sf_dir, threshold):
    labelled = regions.label_runs(class_runs(spark, sf_dir))
    found = regions.measure(labelled, 10)
    pairs = regions.iou_pairs(labelled, found, "pred", "truth")
    return found, pairs, lambda: regions.greedy_match(pairs, threshold)


@query("region_iou_pairs", "mask", DEFECT + region_ctes("dm") + PAIRS + "select image_id, class_id, p, t, round(iou,6) iou from pr")
def region_iou_pairs(spark, sf_dir):
    return matched(spark, sf_dir, 0.5)[1].select("image_id", "class_id", "p", "t", r6("iou", "iou"))


OBJECTS = """, cnt as (select image_id, class_id, count(*) filter (layer='pred') np, count(*) filter (layer='truth') nt from obj group by all),
 hit as (select image_id, class_id, count(*) tp, avg(iou) mi from mt group by all),
 f as (select c.*, coalesce(tp,0) tp, coalesce(mi,0) mi from cnt c left join hit using (image_id, class_id)),
 m as (select *, case when np>0 then tp/np::double else 0 end pc, case when nt>0 then tp/nt::double else 0 end rc from f)
select image_id, class_id, tp::bigint tp, (np-tp)::bigint fp, (nt-tp)::bigint fn, np::bigint detected_objects, nt::bigint ground_truth_objects,
 round(pc,6) "precision", round(rc,6) recall, round(case when pc+rc>0 then 2*pc*rc/(pc+rc) else 0 end,6) f1, round(mi,6) avg_matched_iou from m"""


@query("object_metrics", "mask", DEFECT + region_ctes("dm") + PAIRS + ", mt as (select * from pr where iou>=0.5e0)" + OBJECTS)
def object_metrics(spark, sf_dir):
    found, _, match = matched(spark, sf_dir, 0.5)
    return shown(regions.object_metrics(found, match(), "pred", "truth"))


def shown(out):
    return out.select(
        "image_id", "class_id", "tp", "fp", "fn", "detected_objects", "ground_truth_objects",
        *[r6(c, c) for c in ("precision", "recall", "f1", "avg_matched_iou")],
    )


@query("greedy_match_low_threshold", "mask", DEFECT + region_ctes("dm") + PAIRS + """, c as (select *, row_number() over (partition by image_id, class_id order by iou desc, p, t) k from pr where iou>=0.05e0),
 fold as (select image_id, class_id, 0::bigint k, []::bigint[] ps, []::bigint[] ts from (select distinct image_id, class_id from c)
  union all select f.image_id, f.class_id, c.k, case when list_contains(ps,c.p) or list_contains(ts,c.t) then ps else list_append(ps,c.p) end,
   case when list_contains(ps,c.p) or list_contains(ts,c.t) then ts else list_append(ts,c.t) end from fold f join c on c.image_id=f.image_id and c.class_id=f.class_id and c.k=f.k+1),
 fin as (select image_id, class_id, unnest(ps) p, unnest(ts) t from fold qualify k=max(k) over (partition by image_id, class_id))
select fin.image_id, fin.class_id, fin.p, fin.t, round(c.iou,6) iou from fin join c using (image_id, class_id, p, t)""")
def greedy_match_low_threshold(spark, sf_dir):
    return matched(spark, sf_dir, 0.05)[2]().select("image_id", "class_id", "p", "t", r6("iou", "iou"))


BRIGHT = """, mx as (select image_id, max(value) m from gray group by 1), dm as (select g.image_id, 'g' as layer, 1 c, y, x from gray g join mx using (image_id) where value>greatest(m*0.7e0,128.0e0))"""


def bright_runs(spark, sf_dir, level):
    lit = level.where("bright").select("image_id", F.lit("g").alias("layer"), "y", "x", F.lit(1).alias("value"))
    return regions.connected_regions(raster.pixels_to_runs(lit), 4, 0, 4)


def photo_frames(spark, sf_dir):
    p = gray(spark, sf_dir).select("image_id").distinct()
    return p.select("image_id", F.lit(8).cast("bigint").alias("frame_w"), F.lit(8).cast("bigint").alias("frame_h"))


@query("bright_region_box", "gray", BRIGHT + region_ctes("dm") + """, top as (select * from reg qualify row_number() over (partition by image_id order by area desc, region)=1)
select image_id, greatest(0,min_x-1)::bigint x, greatest(0,min_y-1)::bigint y, least(8-greatest(0,min_x-1), max_x-min_x+3)::bigint w, least(8-greatest(0,min_y-1), max_y-min_y+3)::bigint h
 from top where area>=64*0.05e0""")
def bright_region_box(spark, sf_dir):
    p = gray(spark, sf_dir)
    top = p.groupBy("image_id").agg(regions.bright_threshold(F.max("value")).alias("t"))
    level = p.join(top, "image_id").withColumn("bright", C("value") > C("t"))
    return regions.bright_region_box(bright_runs(spark, sf_dir, level), photo_frames(spark, sf_dir), 0.05, 1)


@query("device_box", "gray", """, d as (select image_id, y, x, value from gray), hh as (select image_id, value, sum(count(*)) over (partition by image_id order by value) c from d group by image_id, value),
 ov as (select i.image_id, (select min(value) from hh where hh.image_id=i.image_id and c/64.0e0>0.62e0) o from (select distinct image_id from gray) i),
 th as (select image_id, case when o>64 then 64 when o=0 then null when o-1>40 then greatest(40,o-5) else o-1 end t from ov),
 dm as (select d.image_id, 'g' as layer, 1 c, y, x from d join th using (image_id) where value>t)""" + region_ctes("dm") + """, top as (select * from reg qualify row_number() over (partition by image_id order by area desc, region)=1)
select image_id, coalesce(trunc(min_x/0.04e0)::bigint, 24) x, coalesce(trunc(min_y/0.04e0)::bigint,30) y, coalesce(trunc((max_x-min_x+1)/0.04e0)::bigint,176-24) w, coalesce(trunc((max_y-min_y+1)/0.04e0)::bigint,170-30) h
 from (select distinct image_id from gray) i left join top using (image_id)""")
def device_box(spark, sf_dir):
    p = gray(spark, sf_dir)
    level = p.join(g.area_threshold(g.histogram(p)), "image_id").withColumn("bright", C("value") > C("threshold"))
    images = photo_frames(spark, sf_dir).select("image_id", (C("frame_w") * 25).alias("frame_w"), (C("frame_h") * 25).alias("frame_h"))
    return regions.device_box(bright_runs(spark, sf_dir, level), images, 0.04)


for _name in list(SQL):
    SQL[_name] = recursive(SQL[_name])
