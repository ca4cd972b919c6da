"""Registered queries: boxes, patches, screen candidates, polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan import schema
from panescan.checks.derived import boxes, frames, r6, table
from panescan.checks.registry import registry
from panescan.operators import geometry as geo
from panescan.operators import patches

QUERIES, SQL, query = registry()
C = F.col


def columns(*names):
    return [F.col(n) for n in names]


@query("margin_box", "frames", """select image_id, trunc(w*0.12e0)::bigint x, trunc(h*0.15e0)::bigint y,
 trunc(w*(1.0e0-0.12e0))::bigint - trunc(w*0.12e0)::bigint w, trunc(h*(1.0e0-0.15e0))::bigint-trunc(h*0.15e0)::bigint h from frames""")
def margin_box(spark, sf_dir):
    return frames(spark, sf_dir).select("image_id", geo.margin_box(C("w"), C("h")).alias("b")).select("image_id", "b.*")


@query("clip_box", "boxes", """, c as (select *, greatest(0,least(x-100,2000)) cx, greatest(0,least(y-100,3000)) cy from boxes)
select ann_id, cx::bigint x, cy::bigint y, least(w,2000-cx)::bigint w, least(h,3000-cy)::bigint h from c""")
def clip_box(spark, sf_dir):
    b = geo.clip_box(C("x") - 100, C("y") - 100, C("w"), C("h"), F.lit(2000).cast("bigint"), F.lit(3000).cast("bigint"))
    return boxes(spark, sf_dir).select("ann_id", b.alias("b")).select("ann_id", "b.*")


@query("rescale_box", "boxes", "select ann_id, trunc(x/0.04e0)::bigint x, trunc(y/0.04e0)::bigint y, trunc(w/0.04e0)::bigint w, trunc(h/0.04e0)::bigint h from boxes")
def rescale_box(spark, sf_dir):
    return boxes(spark, sf_dir).select("ann_id", geo.rescale_box(*columns("x", "y", "w", "h"), 0.04).alias("b")).select("ann_id", "b.*")


@query("screen_share", "frames", "select image_id, round(w*h/((w+2*x+100)*(h+2*y+300))::double*100,6) share from frames")
def screen_share(spark, sf_dir):
    share = geo.screen_share(C("w"), C("h"), C("w") + 2 * C("x") + 100, C("h") + 2 * C("y") + 300)
    return frames(spark, sf_dir).select("image_id", r6(share, "share"))


@query("turned_size", "boxes", """, a as (select ann_id, w, h, (x%361)::double an, 0.9e0+(y%26)*0.01e0 sc from boxes),
 s as (select ann_id, trunc(w*sc)::bigint sw, trunc(h*sc)::bigint sh, cos(radians(an)) c, sin(radians(an)) s from a)
select ann_id, sw, sh, ceil(round(greatest(0.0e0,sw*c,sw*c+sh*s,sh*s)-least(0.0e0,sw*c,sw*c+sh*s,sh*s),6))::bigint tw,
 ceil(round(greatest(0.0e0,-(sw*s),sh*c-sw*s,sh*c)-least(0.0e0,-(sw*s),sh*c-sw*s,sh*c),6))::bigint th from s""")
def turned_size(spark, sf_dir):
    size = geo.turned_size(C("w"), C("h"), (C("x") % 361).cast("double"), 0.9 + (C("y") % 26) * 0.01)
    return boxes(spark, sf_dir).select("ann_id", size.alias("s")).select("ann_id", "s.*")


GRID = """, g as (select image_id, x fx, y fy, w fw, h fh, ceil(w/409.0e0)::bigint nc, ceil(h/409.0e0)::bigint nr from frames),
 grid as (select image_id, r.r*nc+c.c patch_id, fx+c.c*409 x0, fy+r.r*409 y0, least(fx+c.c*409+512,fx+fw) x1, least(fy+r.r*409+512,fy+fh) y1
   from g, range(20) r(r), range(20) c(c) where r.r<nr and c.c<nc) """


@query("patch_grid", "frames", GRID + "select image_id, patch_id, x0, y0, x1, y1 from grid")
def patch_grid(spark, sf_dir):
    return patches.patch_grid(frames(spark, sf_dir), 512, 0.2)


CLIP = GRID + """, cl as (select g.image_id, g.patch_id, b.ann_id, b.category_id, greatest(b.x,x0)-x0 bx, greatest(b.y,y0)-y0 as "by",
  least(b.x+b.w,x1)-greatest(b.x,x0) bw, least(b.y+b.h,y1)-greatest(b.y,y0) bh from grid g join boxes b on b.image_id=g.image_id
  and b.x<x1 and b.x+b.w>x0 and b.y<y1 and b.y+b.h>y0) """


@query("boxes_to_patches", "boxes frames", CLIP + """select *, bw*bh area from cl""")
def boxes_to_patches(spark, sf_dir):
    return patches.boxes_to_patches(boxes(spark, sf_dir), frames(spark, sf_dir), 512, 0.2)


@query("boxes_to_patches_with_empty", "boxes frames", CLIP + """select g.image_id, g.patch_id, ann_id, category_id, bx, "by", bw, bh, bw*bh area
 from grid g left join cl using (image_id, patch_id)""")
def boxes_to_patches_with_empty(spark, sf_dir):
    return patches.boxes_to_patches(boxes(spark, sf_dir), frames(spark, sf_dir), 512, 0.2, keep_empty=True)


def box_polygons(spark, sf_dir):
    """Each box as a rectangle polygon whose outline pixels are its border pixels."""
    p = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    x0, y0, x1, y1 = C("x"), C("y"), C("x") + C("w") - 1, C("y") + C("h") - 1
    return boxes(spark, sf_dir).select("image_id", "ann_id", F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)).alias("points"))


@query("clipped_polygon_area", "boxes frames", CLIP + "select image_id, patch_id, ann_id, (bw*bh)::bigint area from cl")
def clipped_polygon_area(spark, sf_dir):
    return patches.clipped_area(box_polygons(spark, sf_dir), frames(spark, sf_dir), 512, 0.2)


@query("polygon_fill", "boxes", """select image_id, ann_id, h::bigint n_rows, (w*h)::bigint pixels, (w*(h*y+h*(h-1)//2))::bigint y_moment,
 (h*(2*x+w-1))::bigint x_ends from boxes""")
def polygon_fill(spark, sf_dir):
    runs = geo.polygon_to_runs(box_polygons(spark, sf_dir), ["image_id", "ann_id"])
    size = (C("x1") - C("x0") + 1).cast("bigint")
    return runs.groupBy("image_id", "ann_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("pixels"), F.sum(size * C("y")).alias("y_moment"),
        F.sum((C("x0") + C("x1")).cast("bigint")).alias("x_ends"),
    )


@query("polygon_bounds", "boxes", "select ann_id, x::int min_x, y::int min_y, (x+w-1)::int max_x, (y+h-1)::int max_y from boxes")
def polygon_bounds(spark, sf_dir):
    return box_polygons(spark, sf_dir).select("ann_id", geo.bounds(C("points")).alias("b")).select("ann_id", "b.*")


def candidates(spark, sf_dir):
    """Screen candidates per image: each box grown to photo size, in a 3000x4000 frame."""
    return boxes(spark, sf_dir).select(
        "image_id", C("ann_id").alias("cand_id"), "x", "y", (C("w") * 60).alias("w"), (C("h") * 60).alias("h"),
        (C("w") * C("h") * (1500 + C("x") % 2100)).alias("area"),
        F.lit(3000).cast("bigint").alias("frame_w"), F.lit(4000).cast("bigint").alias("frame_h"),
    )


CANDS = """, cand as (select image_id, ann_id cand_id, x, y, w*60 w, h*60 h, w*h*(1500+x%2100) area, 3000 frame_w, 4000 frame_h from boxes)"""
SCORE = {
    "centred": """case when area>=12000000*0.1e0 then least(1.0e0, area/(12000000*0.5e0))*0.5e0 +
  (case when w::double/h>=0.4e0 and w::double/h<=0.8e0 then 1.0e0 else greatest(0.0e0,1.0e0-abs(w::double/h-0.6e0)) end)*0.3e0 +
  (1.0e0 - sqrt(pow(x+w//2-1500,2)+pow(y+h//2-2000,2))/sqrt(pow(1500,2)+pow(2000,2)))*0.2e0 end""",
    "edges": """case when area>=12000000*0.1e0 then least(1.0e0, area/(12000000*0.4e0))*(case when w::double/h>=0.4e0 and w::double/h<=0.8e0 then 1.0e0 else 0.5e0 end) end""",
    "rectangle": """case when area>12000000*0.15e0 and w::double/h>0.3e0 and w::double/h<0.9e0 and area/(w*h)::double>0.6e0 then area::double end""",
}


def score_query(rule):
    @query(f"screen_score_{rule}", "boxes", CANDS + f""", s as (select *, {SCORE[rule]} score from cand)
 select image_id, cand_id, round(score,9) score from s where score is not null""")
    def scored(spark, sf_dir):
        return geo.score_boundary(candidates(spark, sf_dir), rule).where("score is not null").select("image_id", "cand_id", F.round("score", 9).alias("score"))

    @query(f"screen_best_{rule}", "boxes", CANDS + f""", s as (select *, {SCORE[rule]} score from cand)
 select image_id, cand_id, x, y, w, h, round(score,6) score from s where score is not null
 qualify row_number() over (partition by image_id order by score desc, cand_id)=1""")
    def best(spark, sf_dir):
        out = geo.best_candidate(geo.score_boundary(candidates(spark, sf_dir), rule))
        return out.withColumn("score", F.round("score", 6))


for _rule in SCORE:
    score_query(_rule)

VALID = """(x>=0 and y>=0 and x+w<=frame_w and y+h<=frame_h and w>=frame_w*0.3e0 and h>=frame_h*0.3e0 and w<=frame_w*0.95e0
 and h<=frame_h*0.95e0 and w::double/h between 0.2e0 and 1.5e0)"""


@query("valid_boundary", "boxes", CANDS + f" select cand_id, {VALID} valid from cand")
def valid_boundary(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "cand_id", geo.valid_boundary(*columns("x", "y", "w", "h", "frame_w", "frame_h")).alias("valid")
    )


@query("first_valid_boundary", "boxes frames", CANDS + f""", im as (select image_id, w+2*x frame_w, h+2*y frame_h from frames),
 v as (select c.image_id, c.x, c.y, c.w, c.h, c.cand_id%4 prio from cand c join im i using (image_id) where {VALID.replace('frame_w', 'i.frame_w').replace('frame_h', 'i.frame_h').replace('x', 'c.x').replace('y>', 'c.y>').replace('y+', 'c.y+')}
   qualify row_number() over (partition by c.image_id order by prio, c.x, c.y, c.w, c.h)=1)
select im.image_id, coalesce(x,trunc(frame_w*0.12e0)::bigint) x, coalesce(y,trunc(frame_h*0.15e0)::bigint) y,
 coalesce(w,trunc(frame_w*0.88e0)::bigint-trunc(frame_w*0.12e0)::bigint) w, coalesce(h,trunc(frame_h*0.85e0)::bigint-trunc(frame_h*0.15e0)::bigint) h, prio
 from im left join v using (image_id)""")
def first_valid_boundary(spark, sf_dir):
    images = frames(spark, sf_dir).select("image_id", (C("w") + 2 * C("x")).alias("frame_w"), (C("h") + 2 * C("y")).alias("frame_h"))
    cands = candidates(spark, sf_dir).select("image_id", (C("cand_id") % 4).alias("prio"), "x", "y", "w", "h")
    return geo.first_valid(images, cands)


@query("crack_crops", "boxes", """, d as (select ann_id, x+trunc(w*0.025e0)::bigint rx, trunc(w*0.95e0)::bigint rw, y+trunc(h*0.01e0)::bigint ry, trunc(h*0.98e0)::bigint rh
  from (select ann_id, x, y, w*20 w, h*30 h from boxes))
select ann_id, 'top' part, rx, ry, rw, rw rh from d union all
select ann_id, 'mid', rx, trunc(ry+rh/2.0e0-rw/2.0e0)::bigint, rw, trunc(ry+rh/2.0e0+rw/2.0e0)::bigint-trunc(ry+rh/2.0e0-rw/2.0e0)::bigint from d union all
select ann_id, 'bot', rx, ry+rh-rw, rw, rw from d""")
def crack_crops(spark, sf_dir):
    return boxes(spark, sf_dir).select("ann_id", F.inline(geo.crack_crops(C("x"), C("y"), C("w") * 20, C("h") * 30)))


@query("power_on_strips", "boxes", """, d as (select ann_id, x, y, w*20 w, h*30 h from boxes),
 s as (select *, y+trunc(h*0.01e0)::bigint ry, trunc(h*0.052e0)::bigint rh from d)
select ann_id, 'left_out' part, 0::bigint rx, ry, x rw, rh from s union all select ann_id, 'left_in', x+trunc(w*0.14e0)::bigint, ry, trunc(w*0.12e0)::bigint, rh from s
 union all select ann_id, 'right_out', x+w, ry, 5000-(x+w), rh from s union all select ann_id, 'right_in', x+trunc(w*0.74e0)::bigint, ry, trunc(w*0.12e0)::bigint, rh from s""")
def power_on_strips(spark, sf_dir):
    strips = geo.power_on_strips(C("x"), C("y"), C("w") * 20, C("h") * 30, F.lit(5000).cast("bigint"))
    return boxes(spark, sf_dir).select("ann_id", F.inline(strips))


U = "('0x'||substr(md5('11-{k}-'||image_id||'-'||i),1,8))::bigint/4294967296.0e0"


@query("random_crops", "frames", f"""select image_id, i::int i, x + floor({U.format(k='x')}*(w//4+1))::bigint x0, y + floor({U.format(k='y')}*(h//4+1))::bigint y0,
 trunc(w*0.75e0)::bigint size from frames, range(5) r(i)""")
def random_crops(spark, sf_dir):
    from panescan.plans.placement import random_crops as crops

    return crops(frames(spark, sf_dir), 5, 0.75, 11).select("image_id", "i", "x0", "y0", "size")


NAMES = "['background','condensation','dirt','scratch']"
CATS = f""", a as (select image_id, category_id, (w%5)::int k, category_id cid, case (w%5)::int when 0 then null when 1 then 'unknown' when 2 then 'stain' else {NAMES}[category_id+1] end cname from boxes)"""


def annotations(spark, sf_dir):
    k = C("w") % 5
    name = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "unknown").when(k == 2, "stain").otherwise(schema.class_name_of(C("category_id")))
    return boxes(spark, sf_dir).select("image_id", "category_id", name.alias("category_name"))


@query("category_stats", "boxes", CATS + f""", m as (select image_id, case when cname is null or cname='unknown' then {NAMES}[cid+1] else cname end nm from a),
 c as (select image_id, case when nm in ('condensation','dirt','scratch') then nm else 'unknown' end category from m)
select i.image_id, k.category, count(c.category)::bigint n from (select distinct image_id from boxes) i cross join (values ('condensation'),('dirt'),('scratch'),('unknown')) k(category)
 left join c on c.image_id=i.image_id and c.category=k.category group by all""")
def category_stats(spark, sf_dir):
    from panescan.operators.summary import category_stats as stats

    return stats(annotations(spark, sf_dir), "name_then_id")


@query("category_stats_of_all_images", "boxes", CATS + f""", m as (select image_id, case when cname is null or cname='unknown' then {NAMES}[cid+1] else cname end nm from a),
 c as (select image_id, case when nm in ('condensation','dirt','scratch') then nm else 'unknown' end category from m)
select i.image_id, k.category, count(c.category)::bigint n from (select vec_id::bigint image_id from embeddings) i cross join (values ('condensation'),('dirt'),('scratch'),('unknown')) k(category)
 left join c on c.image_id=i.image_id and c.category=k.category group by all""")
def category_stats_of_all_images(spark, sf_dir):
    """Most of the listed images have no annotation."""
    from panescan.operators.summary import category_stats as stats

    listed = table(spark, sf_dir, "embeddings").select(C("vec_id").cast("bigint").alias("image_id"))
    return stats(annotations(spark, sf_dir), "name_then_id", listed)


@query("category_stats_name_or_id", "boxes", CATS + f""", c as (select image_id, case when cname='condensation' or cid=1 then 'condensation' when cname='dirt' or cid=2 then 'dirt'
  when cname='scratch' or cid=3 then 'scratch' else 'unknown' end category from a)
select i.image_id, k.category, count(c.category)::bigint n from (select distinct image_id from boxes) i cross join (values ('condensation'),('dirt'),('scratch'),('unknown')) k(category)
 left join c on c.image_id=i.image_id and c.category=k.category group by all""")
def category_stats_name_or_id(spark, sf_dir):
    from panescan.operators.summary import category_stats as stats

    return stats(annotations(spark, sf_dir), "name_or_id")


@query("success_rates", "boxes", CATS + """, c as (select image_id, category_id, count(*) contours, count(*) filter (k>0) placed, sum(k) attempted from a where category_id>0 group by all)
select image_id, category_id, attempted::bigint attempted, placed::bigint placed, contours::bigint contours,
  round(case when attempted>0 then contours/attempted::double*100 else 0 end,2) success_rate_percent from c""")
def success_rates(spark, sf_dir):
    from panescan.operators.summary import success_rates as rates

    counted = boxes(spark, sf_dir).where("category_id > 0").groupBy("image_id", "category_id").agg(
        F.sum(C("w") % 5).alias("attempted"), F.sum((C("w") % 5 > 0).cast("bigint")).alias("placed"), F.count(F.lit(1)).alias("contours")
    )
    key = ["image_id", "category_id"]
    return rates(counted.select(*key, "attempted"), counted.select(*key, "placed"), counted.select(*key, "contours"), key)


@query("labels_lookup", "boxes", f"""select ann_id, category_id::int class_id, {NAMES}[category_id+1] class_name, [0.01e0,0.3e0,0.3e0,0.3e0][category_id+1] weight,
  w%9>=4 unknown_id from boxes""")
def labels_lookup(spark, sf_dir):
    from panescan.operators.summary import with_labels

    ids = boxes(spark, sf_dir).select("ann_id", C("category_id").cast("int").alias("class_id"), (C("w") % 9).cast("int").alias("other"))
    known = with_labels(ids)
    flagged = with_labels(ids.select("ann_id", C("other").alias("class_id"))).select("ann_id", C("class_name").isNull().alias("unknown_id"))
    return known.join(flagged, "ann_id").select("ann_id", "class_id", "class_name", "weight", "unknown_id")
