"""Registered queries: paths, file catalogs, label files, sampling and placement plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan import schema
from panescan.checks.derived import boxes, files, frames, paths, photo_paths, r6, table
from panescan.checks.registry import registry
from panescan.functions.hashing import uniform
from panescan.operators import summary
from panescan.plans import placement, sampling
from panescan.sources import catalog, labels

QUERIES, SQL, query = registry()
C = F.col

FACTS = """, pf as (select path, split_part(split_part(path,'/',-1),'.',1) stem, split_part(path,'/',-3) category, split_part(path,'/',-2) device_id,
 case when regexp_matches(split_part(path,'/',-1),'^.*_.*_0_0_.*') then 'frontal' when regexp_matches(split_part(path,'/',-1),'^.*_.*_3_1_.*') then 'rear' end surface from photos)"""


@query("path_facts", "photos", FACTS + "select * from pf")
def path_facts(spark, sf_dir):
    return catalog.path_facts(photo_paths(spark, sf_dir))


@query("pick_first_photo", "photos", FACTS + "select category, device_id, surface, min(path) path from pf where surface is not null group by all")
def pick_first_photo(spark, sf_dir):
    return catalog.pick_first(catalog.path_facts(photo_paths(spark, sf_dir)))


@query("missing_surfaces", "photos", FACTS + """select g.category, g.device_id, s.surface from (select distinct category, device_id from pf) g cross join (values ('frontal'),('rear')) s(surface)
 where not exists (select 1 from pf where pf.category=g.category and pf.device_id=g.device_id and pf.surface=s.surface)""")
def missing_surfaces(spark, sf_dir):
    return catalog.missing_groups(catalog.path_facts(photo_paths(spark, sf_dir)))


@query("limit_images", "photos", "select path from photos order by path limit 25")
def limit_images(spark, sf_dir):
    return catalog.limit_images(photo_paths(spark, sf_dir), 25, "path")


@query("patch_catalog", "paths", r"""select path dir, 'synthetic_dirty_patch.png' as name, try_cast(nullif(regexp_extract(path,'/patch_(\d+)_',1),'') as int) patch_num,
 try_cast(nullif(regexp_extract(path,'_x(\d+)_',1),'') as int) x, try_cast(nullif(regexp_extract(path,'_y(\d+)$',1),'') as int) y, split_part(path,'/',-3) source from paths where path like '%/patch\_%' escape '\'""")
def patch_catalog(spark, sf_dir):
    rows = paths(spark, sf_dir).select(C("path").alias("dir"), F.lit("synthetic_dirty_patch.png").alias("name"))
    return catalog.patch_catalog(rows)


def prio_sql(names):
    cases = " ".join(f"when '{n}' then {i}" for i, n in enumerate(names, 1))
    return f"""select dir, arg_min(name,prio) as name, min(prio)::bigint prio from (select *, case name {cases} end prio from files) where prio is not null group by dir"""


for _label, _names in (
    ("dataset_mask", catalog.DATASET_MASKS), ("truth_mask_multiclass", catalog.TRUTH_MASKS_MULTICLASS),
    ("truth_mask_binary", catalog.TRUTH_MASKS_BINARY), ("full_photo_mask", catalog.FULL_PHOTO_MASKS),
):
    query(f"resolve_{_label}", "files", prio_sql(_names))(lambda spark, sf_dir, names=_names: catalog.resolve_by_priority(files(spark, sf_dir), names))


MN = catalog.TRUTH_MASKS_MULTICLASS
VALID = f""", v as (select dir, bool_or(name='synthetic_dirty_patch.png') i, bool_or(name='labels_patch.json') l, bool_or(name='{MN[0]}') m0, bool_or(name='{MN[1]}') m1, bool_or(name='{MN[2]}') m2, bool_or(name='{MN[3]}') m3 from files group by dir),
 w as (select *, concat_ws(',', case when m0 then '{MN[0]}' end, case when m1 then '{MN[1]}' end, case when m2 then '{MN[2]}' end, case when m3 then '{MN[3]}' end) masks from v)"""


def validate_query(name, require):
    ok = "i and l and (m0 or m1)" if require else "i and l and masks<>''"
    multi = "case when not (m0 or m1) then 'a multi-class mask is required and absent' end," if require else ""

    @query(name, "files", VALID + f"""select dir, case when i and l and m0 then 'multiclass' when i and l and m2 then 'binary' else 'unknown' end sample_type, i has_image, l has_labels, masks, {ok} valid,
 concat_ws('; ', case when not i then 'no synthetic_dirty_patch.png: the sample has no picture' end, case when not l then 'no labels_patch.json: the sample has no annotations' end, {multi} case when masks='' then 'the sample has no mask' end) errors from w""")
    def run(spark, sf_dir):
        out = catalog.validate_samples(files(spark, sf_dir), require)
        return out.withColumns({"masks": F.concat_ws(",", "masks"), "errors": F.concat_ws("; ", "errors")})

    return run


validate_query("validate_samples", False)
validate_query("validate_samples_multiclass", True)


@query("full_photo_samples", "files", """, n as (select dir, case when name='synthetic_dirty_patch.png' then 'original_image.png' else name end as name from files),
 f as (select dir, max(case when name='original_image.png' then name end) image_file, """ + "coalesce(" + ",".join(f"max(case when name='{m}' then name end)" for m in catalog.FULL_PHOTO_MASKS) + """) mask_file, max(case when name='labels_patch.json' then name end) labels_file from n group by dir)
select *, case when mask_file is null then null when contains(mask_file,'multiclass') then 'multiclass' else 'binary' end mask_type, image_file is not null and mask_file is not null and labels_file is not null valid from f""")
def full_photo_samples(spark, sf_dir):
    renamed = F.when(C("name") == "synthetic_dirty_patch.png", "original_image.png").otherwise(C("name"))
    return catalog.full_photo_samples(files(spark, sf_dir).withColumn("name", renamed))


@query("resolve_scratch_masks", None, """with im as (select 'd'||doc_id stem, doc_id, n_chars from documents),
 f as (select 'inf/'||stem dir, case n_chars%3 when 0 then stem||'_screen_scratches_mask.png' when 1 then 'dirt_mask.png' else 'scratches_mask.png' end as name from im where doc_id%2=0
  union all select 'inf', stem||'_screen_dirt_mask.png' from im where doc_id%3=0 union all select distinct 'inf', 'screen_scratches_mask.png' from im),
 c as (select stem, d.i*10+k.i prio, case d.i when 0 then 'inf/'||stem else 'inf' end dir, case k.i when 0 then stem||'_screen_dirt_mask.png' when 1 then stem||'_screen_scratches_mask.png' when 2 then 'screen_dirt_mask.png' when 3 then 'screen_scratches_mask.png' when 4 then 'dirt_mask.png' else 'scratches_mask.png' end as name
  from im, range(2) d(i), range(6) k(i))
select stem, arg_min(dir,prio) dir, arg_min(name,prio) as name from c where exists (select 1 from f where f.dir=c.dir and f.name=c.name) group by stem""")
def resolve_scratch_masks(spark, sf_dir):
    im = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), C("doc_id").cast("string")).alias("stem"), "doc_id", "n_chars")
    n = C("n_chars") % 3
    own = im.where("doc_id % 2 = 0").select(
        F.concat(F.lit("inf/"), C("stem")).alias("dir"),
        F.when(n == 0, F.concat("stem", F.lit("_screen_scratches_mask.png"))).when(n == 1, "dirt_mask.png").otherwise("scratches_mask.png").alias("name"),
    )
    main = im.where("doc_id % 3 = 0").select(F.lit("inf").alias("dir"), F.concat("stem", F.lit("_screen_dirt_mask.png")).alias("name"))
    common = im.select(F.lit("inf").alias("dir"), F.lit("screen_scratches_mask.png").alias("name")).distinct()
    return catalog.resolve_scratch_masks(im, own.unionByName(main).unionByName(common), "inf")


@query("copy_manifest", "photos", FACTS + """, pk as (select category, device_id, surface, min(path) path, from pf where surface is not null group by all), st as (select pk.*, split_part(split_part(path,'/',-1),'.',1) stem from pk)
select path src, 'out/'||category||'/'||stem||'/original_image.bmp' dst from st union all select category||'/'||device_id||'/coco.json', 'out/'||category||'/'||stem||'/labels_patch.json' from st""")
def copy_manifest(spark, sf_dir):
    return catalog.copy_manifest(catalog.pick_first(catalog.path_facts(photo_paths(spark, sf_dir))), "out")


# ------------------------------------------------------------------------ label files
def order_lines(spark, sf_dir):
    """Order lines numbered within their order; an order has few lines."""
    return boxes(spark, sf_dir).withColumn("order_id", F.expr("ann_id div 128"))


ANN = """, b as (select *, ann_id//128 order_id from boxes), a as (select *, row_number() over (partition by order_id order by ann_id)-1 ann_no from b)"""


@query("label_file_annotations", "boxes", ANN + """select order_id, ann_no::int ann_no, x::int x, y::int y, w::int w, h::int h, category_id::int category_id, ['background','condensation','dirt','scratch'][category_id+1] category_name, (w*h)::int area from a""")
def label_file_annotations(spark, sf_dir):
    """Boxes written as label documents and parsed back."""
    i = lambda c: C(c).cast("int")
    ann = F.struct(
        F.array(i("x"), i("y"), i("w"), i("h")).alias("bbox"),
        F.array(F.array(i("x"), i("y"), i("x") + i("w"), i("y"))).alias("segmentation"),
        i("category_id").alias("category_id"), schema.class_name_of(C("category_id")).alias("category_name"), (i("w") * i("h")).alias("area"),
    )
    grouped = order_lines(spark, sf_dir).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", ann.alias("ann")))).alias("s"))
    doc = labels.label_document(
        F.transform("s", lambda s: s["ann"]), labels.category_map(), F.array(F.lit(4000), F.lit(3000)), F.array(F.lit(0), F.lit(0), F.lit(3000), F.lit(4000)),
        F.map_from_arrays(F.array(F.lit("all")), F.array(F.size("s"))),
    )
    parsed = grouped.select("order_id", labels.parse_labels(doc).alias("l")).select("order_id", "l.annotations")
    return labels.explode_annotations(parsed, "order_id").drop("segmentation")


COCO = """, c as (select order_id origin, (ann_no*2+3)::bigint image_id, ann_no::int ann_no, 'p'||ann_no||'.bmp' file_name, 3000 width, 4000 height, x::double x, y::double y, w::double w, h::double h from a where order_id%3<>0 and category_id=2)"""


def coco_boxes(spark, sf_dir):
    """A COCO document per order: photo ids have gaps, every third order lacks the category."""
    lines = order_lines(spark, sf_dir)
    grouped = lines.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", "category_id", "x", "y", "w", "h"))).alias("s"))
    numbered = F.transform(
        "s",
        lambda s, i: F.struct(
            F.struct((i * 2 + 3).cast("bigint").alias("id"), F.concat(F.lit("p"), i.cast("string"), F.lit(".bmp")).alias("file_name"), F.lit(3000).alias("width"), F.lit(4000).alias("height")).alias("image"),
            F.struct((i * 2 + 3).cast("bigint").alias("image_id"), s["category_id"].cast("int").alias("category_id"), F.array(*[s[k].cast("double") for k in "xywh"]).alias("bbox")).alias("ann"),
        ),
    )
    known = F.array(F.struct(F.lit(1).alias("id"), F.lit("condensation").alias("name")), F.struct(F.lit(2).alias("id"), F.lit("suction").alias("name")))
    cats = F.when(C("order_id") % 3 == 0, F.slice(known, 1, 1)).otherwise(known)
    doc = F.to_json(F.struct(F.transform("n", lambda q: q["image"]).alias("images"), F.transform("n", lambda q: q["ann"]).alias("annotations"), cats.alias("categories")))
    coco = grouped.select("order_id", numbered.alias("n")).select(C("order_id").alias("origin"), F.from_json(doc, schema.COCO_FILE).alias("c")).select("origin", "c.*")
    return labels.explode_coco(coco, "suction")


@query("explode_coco", "boxes", ANN + COCO + "select * from c")
def explode_coco(spark, sf_dir):
    return coco_boxes(spark, sf_dir)


@query("coco_to_yolo", "boxes", ANN + COCO + """, s as (select origin, image_id, ann_no, round_even(x/25.0e0,0) sx, round_even(y/25.0e0,0) sy, round_even(w/25.0e0,0) sw, round_even(h/25.0e0,0) sh from c)
select origin, image_id, ann_no, 0 cls, round((sx+sw/2.0e0)/120,6) cx, round((sy+sh/2.0e0)/160,6) cy, round(sw/120.0e0,6) nw, round(sh/160.0e0,6) nh from s""")
def coco_to_yolo(spark, sf_dir):
    return labels.coco_to_yolo(coco_boxes(spark, sf_dir)).select("origin", "image_id", "ann_no", "cls", *[r6(c, c) for c in ("cx", "cy", "nw", "nh")])


@query("dataset_manifest", "boxes", ANN + """select order_id image_id, to_json({'dataset_info': {'image_id': order_id, 'n_versions': count(*)::int}, 'processing_parameters': {'patch_size': 1792, 'samples': 150},
 'versions': list({'version': ann_no::int, 'area': w*h} order by ann_no)})::varchar json from a group by order_id""")
def dataset_manifest(spark, sf_dir):
    from pyspark.sql import Window

    lines = order_lines(spark, sf_dir)
    no = (F.row_number().over(Window.partitionBy("order_id").orderBy("ann_id")) - 1).alias("version")
    rows = lines.select(C("order_id").alias("image_id"), no, (C("w") * C("h")).alias("area"))
    return summary.dataset_manifest(rows, {"patch_size": 1792, "samples": 150})


@query("detail_json", "frames", "select image_id, to_json({'image_id': image_id, 'x': x, 'y': y, 'w': w, 'h': h})::varchar json from frames")
def detail_json(spark, sf_dir):
    return summary.detail_json(frames(spark, sf_dir))


# --------------------------------------------------------------- sampling and placement
@query("train_val_split", "photos", """select path, case when row_number() over (order by md5('42-'||path), path) <= ceil(count(*) over ()*0.2e0) then 'val' else 'train' end split from photos""")
def train_val_split(spark, sf_dir):
    return sampling.train_val_split(photo_paths(spark, sf_dir), "path")


@query("hash_split", "photos", """select path, case when ('0x'||substr(md5('42-'||path),1,8))::bigint/4294967296.0e0<0.2e0 then 'val' else 'train' end split from photos""")
def hash_split(spark, sf_dir):
    return sampling.hash_split(photo_paths(spark, sf_dir), "path")


@query("uniform_draws", None, "select l_orderkey::bigint k, l_linenumber::int n, round(('0x'||substr(md5('5-'||l_orderkey||'-'||l_linenumber),1,8))::bigint/4294967296.0e0,9) u from lineitem")
def uniform_draws(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").cast("bigint").alias("k"), C("l_linenumber").cast("int").alias("n"), F.round(uniform(5, C("l_orderkey"), C("l_linenumber")), 9).alias("u")
    )


def H(tag, key):
    return f"('0x'||substr(md5('{tag}-'||{key}),1,8))::bigint/4294967296.0e0"


@query("weighted_draw", "frames", f""", sl as (select image_id, i::int slot from frames, range(4) r(i)),
 sm as (select o_orderkey::bigint sample_id, case when o_orderkey%7<5 then 'dirt' else 'scratch' end category from orders),
 rk as (select *, row_number() over (partition by category order by md5('9-'||sample_id), sample_id::varchar)-1 rank, count(*) over (partition by category) n from sm),
 ct as (select image_id, slot, {H("9-category", "image_id||'-'||slot")} u, {H("9-sample", "image_id||'-'||slot")} v from sl),
 cc as (select *, case when u<0.01e0/0.91e0 then 'background' when u<0.31e0/0.91e0 then 'condensation' when u<0.61e0/0.91e0 then 'dirt' else 'scratch' end category from ct)
select cc.image_id, cc.slot, cc.category, rk.sample_id from cc join rk on rk.category=cc.category and rk.rank=floor(v*rk.n)""")
def weighted_draw(spark, sf_dir):
    slots = frames(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    k = C("o_orderkey").cast("bigint")
    samples = table(spark, sf_dir, "orders").select(k.alias("sample_id"), F.when(k % 7 < 5, "dirt").otherwise("scratch").alias("category"))
    weights = [(n, w) for n, _, w in schema.LABELS]
    return sampling.weighted_draw(slots, samples, weights, 9, ["image_id", "slot"]).select("image_id", "slot", "category", "sample_id")


@query("quota_draw", "frames", """select image_id, category, slot::int slot from frames, (values ('condensation',6),('dirt',6)) q(category,n), range(6) r(slot) where slot<n""")
def quota_draw(spark, sf_dir):
    return sampling.quota_draw(frames(spark, sf_dir).select("image_id"), 20, ["scratch"])


@query("category_quota_per_image", "frames", """select image_id, category, count(*)::bigint slots from frames, (values ('condensation',5),('dirt',5),('scratch',5)) q(category,n), range(5) r(i) group by all""")
def category_quota_per_image(spark, sf_dir):
    return sampling.quota_draw(frames(spark, sf_dir).select("image_id"), 17).groupBy("image_id", "category").agg(F.count(F.lit(1)).alias("slots"))


@query("image_versions", "frames", "select image_id, 'part'||image_id stem, v::int as version, 'part'||image_id||'_v'||lpad(v::varchar,2,'0') variant from frames, range(12) r(v)")
def image_versions(spark, sf_dir):
    rows = frames(spark, sf_dir).select("image_id", F.concat(F.lit("part"), C("image_id").cast("string")).alias("stem"))
    return sampling.versions(rows, 12)


K = "image_id||'-'||slot||'-'||attempt"
PLACE = f""", t as (select image_id, x, y, w, h, 300+image_id%250 sw0, 200+image_id%350 sh0, i::int slot, j::int attempt from frames, range(5) r(i), range(3) q(j)),
 d as (select *, 0.9e0+{H("21-scale", K)}*(1.15e0-0.9e0) sc, 0.0e0+{H("21-angle", K)}*(360.0e0-0.0e0) an from t),
 z as (select *, trunc(sw0*sc)::bigint sw, trunc(sh0*sc)::bigint sh, cos(radians(an)) c, sin(radians(an)) s from d),
 e as (select *, ceil(round(greatest(0.0e0,sw*c,sw*c+sh*s,sh*s)-least(0.0e0,sw*c,sw*c+sh*s,sh*s),6))::bigint tw, ceil(round(greatest(0.0e0,-(sw*s),sh*c-sw*s,sh*c)-least(0.0e0,-(sw*s),sh*c-sw*s,sh*c),6))::bigint th from z),
 p as (select *, x+floor({H("21-x", K)}*(w-tw+1))::bigint x0, y+floor({H("21-y", K)}*(h-th+1))::bigint y0 from e where tw<=w and th<=h),
 cand as (select image_id, slot, attempt, sc, an, x0, y0, x0+tw x1, y0+th y1 from p)"""


def candidates(spark, sf_dir):
    slots = frames(spark, sf_dir).withColumns({"sw": 300 + C("image_id") % 250, "sh": 200 + C("image_id") % 350}).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slot")
    )
    return placement.placement_candidates(slots, 3, 21)


@query("placement_candidates", "frames", PLACE + 'select image_id, slot, attempt, round(sc,6) "scale", round(an,6) angle, x0, y0, x1, y1 from cand')
def placement_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).withColumns({"scale": F.round("scale", 6), "angle": F.round("angle", 6)})


@query("accept_non_overlapping", "frames", PLACE + """, o as (select *, row_number() over (partition by image_id order by slot, attempt) k from cand),
 f as (select image_id, 0::bigint k, []::struct(slot int, attempt int, x0 bigint, y0 bigint, x1 bigint, y1 bigint)[] acc from (select distinct image_id from o) union all
  select f.image_id, o.k, case when len(list_filter(acc, lambda q: q.slot=o.slot or (o.x0<q.x1 and o.x1>q.x0 and o.y0<q.y1 and o.y1>q.y0)))>0 then acc
   else list_append(acc, {'slot': o.slot, 'attempt': o.attempt, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}) end from f join o on o.image_id=f.image_id and o.k=f.k+1),
 l as (select image_id, acc from f qualify row_number() over (partition by image_id order by k desc)=1), u as (select image_id, unnest(acc) q from l)
select image_id, q.slot slot, q.attempt attempt, q.x0 x0, q.y0 y0, q.x1 x1, q.y1 y1 from u""")
def accept_non_overlapping(spark, sf_dir):
    return placement.accept_non_overlapping(candidates(spark, sf_dir))


SQL["accept_non_overlapping"] = SQL["accept_non_overlapping"].replace("with ", "with recursive ", 1)


@query("jitter_polygon", "frames", f""", q as (select image_id, w, h, i::int i, (i//4)::int a, (i%4)/4.0e0 t, ((i//4+1)%4)::int b from frames, range(16) r(i)),
 c as (select *, [0.0e0,1.0e0,1.0e0,0.0e0][a+1]+t*([0.0e0,1.0e0,1.0e0,0.0e0][b+1]-[0.0e0,1.0e0,1.0e0,0.0e0][a+1])+({H("31-x", "image_id||'-'||i")}*2-1)*0.1e0 cx,
  [0.0e0,0.0e0,1.0e0,1.0e0][a+1]+t*([0.0e0,0.0e0,1.0e0,1.0e0][b+1]-[0.0e0,0.0e0,1.0e0,1.0e0][a+1])+({H("31-y", "image_id||'-'||i")}*2-1)*0.1e0 cy from q),
 m as (select *, min(cx) over w lx, max(cx) over w hx, min(cy) over w ly, max(cy) over w hy from c window w as (partition by image_id))
select image_id, i, trunc((cx-lx)/(hx-lx)*w)::int px, trunc((cy-ly)/(hy-ly)*h)::int py from m""")
def jitter_polygon(spark, sf_dir):
    return placement.jitter_polygon(frames(spark, sf_dir), 3, 0.1, 31)
