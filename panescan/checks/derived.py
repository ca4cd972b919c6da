"""Inspection tables derived from the general test tables, in Spark and in DuckDB SQL.

Every recipe is a pure function of a stored table, so its size follows that table.
The SQL side is a chain of CTEs; ``with_sql("mask", ...)`` prefixes the ones asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panescan.functions import scores
from panescan.operators import raster
from panescan.session import spread

MASK_H, MASK_W = 40, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark, sf_dir) -> DataFrame:
    """8x8 grey image per embedding: levels are min-max scaled elements."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    lo, hi = F.array_min("e"), F.array_max("e")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("image_id"), "embedding")
    return (
        spread(rows, "image_id", 256)
        .select("image_id", e.alias("e"))
        .select("image_id", F.posexplode("e").alias("pos", "v"), lo.alias("lo"), hi.alias("hi"))
        .select(
            "image_id",
            F.floor(F.col("pos") / 8).cast("int").alias("y"),
            (F.col("pos") % 8).cast("int").alias("x"),
            F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int").alias("value"),
        )
    )


GRAY = """gray_e as (select vec_id::bigint image_id, generate_subscripts(embedding,1)-1 pos, unnest(embedding)::double v from embeddings),
gray_m as (select image_id, min(v) lo, max(v) hi from gray_e group by image_id),
gray as (select e.image_id, (pos//8)::int y, (pos%8)::int x, floor((v-lo)/(hi-lo)*255)::int as value
         from gray_e e join gray_m m using (image_id))"""


def class_runs(spark, sf_dir) -> DataFrame:
    """Predicted and true 40x50 class mask per supplier, as runs that include background."""
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", "image_id", "layer", "by", "bx")), 1, 6), 16, 10).cast("int") % 9
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("image_id"))
    blocks = (
        spread(ids, "image_id", 1040)
        .select("image_id", F.explode(F.array(F.lit("pred"), F.lit("truth"))).alias("layer"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(MASK_H // 5 - 1))).alias("by"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit((MASK_W - 1) // 4))).alias("bx"))
        .select("image_id", "layer", "by", "bx", pick.alias("k"))
    )
    pieces = blocks.select(
        "image_id",
        "layer",
        F.when(F.col("k") < 4, F.col("k")).otherwise(0).cast("int").alias("class_id"),
        F.explode(F.sequence(F.col("by") * 5, F.col("by") * 5 + 4)).alias("y"),
        (F.col("bx") * 4).alias("x0"),
        F.least(F.col("bx") * 4 + 3, F.lit(MASK_W - 1)).alias("x1"),
    )
    return raster.coalesce_runs(pieces)


MASK = """mask_k as (select s_suppkey::bigint image_id, layer, y::int y, x::int x,
  (('0x'||substr(md5(s_suppkey||'-'||layer||'-'||(y//5)||'-'||(x//4)),1,6))::bigint % 9)::int k
  from supplier, (values ('pred'),('truth')) l(layer), range(40) a(y), range(50) b(x)),
mask as (select image_id, layer, y, x, case when k<4 then k else 0 end as value from mask_k)"""


def boxes(spark, sf_dir) -> DataFrame:
    """Annotation boxes from order lines; all 50 images are hot keys."""
    i = lambda c: F.col(c).cast("bigint")
    dup = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return (
        spread(lines, ["l_orderkey", "l_linenumber"], 2)
        .withColumn("rn", F.row_number().over(dup))
        .select(
            (i("l_orderkey") % 50).alias("image_id"),
            ((i("l_orderkey") * 8 + i("l_linenumber")) * 16 + F.col("rn") - 1).alias("ann_id"),
            (i("l_linenumber") % 4).alias("category_id"),
            (i("l_partkey") % 3000).alias("x"),
            (i("l_suppkey") * 37 % 4000).alias("y"),
            i("l_quantity").alias("w"),
            (1 + i("l_partkey") % 60).alias("h"),
        )
    )


BOXES = """boxes as (select l_orderkey::bigint%50 image_id,
  (l_orderkey::bigint*8+l_linenumber)*16 + row_number() over (partition by l_orderkey,l_linenumber
     order by l_partkey,l_suppkey,l_quantity,l_extendedprice) - 1 as ann_id,
  l_linenumber::bigint%4 category_id, l_partkey::bigint%3000 x, l_suppkey::bigint*37%4000 y,
  l_quantity::bigint w, 1+l_partkey::bigint%60 h from lineitem)"""


def frames(spark, sf_dir) -> DataFrame:
    """One screen frame per part."""
    p = F.col("p_size").cast("bigint")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("image_id"),
        p.alias("x"),
        (2 * p).alias("y"),
        (1000 + p * 10).alias("w"),
        (2000 + p * 20).alias("h"),
    )
    return spread(rows, "image_id", 64)


FRAMES = """frames as (select p_partkey::bigint image_id, p_size::bigint x, 2*p_size::bigint y,
  1000+p_size::bigint*10 w, 2000+p_size::bigint*20 h from part)"""


def logits(spark, sf_dir) -> DataFrame:
    """Sixteen 4-class logit pixels per embedding, laid out as overlapping 4x4 patches."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 16").alias("image_id"), F.col("vec_id").cast("bigint").alias("v"), F.col("label").cast("int").alias("label"), "embedding"
    )
    return (
        spread(rows, "image_id", 64)
        .select("v", "label", e.alias("e"))
        .select("v", "label", "e", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
        .select(
            F.expr("v div 16").alias("image_id"),
            (F.col("v") % 16).cast("int").alias("patch_id"),
            (F.expr("(v % 16) div 4") * 3 + F.expr("k div 4")).cast("int").alias("y"),
            (F.col("v") % 4 * 3 + F.col("k") % 4).cast("int").alias("x"),
            F.slice("e", F.col("k") * 4 + 1, 4).alias("logits"),
            (F.col("label") % 4).alias("truth"),
        )
    )


def score_pixels(spark, sf_dir) -> DataFrame:
    return logits(spark, sf_dir).withColumn("probs", scores.softmax(F.col("logits"))).drop("logits")


SCORES = """logit_e as (select vec_id::bigint v, label::int label, k::int k,
    embedding[4*k+1]::double l0, embedding[4*k+2]::double l1, embedding[4*k+3]::double l2, embedding[4*k+4]::double l3
  from embeddings, range(16) r(k)),
logit_x as (select *, exp(l0-greatest(l0,l1,l2,l3)) e0, exp(l1-greatest(l0,l1,l2,l3)) e1,
  exp(l2-greatest(l0,l1,l2,l3)) e2, exp(l3-greatest(l0,l1,l2,l3)) e3 from logit_e),
score as (select v//16 image_id, (v%16)::int patch_id, ((v%16)//4*3+k//4)::int y, (v%4*3+k%4)::int x,
  e0/(e0+e1+e2+e3) p0, e1/(e0+e1+e2+e3) p1, e2/(e0+e1+e2+e3) p2, e3/(e0+e1+e2+e3) p3, (label%4)::int truth from logit_x),
scorec as (select *, case when p0>=p1 and p0>=p2 and p0>=p3 then 0 when p1>=p2 and p1>=p3 then 1
  when p2>=p3 then 2 else 3 end as cls from score)"""


def history(spark, sf_dir) -> DataFrame:
    """Training history: a run per user, an epoch per event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("run_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("epoch"),
        F.col("event_type").alias("split"),
        F.col("value").cast("double").alias("value"),
    )


HISTORY = """history as (select user_id::bigint run_id, row_number() over (partition by user_id order by ts,event_id)-1 epoch,
  event_type split, value::double as value from events)"""


def paths(spark, sf_dir) -> DataFrame:
    """Patch folders and page addresses as file paths."""
    d = table(spark, sf_dir, "documents")
    n = F.col("n_chars").cast("bigint")
    patch = F.concat(
        "source", F.lit("/"), "lang", F.lit("/patch_"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"),
        F.lit("_x"), (n % 7 * 1792).cast("string"), F.lit("_y"), (n % 5 * 1792).cast("string"),
    )
    return d.select(patch.alias("path")).unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


PATHS = """paths as (select source||'/'||lang||'/patch_'||lpad((doc_id%1000)::varchar,3,'0')||'_x'||(n_chars%7*1792)||'_y'||(n_chars%5*1792) as path
  from documents union all select url from pages)"""


def photo_paths(spark, sf_dir) -> DataFrame:
    """Photo paths <category>/<device>/<a>_<b>_<surface>_<n>.bmp out of orders."""
    k = F.col("o_orderkey").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.concat(
            F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("/dev"), F.col("o_custkey").cast("string"), F.lit("/a_"),
            k.cast("string"), F.when(k % 3 == 0, "_0_0_").when(k % 3 == 1, "_3_1_").otherwise("_9_9_"), (k % 10).cast("string"), F.lit(".bmp"),
        ).alias("path")
    )


PHOTOS = """photos as (select lower(substr(o_orderpriority,3,20))||'/dev'||o_custkey||'/a_'||o_orderkey||
  (case o_orderkey%3 when 0 then '_0_0_' when 1 then '_3_1_' else '_9_9_' end)||(o_orderkey%10)||'.bmp' as path from orders)"""


def files(spark, sf_dir) -> DataFrame:
    """Sample folders: one mask file each, image and label file mostly present."""
    names = F.array(*[F.lit(n) for n in MASK_NAMES])
    d = F.col("doc_id")
    listed = F.array_compact(
        F.array(
            F.element_at(names, (F.col("n_chars") % 4 + 1).cast("int")),
            F.when(d % 3 != 0, F.lit("synthetic_dirty_patch.png")),
            F.when(d % 5 != 0, F.lit("labels_patch.json")),
            F.when(d % 7 == 0, F.element_at(names, ((F.col("n_chars") + 1) % 4 + 1).cast("int"))),
        )
    )
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("dir"), F.explode(listed).alias("name"))


# --- fixed values: mask file names -------------------------------------------------------
MASK_NAMES = [
    "segmentation_mask_patch_multiclass.png",
    "segmentation_mask_multiclass.png",
    "segmentation_mask_patch.png",
    "segmentation_mask_combined.png",
]
_NAMES_SQL = "[" + ",".join(f"'{n}'" for n in MASK_NAMES) + "]"
FILES = f"""files as (select dir, name from (select doc_id::varchar dir, unnest([
    {_NAMES_SQL}[(n_chars%4+1)::int], case when doc_id%3<>0 then 'synthetic_dirty_patch.png' end,
    case when doc_id%5<>0 then 'labels_patch.json' end,
    case when doc_id%7=0 then {_NAMES_SQL}[((n_chars+1)%4+1)::int] end]) as name from documents) where name is not null)"""

CTES = {
    "gray": GRAY, "mask": MASK, "boxes": BOXES, "frames": FRAMES, "score": SCORES,
    "history": HISTORY, "paths": PATHS, "photos": PHOTOS, "files": FILES,
}


def with_sql(names: str, body: str) -> str:
    """Prefix a query (which may open with its own ``ctes; select``) with derived tables."""
    return "with " + ",\n".join(CTES[n] for n in names.split()) + "\n" + body


def r6(column, name: str):
    """Round to six places at the query edge, so both engines print the same digits."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6).alias(name)
