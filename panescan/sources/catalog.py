"""File catalogs: photo scans, sample folders, priority lists, validation."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panescan import schema
from panescan.functions import paths as p
from panescan.operators.gray import LUMA
from panescan.operators.voting import _batched

# --- fixed values: candidate file names, most wanted first ---------------------------------
DATASET_MASKS = [
    "segmentation_mask_patch_multiclass.png",
    "segmentation_mask_multiclass.png",
    "segmentation_mask_patch.png",
    "segmentation_mask.png",
]
TRUTH_MASKS_MULTICLASS = [
    "segmentation_mask_patch_multiclass.png",
    "segmentation_mask_multiclass.png",
    "segmentation_mask_patch.png",
    "segmentation_mask_combined.png",
]
TRUTH_MASKS_BINARY = [
    "segmentation_mask_patch.png",
    "segmentation_mask_combined.png",
    "segmentation_mask_patch_multiclass.png",
    "segmentation_mask_multiclass.png",
]
FULL_PHOTO_IMAGES = [
    "original_image.bmp",
    "full_phone_image.bmp",
    "synthetic_dirty_patch.bmp",
    "original_image.png",
    "full_phone_image.png",
]
FULL_PHOTO_MASKS = [
    "segmentation_mask_multiclass.png",
    "segmentation_mask_combined.png",
    "segmentation_mask_patch_multiclass.png",
    "segmentation_mask_patch.png",
]
FULL_PHOTO_LABELS = ["labels.json", "labels_patch.json"]
SCRATCH_MASKS = [
    "{stem}_screen_dirt_mask.png",
    "{stem}_screen_scratches_mask.png",
    "screen_dirt_mask.png",
    "screen_scratches_mask.png",
    "dirt_mask.png",
    "scratches_mask.png",
]
SAMPLE_IMAGE, SAMPLE_LABELS = "synthetic_dirty_patch.png", "labels_patch.json"


def scan_images(spark: SparkSession, path: str, suffixes: Sequence[str] = tuple(p.IMAGE_SUFFIXES), max_images: int | None = None, any_case: bool = False, recursive: bool = False) -> DataFrame:
    """Decoded photos, one row each; undecodable files stay as ``status = error`` rows.

    The batch scan wants lower-case suffixes; ``any_case`` is the rule of the generators.
    ``max_images`` takes the first paths of the listing and decodes no other photo; so many
    paths pass through the driver.
    """

    def reader(kind: str):
        found = spark.read.format(kind).option("recursiveFileLookup", recursive)
        return found if any_case else found.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")

    def wanted(origin: str) -> Column:
        return F.lower(F.substring_index(origin, ".", -1)).isin(list(suffixes)) if any_case else F.lit(True)

    places: str | list[str] = path
    if max_images is not None:
        listed = reader("binaryFile").load(path).select("path").where(wanted("path"))
        first = listed.orderBy("path").limit(max_images).collect()
        places = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in first] or path  # names, not patterns
    rows = reader("image").option("dropInvalid", False).load(places).select("image.*").where(wanted("origin"))
    if places is path and max_images is not None:
        rows = rows.where(F.lit(False))
    bad = F.col("height") <= 0
    return rows.select(
        F.xxhash64("origin").alias("image_id"),
        "origin",
        p.stem(F.col("origin")).alias("stem"),
        p.level(F.col("origin"), 3).alias("category"),
        p.level(F.col("origin"), 2).alias("device_id"),
        p.surface(p.file_name(F.col("origin"))).alias("surface"),
        "height",
        "width",
        F.col("nChannels").alias("n_channels"),
        "data",
        F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, "not a readable image").alias("error"),
    )


def limit_images(images: DataFrame, n: int | None, order: str = "origin") -> DataFrame:
    """First ``n`` rows in path order; all for None.

    Paths are unique and not null; only they are ordered, and the rows up to the n-th path stay
    where they are.  (Were paths repeated, all rows of the n-th would stay.)
    """
    if n is None:
        return images
    last = images.select(order).orderBy(order).limit(n).agg(F.max(order))
    return images.where(F.col(order) <= last.scalar())


def images_to_tiles(images: DataFrame, size: int, layer: str = "photo", halve: bool = False) -> DataFrame:
    """Grey tiles of decoded photos (blue, green, red order in ``data``); error rows give none.

    ``halve`` takes the 2x2 area mean first.  A photo is one row already, so its tiles are
    cut in the task that decoded it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles():
            for batch in batches:
                for t in batch.to_pylist():
                    a = np.frombuffer(t["data"], np.uint8).reshape(t["height"], t["width"], t["n_channels"])
                    if t["n_channels"] >= 3:
                        gray = np.rint(a[..., 2] * LUMA[0] + a[..., 1] * LUMA[1] + a[..., 0] * LUMA[2])
                    else:
                        gray = a[..., 0].astype(float)
                    if halve:
                        h, w = gray.shape[0] // 2 * 2, gray.shape[1] // 2 * 2
                        gray = np.rint(gray[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3)))
                    gray = gray.astype(np.uint8)
                    for y0 in range(0, gray.shape[0], size):
                        for x0 in range(0, gray.shape[1], size):
                            part = gray[y0 : y0 + size, x0 : x0 + size]
                            yield {
                                "image_id": t["image_id"], "layer": layer, "ty": y0 // size, "tx": x0 // size, "y0": y0, "x0": x0,
                                "h": part.shape[0], "w": part.shape[1], "px": part.tobytes(),
                            }

        from panescan.operators.focal import TILE_ARROW

        yield from _batched(tiles(), TILE_ARROW)

    ok = images.where("status = 'ok'").select("image_id", "height", "width", "n_channels", "data")
    return ok.mapInArrow(cut, schema.TILE)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` as (path, dir, name, length); contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return rows.select(
        "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), p.file_name(F.col("path")).alias("name"), "length"
    )


def path_facts(files: DataFrame, path: str = "path") -> DataFrame:
    c = F.col(path)
    return files.select(
        "*", p.stem(c).alias("stem"), p.level(c, 3).alias("category"), p.level(c, 2).alias("device_id"), p.surface(p.file_name(c)).alias("surface")
    )


def pick_first(files: DataFrame, keys: Sequence[str] = ("category", "device_id", "surface")) -> DataFrame:
    """One file per group, the first by path."""
    return files.where(F.col("surface").isNotNull()).groupBy(*keys).agg(F.min("path").alias("path"))


def missing_groups(files: DataFrame, keys: Sequence[str] = ("category", "device_id")) -> DataFrame:
    """Surfaces a device has no file for; one aggregation, reported and not fatal."""
    seen = files.groupBy(*keys).agg(*[F.bool_or(F.coalesce(F.col("surface") == s, F.lit(False))).alias(s) for s in p.SURFACES])
    lacking = F.filter(F.array(*[F.when(~F.col(s), F.lit(s)) for s in p.SURFACES]), lambda s: s.isNotNull())
    return seen.select(*keys, F.explode(lacking).alias("surface"))


def patch_catalog(files: DataFrame) -> DataFrame:
    """Patch images of qualifying folders with patch number, offsets and source folder.

    ``files``: dir, name.
    """
    d = F.col("dir")
    rows = files.where(p.is_patch_folder(d) & F.col("name").startswith("synthetic_dirty_patch") & F.col("name").endswith(".png"))
    return rows.select("dir", "name", p.patch_facts(d).alias("f"), p.level(d, 3).alias("source")).select("dir", "name", "f.*", "source")


def resolve_by_priority(files: DataFrame, candidates: Sequence[str], key: str = "dir") -> DataFrame:
    """First existing name per folder of an ordered list; folders without any do not appear."""
    prio = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("name"))
    return (
        files.select(key, "name", prio.alias("prio")).where("prio > 0").groupBy(key)
        .agg(F.min_by("name", "prio").alias("name"), F.min("prio").alias("prio"))
    )


def resolve_scratch_masks(images: DataFrame, files: DataFrame, main_dir: str) -> DataFrame:
    """Inferred scratch mask per image stem: its own folder first, then the main folder.

    A generic name in the main folder serves every image, so the best one is found once, as
    a single value; the names that depend on the image meet the files by an equi join.
    """
    names = F.array(*[F.replace(F.lit(c), F.lit("{stem}"), F.col("stem")) for c in SCRATCH_MASKS])
    own = images.select("stem", F.concat(F.lit(main_dir + "/"), F.col("stem")).alias("dir"), F.posexplode(names).alias("prio", "name"))
    special = F.array(*[F.replace(F.lit(c), F.lit("{stem}"), F.col("stem")) for c in SCRATCH_MASKS if "{stem}" in c])
    main = images.select("stem", F.lit(main_dir).alias("dir"), F.posexplode(special).alias("prio", "name"))
    last = F.struct((F.col("prio") + len(SCRATCH_MASKS)).alias("prio"), "dir", "name").alias("f")
    wanted = own.select("stem", "dir", "name", F.struct("prio", "dir", "name").alias("f")).unionByName(main.select("stem", "dir", "name", last))
    found = wanted.join(files.select("dir", "name"), ["dir", "name"], "left_semi").select("stem", "f")
    generic = F.array_position(F.array(*[F.lit(c) for c in SCRATCH_MASKS if "{stem}" not in c]), F.col("name")).cast("int")
    served = files.where(F.col("dir") == main_dir).select((generic + 2 * len(SCRATCH_MASKS)).alias("prio"), "dir", "name", generic.alias("at"))
    common = served.where("at > 0").agg(F.min(F.struct("prio", "dir", "name")))
    every = images.where("stem is not null").select("stem", common.scalar().alias("f")).where("f is not null")
    return found.unionByName(every).groupBy("stem").agg(F.min("f").alias("f")).select("stem", "f.dir", "f.name")


def mask_type(name: Column) -> Column:
    return F.when(name.contains("multiclass"), "multiclass").otherwise("binary")


def validate_samples(files: DataFrame, require_multiclass: bool = False) -> DataFrame:
    """One row per folder: sample type, found files, validity and messages; invalid rows stay."""
    name = F.col("name")
    seen = files.groupBy("dir").agg(
        F.bool_or(name == SAMPLE_IMAGE).alias("has_image"),
        F.bool_or(name == SAMPLE_LABELS).alias("has_labels"),
        *[F.bool_or(name == m).alias(f"m{i}") for i, m in enumerate(TRUTH_MASKS_MULTICLASS)],
    )
    masks = F.filter(F.array(*[F.when(F.col(f"m{i}"), F.lit(m)) for i, m in enumerate(TRUTH_MASKS_MULTICLASS)]), lambda m: m.isNotNull())
    has_masks = F.size(masks) > 0
    has_multi = F.exists(masks, lambda m: m.contains("multiclass"))
    complete = F.col("has_image") & F.col("has_labels")
    errors = [
        F.when(~F.col("has_image"), F.lit(f"no {SAMPLE_IMAGE}: the sample has no picture")),
        F.when(~F.col("has_labels"), F.lit(f"no {SAMPLE_LABELS}: the sample has no annotations")),
        F.when(~has_multi, F.lit("a multi-class mask is required and absent")) if require_multiclass else F.lit(None).cast("string"),
        F.when(~has_masks, F.lit("the sample has no mask")),
    ]
    kind = F.when(complete & F.col("m0"), "multiclass").when(complete & F.col("m2"), "binary").otherwise("unknown")
    return seen.select(
        "dir", kind.alias("sample_type"), "has_image", "has_labels", masks.alias("masks"),
        (complete & (has_multi if require_multiclass else has_masks)).alias("valid"),
        F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"),
    )


def full_photo_samples(files: DataFrame) -> DataFrame:
    """Folders that hold an image, a mask and a label file of a whole photo, with the chosen names."""

    def best(candidates, alias):
        prio = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("name"))
        return F.min_by("name", F.when(prio > 0, prio)).alias(alias)

    found = files.groupBy("dir").agg(best(FULL_PHOTO_IMAGES, "image_file"), best(FULL_PHOTO_MASKS, "mask_file"), best(FULL_PHOTO_LABELS, "labels_file"))
    whole = F.col("image_file").isNotNull() & F.col("mask_file").isNotNull() & F.col("labels_file").isNotNull()
    return found.withColumns({"mask_type": F.when(F.col("mask_file").isNotNull(), mask_type(F.col("mask_file"))), "valid": whole})


def copy_manifest(picked: DataFrame, save_path: str) -> DataFrame:
    """(src, dst) pairs: the photo and the label file beside it, under fixed new names."""
    c = F.col("path")
    folder = F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    target = F.concat(F.lit(save_path + "/"), p.level(c, 3), F.lit("/"), p.stem(c))
    pairs = F.array(
        F.struct(c.alias("src"), F.concat(target, F.lit("/original_image.bmp")).alias("dst")),
        F.struct(F.concat(folder, F.lit("/coco.json")).alias("src"), F.concat(target, F.lit("/labels_patch.json")).alias("dst")),
    )
    return picked.select(F.inline(pairs))
