"""Label files: nested annotation JSON, COCO, YOLO rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panescan import schema
from panescan.sources.files import own_names, read_lines, write_files


def read_labels(spark: SparkSession, path: str, patch: bool = False) -> DataFrame:
    """Label files, one row each, by the fixed schema (no inference), with their path as ``origin``."""
    fixed = schema.PATCH_LABEL_FILE if patch else schema.LABEL_FILE
    rows = spark.read.schema(fixed).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.select(F.input_file_name().alias("origin"), *rows.columns)


def parse_labels(json: Column, patch: bool = False) -> Column:
    return F.from_json(json, schema.PATCH_LABEL_FILE if patch else schema.LABEL_FILE)


def explode_annotations(labels: DataFrame, key: str = "origin") -> DataFrame:
    """One row per annotation, box as columns."""
    rows = labels.select(key, F.posexplode("annotations").alias("ann_no", "a"))
    return rows.select(
        key, "ann_no", *[F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")], "a.category_id", "a.category_name", "a.area", "a.segmentation"
    )


def label_document(annotations: Column, categories: Column, image_size: Column, boundary: Column, statistics: Column) -> Column:
    """JSON text of a label file."""
    return F.to_json(
        F.struct(
            annotations.alias("annotations"), categories.alias("categories"), image_size.alias("image_size"),
            boundary.alias("boundary_pixels"), statistics.alias("category_statistics"),
        )
    )


def category_map() -> Column:
    """Id-keyed category map of the label files."""
    entries = [
        F.struct(
            F.lit(str(i)).alias("key"),
            F.struct(F.lit(name).alias("name"), F.lit("defect").alias("supercategory"), F.lit(i).alias("id")).alias("value"),
        )
        for name, i, _ in schema.LABELS
        if i > 0
    ]
    return F.map_from_entries(F.array(*entries))


def write_labels(documents: DataFrame, path: str, key: str = "image_id", text: str = "json") -> None:
    """One file ``<key>.json`` per document, next to each other; a repeated key is an error."""
    name = F.concat(F.url_encode(F.col(key).cast("string")), F.lit(".json"))
    write_files(documents.select(name.alias("name"), F.col(text).alias("content")), path)


def read_rows(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of ``columns`` out of all files below a folder, one JSON object a line; a line that is none has nulls."""
    parsed = read_lines(spark, path).select(F.from_json("value", columns).alias("r"))
    return parsed.select("r.*")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """COCO files below ``path``: origin, images, annotations, categories."""
    rows = spark.read.schema(schema.COCO_FILE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.select(F.input_file_name().alias("origin"), *rows.columns)


def explode_coco(coco: DataFrame, category: str) -> DataFrame:
    """Boxes of one category with their image, joined by id; files without the category vanish."""
    wanted = F.filter("categories", lambda c: c["name"] == category)
    target = coco.select("origin", "images", "annotations", F.get(wanted, F.lit(0))["id"].alias("target")).where("target is not null")
    images = target.select("origin", F.inline("images")).select("origin", F.col("id").alias("image_id"), "file_name", "width", "height")
    anns = target.select("origin", "target", F.posexplode("annotations").alias("ann_no", "a")).where("a.category_id = target")
    boxes = anns.select("origin", F.col("a.image_id").alias("image_id"), "ann_no", *[F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")])
    return boxes.join(images, ["origin", "image_id"])


def coco_to_yolo(boxes: DataFrame, scale: int = 25, cls: int = 0) -> DataFrame:
    """Adds the detector label columns cls, cx, cy, nw, nh: boxes on the ``scale`` times smaller photo.

    Numbers round half to even; photo sides are cut.  Photos without boxes have no rows.
    """
    small = {c: F.bround(F.col(c) / F.lit(float(scale)), 0) for c in "xywh"}
    wide, high = F.floor(F.col("width") / scale), F.floor(F.col("height") / scale)
    return boxes.select(
        "*",
        F.lit(cls).alias("cls"),
        ((small["x"] + small["w"] / 2) / wide).alias("cx"),
        ((small["y"] + small["h"] / 2) / high).alias("cy"),
        (small["w"] / wide).alias("nw"),
        (small["h"] / high).alias("nh"),
    )


def write_yolo(rows: DataFrame, path: str, key: str = "file_name", order: str = "ann_no") -> None:
    """Text rows ``cls cx cy w h``, one file ``<stem>.txt`` per photo, next to each other.

    Photos of equal stem from different COCO files (``origin``), or of different names, get files of their own.
    """
    line = F.concat_ws(" ", *[F.col(c).cast(T.StringType()) for c in ("cls", "cx", "cy", "nw", "nh")])
    named = own_names(rows, key, [c for c in ("origin", key) if c in rows.columns], ".txt")
    write_files(named.select("name", F.col(order).alias("part"), F.concat(line, F.lit("\n")).alias("content")), path, ["part", "content"])
