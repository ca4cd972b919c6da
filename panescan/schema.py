"""Fixed schemas and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: label, index, sampling weight -------------------------------------
LABELS = [
    ("background", 0, 0.01),
    ("condensation", 1, 0.3),
    ("dirt", 2, 0.3),
    ("scratch", 3, 0.3),
]
# --- fixed values: class weights of the training loss (not the sampling weights) -------
LOSS_WEIGHTS = [0.3, 1.0, 1.0, 1.2]
# --- fixed values: annotation palette (r, g, b) -> defect name -> class index ----------
PALETTE = [
    (0, 255, 255, "smudge", 2),
    (66, 0, 96, "dirt", 2),
    (0, 173, 105, "glue", 2),
    (255, 91, 0, "fingerprint", 2),
    (255, 240, 0, "condensation", 1),
    (0, 0, 255, "scratch", 3),
    (255, 0, 0, "unknown", 2),
]

CLASS_COUNT = len(LABELS)

ANNOTATION = T.StructType(
    [
        T.StructField("bbox", T.ArrayType(T.IntegerType())),
        T.StructField("segmentation", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("area", T.IntegerType()),
    ]
)
CATEGORY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("supercategory", T.StringType()),
        T.StructField("id", T.IntegerType()),
    ]
)
RATE = T.StructType(
    [
        T.StructField("attempted", T.IntegerType()),
        T.StructField("successful", T.IntegerType()),
        T.StructField("success_rate_percent", T.DoubleType()),
    ]
)
LABEL_FILE = T.StructType(
    [
        T.StructField("annotations", T.ArrayType(ANNOTATION)),
        T.StructField("categories", T.MapType(T.StringType(), CATEGORY)),
        T.StructField("image_size", T.ArrayType(T.IntegerType())),
        T.StructField("boundary_pixels", T.ArrayType(T.IntegerType())),
        T.StructField("category_statistics", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("category_counts_attempted", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("success_rates", T.MapType(T.StringType(), RATE)),
    ]
)
PATCH_LABEL_FILE = T.StructType(
    LABEL_FILE.fields
    + [
        T.StructField("original_global_offset", T.ArrayType(T.IntegerType())),
        T.StructField("parent_image", T.StringType()),
        T.StructField("patch_boundary_in_full", T.ArrayType(T.IntegerType())),
    ]
)
COCO_FILE = T.StructType(
    [
        T.StructField(
            "images",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("file_name", T.StringType()),
                        T.StructField("width", T.IntegerType()),
                        T.StructField("height", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "annotations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("image_id", T.LongType()),
                        T.StructField("category_id", T.IntegerType()),
                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                    ]
                )
            ),
        ),
        T.StructField(
            "categories",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.IntegerType()),
                        T.StructField("name", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

TILE = "image_id long, layer string, ty int, tx int, y0 int, x0 int, h int, w int, px binary"
RUN = "image_id long, layer string, class_id int, y int, x0 int, x1 int"


def labels_dim(spark: SparkSession) -> DataFrame:
    """The four-row label dimension; safe to broadcast by construction."""
    return spark.createDataFrame(LABELS, "class_name string, class_id int, weight double")


def palette_dim(spark: SparkSession) -> DataFrame:
    """The seven-row annotation palette; safe to broadcast by construction."""
    return spark.createDataFrame(PALETTE, "r int, g int, b int, defect string, class_id int")


def class_name_of(class_id):
    """Class name for a class id column, without a join; null when unknown."""
    names = F.array(*[F.lit(name) for name, _, _ in LABELS])
    return F.try_element_at(names, (class_id + 1).cast("int"))
