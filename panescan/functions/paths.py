"""Facts read off file paths; plain string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: name patterns of the two photographed surfaces -------------------------
SURFACES = {"frontal": "^.*_.*_0_0_.*", "rear": "^.*_.*_3_1_.*"}
# --- fixed values: image suffixes of a batch scan -------------------------------------------
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "tiff", "tif"]


def level(path: Column, from_end: int) -> Column:
    """Path part counted from the end, 1 = file name; null when the path is too short."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def file_name(path: Column) -> Column:
    return level(path, 1)


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(file_name(path), ".", 1)


def stem_before_suffix(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def surface(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(p), s) for s, p in SURFACES.items()])


def is_patch_folder(folder: Column) -> Column:
    """``patch_*_x*_y*`` by its own name, or any folder below ``patches``."""
    name = level(folder, 1)
    named = name.startswith("patch_") & name.contains("_x") & name.contains("_y")
    return named | F.coalesce(level(folder, 2) == "patches", F.lit(False))


def patch_facts(folder: Column) -> Column:
    """patch_num, x, y of a patch folder name; null where a part is absent."""
    name = level(folder, 1)

    def number(pattern):
        return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).try_cast("int")

    return F.struct(
        number(r"(?:^|_)(\d+)(?:_|$)").alias("patch_num"), number(r"_x(\d+)_").alias("x"), number(r"_y(\d+)(?:_|$)").alias("y")
    )
