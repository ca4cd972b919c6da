"""Writers for patch units, copies and JSON documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan.operators.masks import binary_union, split_by_class
from panescan.sources.files import opened


def patch_masks(runs: DataFrame) -> DataFrame:
    """Mask layers of a patch unit: combined, multiclass and each non-empty class.

    ``runs``: image_id, class_id, y, x0, x1.
    """
    columns = ["image_id", "layer", "class_id", "y", "x0", "x1"]
    combined = binary_union(runs).withColumn("layer", F.lit("combined"))
    multi = runs.where("class_id > 0").withColumn("layer", F.lit("multiclass"))
    per_class = split_by_class(runs)
    return combined.select(columns).unionByName(multi.select(columns)).unionByName(per_class.select(columns))


def write_patches(tiles: DataFrame, runs: DataFrame, boxes: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """Patch images, mask runs, boxes and (optional) label documents as tables that keep ``image_id`` as a column.

    Rows are ordered by image within each file, so that a reader of some images skips the rest
    by file statistics; there is no folder per image.
    """
    parts = {"images": tiles, "masks": patch_masks(runs), "boxes": boxes} | ({} if labels is None else {"labels": labels})
    for name, rows in parts.items():
        writer = rows.sortWithinPartitions("image_id").write.mode("overwrite")
        (writer.partitionBy("layer") if name == "masks" else writer).parquet(f"{path}/{name}")


def _copy(src: str, dst: str) -> None:
    """Copy a file between any two file systems that pyarrow knows; the folder is made."""
    (source, start), (target, end) = opened(src), opened(dst)
    target.create_dir(os.path.dirname(end), recursive=True)
    fs.copy_files(start, end, source_filesystem=source, destination_filesystem=target)


def copy_files(manifest: DataFrame, report: str | None = None) -> DataFrame | None:
    """Copy (src, dst) pairs on the executors; both ends are places that all of them reach.

    With ``report``, a folder, every pair leaves a row (src, dst, error) there, error null where
    the copy is made, and these rows are returned; without it, a failed copy fails the job.
    """

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for pair in batch.to_pylist():
                try:
                    _copy(pair["src"], pair["dst"])
                    errors.append(None)
                except (OSError, pa.ArrowException) as error:
                    if report is None:
                        raise
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(errors, pa.string())], ["src", "dst", "error"])

    done = manifest.select("src", "dst").mapInArrow(copy, "src string, dst string, error string")
    if report is None:
        done.write.format("noop").mode("overwrite").save()
        return None
    done.write.mode("overwrite").parquet(report)
    return manifest.sparkSession.read.parquet(report)


def write_json_rows(documents: DataFrame, path: str) -> None:
    documents.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
