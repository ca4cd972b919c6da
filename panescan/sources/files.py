"""Files as rows: a sink that writes one file per name, in the tasks, a reader of many, and photos as bitmaps.

The sink is a Python data source.  Executors write straight to the target, which all of them
reach; each file is written in a hidden folder of its task and renamed when it is whole, so that a task
that is lost and run again leaves the same files, and readers never see half of one.  The names of a folder
are changed one at a time, so a file costs its folder the rename only.  Tasks report counts only.  ``_SUCCESS`` with the number of files and bytes is written at the end: a
folder without it is not complete.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from panescan.operators.raster import tile_array
from panescan.session import spread

FORMAT = "panescan_files"
BLOCK, BATCH_ROWS = 4 << 20, 4096
FILE_CELLS = 64  # what opening a file is worth: 8,192 files a task


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a place that is a local path or a URL pyarrow knows."""
    local = re.sub("^file:/+", "/", place)
    return fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), os.path.abspath(local))


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        target, root = opened(path)
        target.create_dir(root, recursive=True)
        if overwrite:
            target.delete_dir_contents(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        target, root = opened(self.path)
        made, files, size, name, sink = {root}, 0, 0, None, None
        own = f"{root}/.{uuid.uuid4().hex}"
        hidden = f"{own}/part"

        def close() -> None:
            if sink is not None:
                sink.close()
                target.move(hidden, f"{root}/{name}")

        for batch in iterator:
            for row, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if sink is None or row != name:
                    close()
                    sink = None
                    if not row or any(part in ("", ".", "..") for part in row.split("/")):
                        raise ValueError(f"not a file name below the folder: {row!r}")
                    for folder in {own, f"{root}/{row}".rpartition("/")[0]} - made:
                        target.create_dir(folder, recursive=True)
                        made.add(folder)
                    sink, name, files = target.open_output_stream(hidden), row, files + 1
                if content.is_valid:
                    data = content.as_buffer()
                    sink.write(data)
                    size += data.size
        close()
        if own in made:
            target.delete_dir(own)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        target, root = opened(self.path)
        done = [m for m in messages if m is not None]
        with target.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is taken back: files that are whole stay, and ``_SUCCESS`` is missing."""


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, order: Sequence[str] = (), overwrite: bool = True, names: DataFrame | None = None) -> None:
    """One file per ``name`` (a path below ``path``) with ``content``, text or bytes; null content is empty.

    Without ``order`` a row is a file, written where it lies, and a repeated name is an error,
    found on the names alone before anything is written.  ``names`` are the same names where they are had
    without making the contents, which are else made twice if Python makes them.  With ``order`` the rows of a name are the
    file's parts in that order: they meet in one task and stream into the file, so that memory is one batch
    however long a file is.  ``overwrite`` empties the folder first, else files of equal name are replaced.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    if order:
        rows = rows.repartition("name").sortWithinPartitions("name", *order)
    else:
        twice = (rows if names is None else names).groupBy("name").count().where("count > 1").select("name").take(1)
        if twice:
            raise ValueError(f"several rows are named {twice[0]['name']}")
    files = rows.select("name", F.col("content").cast("binary").alias("content"))
    files.write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append").save()


def names_below(place: str) -> Iterator[str]:
    """Names of all files below a folder; what starts with ``.`` or ``_`` is hidden, as it is for Spark."""
    target, root = opened(place)
    folders = [""]
    while folders:
        folder = folders.pop()
        if isinstance(target, fs.LocalFileSystem):  # streams, and asks nothing about the files
            found = ((entry.name, entry.is_dir()) for entry in os.scandir(f"{root}/{folder}"))
        else:
            infos = target.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/")))
            found = ((info.base_name, info.type == fs.FileType.Directory) for info in infos)
        for name, is_folder in found:
            if name.startswith(".") or (name.startswith("_") and "=" not in name):
                continue
            if is_folder:
                folders.append(f"{folder}{name}/")
            else:
                yield folder + name


def batched(rows: Iterator[tuple[str, bytes]], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of (name, ``column``) that hold at most BATCH_ROWS rows and, but for a single row, BLOCK bytes."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["name", column])

    names, values, size = [], [], 0
    for name, value in rows:
        if names and (size + len(value) > BLOCK or len(names) >= BATCH_ROWS):
            yield batch()
            names, values, size = [], [], 0
        names.append(name)
        values.append(value)
        size += len(value)
    if names:
        yield batch()


def lines_of(stream: pa.NativeFile) -> Iterator[bytes]:
    """Lines that are not blank, without their ends; memory is a block and a line."""
    rest = b""
    while block := stream.read(BLOCK):
        *lines, rest = (rest + block).splitlines(keepends=True)
        if rest.endswith(b"\n"):
            lines, rest = [*lines, rest], b""
        yield from (line.rstrip(b"\r\n") for line in lines if line.strip())
    if rest.strip():
        yield rest.rstrip(b"\r\n")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below a folder as (name, value), blank ones left out; for very many small files.

    Spark's own readers hold the status of each file on the driver and open few files a task.  Here a task
    lists the names, once to count them and once to deal them out, and they are opened where they come to.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            names = names_below(path)
            while some := list(islice(names, BATCH_ROWS)):
                yield pa.RecordBatch.from_pydict({"name": some})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = opened(path)

        def lines():
            for batch in batches:
                for name in batch.column("name").to_pylist():
                    with target.open_input_stream(f"{root}/{name}") as stream:
                        yield from ((name, line) for line in lines_of(stream))

        yield from batched(lines(), "value")

    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string")
    rows = spread(names, "name", FILE_CELLS).mapInArrow(read, "name string, value binary")
    return rows.withColumn("value", F.col("value").cast("string"))


def own_names(rows: DataFrame, name: str, keys: Sequence[str], suffix: str) -> DataFrame:
    """Adds ``name`` of the file of each (keys): the stem of the ``name`` column and ``suffix``.

    Where several keys share a stem, each gets the first 16 digits of its keys' md5 as well, so that
    their rows never meet in one file.
    """
    stem = F.regexp_replace(F.regexp_replace(F.col(name), r"^.*/", ""), r"\.[^.]*$", "")
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    named = rows.withColumns({"_stem": stem, "_key": key})
    shared = named.groupBy("_stem").agg((F.min("_key") != F.max("_key")).alias("_shared"))
    marked = F.when(F.col("_shared"), F.concat(F.lit("-"), F.substring(F.md5("_key"), 1, 16))).otherwise(F.lit(""))
    out = named.join(shared, "_stem").withColumn("_file", F.concat("_stem", marked, F.lit(suffix)))
    return out.drop("name", "_key", "_shared", "_stem").withColumnRenamed("_file", "name")


def bitmap(gray: np.ndarray) -> bytes:
    """24-bit bitmap of grey levels, rows from the bottom up, each padded to whole words."""
    h, w = gray.shape
    lines = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    lines[:, : 3 * w] = np.repeat(gray[::-1], 3, axis=1)
    head = struct.pack("<2sIHHI", b"BM", 54 + lines.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 0, 0, 0, 0) + lines.tobytes()


def bitmap_files(patches: DataFrame, name: str = "name") -> DataFrame:
    """Grey images that lie whole in a row (h, w, px) as (name, content) of a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from batched(((row["name"], bitmap(tile_array(row["px"], row["h"], row["w"]))) for row in rows), "content")

    return patches.select(F.col(name).alias("name"), "h", "w", "px").mapInArrow(run, "name string, content binary")
