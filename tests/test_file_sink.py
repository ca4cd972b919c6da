"""The file sink: one file per name, parts in order, nothing mixed or half written."""

import gzip
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panescan import session
from panescan.checks import file_round_trips
from panescan.operators import raster
from panescan.sources import catalog, files, labels


def made(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_a_row_is_a_file(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.txt", "eins"), ("deep/er/b.txt", "zwei\n"), ("c d.txt", ""), ("n.txt", None)], "name string, content string")
    files.write_files(rows.repartition(3), out)
    found = made(out)
    assert json.loads(found.pop("_SUCCESS")) == {"files": 4, "bytes": 9}
    assert found == {"a.txt": b"eins", "deep/er/b.txt": b"zwei\n", "c d.txt": b"", "n.txt": b""}
    files.write_files(rows.where("name = 'a.txt'").withColumn("content", F.lit("neu")), out, overwrite=False)
    assert made(out)["a.txt"] == b"neu" and "n.txt" in made(out)
    files.write_files(rows.limit(0), out)
    assert made(out).keys() == {"_SUCCESS"}


def test_repeated_and_bad_names_are_errors(spark, tmp_path):
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], "name string, content string")
    with pytest.raises(ValueError, match="several rows are named a"):
        files.write_files(twice, str(tmp_path / "x"))
    for bad in ("../up", "/root", "", None, "a//b"):
        with pytest.raises(Exception, match="not a file name"):
            files.write_files(spark.createDataFrame([(bad, "1")], "name string, content string"), str(tmp_path / "y"))
    assert "_SUCCESS" not in made(tmp_path / "y")


def test_parts_stream_in_order(spark, tmp_path):
    rows = spark.range(30000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("name"), "id", F.concat(F.col("id"), F.lit("\n")).alias("content"))
    files.write_files(rows.orderBy(F.rand(4)), str(tmp_path / "p"), ["id"])
    for k in range(3):
        assert made(tmp_path / "p")[f"f{k}"].decode().split() == [str(i) for i in range(k, 30000, 3)]


def test_photos_of_one_name_do_not_mix(spark, tmp_path):
    columns = "origin string, file_name string, ann_no int, cls int, cx double, cy double, nw double, nh double"
    rows = [("a.json", "p.bmp", 1, 0, 0.1, 0.2, 0.3, 0.4), ("b.json", "p.bmp", 0, 0, 0.5, 0.6, 0.7, 0.8), ("a.json", "p.bmp", 0, 0, 0.0, 0.0, 0.0, 0.0), ("b.json", "x/q.r.bmp", 0, 1, 1.0, 1.0, 1.0, 1.0)]
    out = str(tmp_path / "yolo")
    labels.write_yolo(spark.createDataFrame(rows, columns), out)
    found = made(out)
    found.pop("_SUCCESS")
    assert found.pop("q.r.txt") == b"1 1.0 1.0 1.0 1.0\n" and len(found) == 2
    assert sorted(found.values()) == [b"0 0.0 0.0 0.0 0.0\n0 0.1 0.2 0.3 0.4\n", b"0 0.5 0.6 0.7 0.8\n"]
    assert all(name.startswith("p-") and len(name) == len("p-.txt") + 16 for name in found)


def test_labels_lie_next_to_each_other(spark, tmp_path):
    out = str(tmp_path / "labels")
    rows = spark.createDataFrame([("a/b", '{"annotations": []}'), ("c", "{}")], "image_id string, json string")
    labels.write_labels(rows, out)
    assert made(out).keys() == {"_SUCCESS", "a%2Fb.json", "c.json"}
    assert labels.read_labels(spark, out).count() == 2
    with pytest.raises(ValueError, match="several rows"):
        labels.write_labels(rows.withColumn("image_id", F.lit(1)), out)


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (4, 8)])
def test_bitmaps_are_read_back(spark, tmp_path, shape):
    a = np.random.default_rng(9).integers(0, 256, shape).astype(np.uint8)
    patches = spark.createDataFrame([("p.bmp", *shape, bytearray(a.tobytes()))], "name string, h int, w int, px binary")
    files.write_files(files.bitmap_files(patches), str(tmp_path / "photos"))
    tiles = catalog.images_to_tiles(catalog.scan_images(spark, str(tmp_path / "photos")), 8).collect()
    assert [(raster.tile_array(t["px"], t["h"], t["w"]) == a).all() for t in tiles] == [True]


def test_a_task_writes_in_its_own_folder(tmp_path):
    """A folder's names change one at a time, so files in the making lie elsewhere."""
    making = []

    def batches():
        for k in range(3):
            yield pa.RecordBatch.from_pydict({"name": [f"{k}.txt", f"deep/{k}.txt"], "content": [b"a", b"b"]})
            making.extend(p.relative_to(tmp_path) for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".txt")

    done = files.FileWriter(str(tmp_path), True).write(batches())
    assert (done.files, done.size) == (6, 6)
    assert len(making) == 3 and all(len(p.parts) == 2 and p.parts[0].startswith(".") for p in making)
    assert made(tmp_path) == {f"{d}{k}.txt": c for k in range(3) for d, c in (("", b"a"), ("deep/", b"b"))}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.txt", "1.txt", "2.txt", "deep"]


def test_many_small_files_are_read_in_few_tasks(spark):
    """Spark's reader opens about thirty files a task."""
    rows = file_round_trips.QUERIES["written_labels"](spark, "/root/testdata/sf0.01")
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert rows.distinct().count() == spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()


def test_lines_of_all_files_are_read(spark, tmp_path):
    texts = {"a": b'{"x": 1}', "b": b'{"x": 2}\n\n  \r\n{"x": 3}\r\n', "c": b"", "deep/er/d": b"{}\nno json\n", "e.gz": gzip.compress(b'{"x": 4}\n')}
    hidden = {".h": b'{"x": 5}', "_SUCCESS": b'{"x": 6}', "_own/x": b'{"x": 7}', ".own/x": b'{"x": 8}'}
    for name, text in (texts | hidden).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    lines = sorted(map(tuple, files.read_lines(spark, str(tmp_path)).collect()))
    assert lines == [("a", '{"x": 1}'), ("b", '{"x": 2}'), ("b", '{"x": 3}'), ("deep/er/d", "no json"), ("deep/er/d", "{}"), ("e.gz", '{"x": 4}')]
    same = spark.read.schema("x int").option("recursiveFileLookup", True).json(str(tmp_path))
    found = [r["x"] for r in labels.read_rows(spark, str(tmp_path), "x int").collect()]
    assert sorted(map(str, found)) == sorted(str(r["x"]) for r in same.collect()) == ["1", "2", "3", "4", "None", "None"]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_lines_go_over_blocks(monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK", block)
    text = b"ab\r\nc d \r\n\n \nlong line of words\r\nlast"
    assert list(files.lines_of(pa.BufferReader(text))) == [b"ab", b"c d ", b"long line of words", b"last"]


def test_tasks_follow_the_number_of_files(spark, tmp_path, monkeypatch):
    for k in range(50):
        (tmp_path / f"{k}.json").write_text(f'{{"x": {k}}}')
    monkeypatch.setattr(files, "FILE_CELLS", session.CELLS_PER_TASK // 2)
    rows = labels.read_rows(spark, str(tmp_path), "x int")
    assert rows.rdd.getNumPartitions() == 25 and sorted(r["x"] for r in rows.collect()) == list(range(50))


def test_contents_are_made_once(spark, tmp_path):
    made_rows = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made_rows.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("name")], ["name", "content"])

    names = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"))
    files.write_files(names.mapInArrow(make, "name string, content string"), str(tmp_path / "out"), names=names)
    assert made_rows.value == 40 and len(made(tmp_path / "out")) == 41
    twice = names.unionByName(names.limit(1))
    with pytest.raises(ValueError, match="several rows are named f"):
        files.write_files(twice.withColumn("content", F.lit("x")), str(tmp_path / "twice"), names=twice)


def test_batches_of_files_are_bounded(monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 10)
    monkeypatch.setattr(files, "BATCH_ROWS", 3)
    rows = [("a", b"x" * 6), ("b", b"x" * 4), ("c", b"x"), ("d", b"x" * 30), ("e", b""), ("f", b""), ("g", b""), ("h", b"")]
    found = list(files.batched(iter(rows), "content"))
    assert [b.column("name").to_pylist() for b in found] == [["a", "b"], ["c"], ["d"], ["e", "f", "g"], ["h"]]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == rows
