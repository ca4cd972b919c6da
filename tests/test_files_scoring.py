import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import dense, pixel_rows
from panescan.operators import raster, scoring, voting
from panescan.plans.inspect import inspect
from panescan.sources import catalog, labels, sinks

RNG = np.random.default_rng(3)


def bmp(rgb: np.ndarray) -> bytes:
    """24-bit bitmap of an h x w x 3 array."""
    h, w, _ = rgb.shape
    pad = -w * 3 % 4
    body = b"".join(rgb[y, :, ::-1].astype(np.uint8).tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


@pytest.fixture()
def photos(tmp_path):
    folder = tmp_path / "dirt" / "dev1"
    folder.mkdir(parents=True)
    pictures = {"a_1_0_0_7.bmp": RNG.integers(0, 256, (10, 13, 3)), "a_2_3_1_7.bmp": RNG.integers(0, 256, (6, 6, 3))}
    for name, rgb in pictures.items():
        (folder / name).write_bytes(bmp(rgb))
    (folder / "broken.bmp").write_bytes(b"BM not an image")
    (folder / "UPPER.BMP").write_bytes(bmp(pictures["a_2_3_1_7.bmp"]))
    (folder / "notes.txt").write_text("no image")
    return folder, pictures


def test_scan_images(spark, photos):
    folder, pictures = photos
    rows = {r["origin"].rsplit("/", 1)[1]: r for r in catalog.scan_images(spark, str(folder)).collect()}
    assert rows.keys() == {*pictures, "broken.bmp"}
    assert rows["broken.bmp"]["status"] == "error" and rows["a_1_0_0_7.bmp"]["status"] == "ok"
    assert (rows["a_1_0_0_7.bmp"]["height"], rows["a_1_0_0_7.bmp"]["width"]) == (10, 13)
    assert (rows["a_1_0_0_7.bmp"]["category"], rows["a_1_0_0_7.bmp"]["device_id"]) == ("dirt", "dev1")
    assert (rows["a_1_0_0_7.bmp"]["surface"], rows["a_2_3_1_7.bmp"]["surface"]) == ("frontal", "rear")
    assert catalog.scan_images(spark, str(folder), any_case=True).count() == 4
    assert catalog.scan_images(spark, str(folder), max_images=2).count() == 2


@pytest.mark.parametrize("halve", [False, True])
def test_images_to_tiles(spark, photos, halve):
    folder, pictures = photos
    images = catalog.scan_images(spark, str(folder))
    tiles = catalog.images_to_tiles(images, 4, halve=halve)
    for name, rgb in pictures.items():
        gray = np.rint(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114)
        if halve:
            h, w = gray.shape[0] // 2, gray.shape[1] // 2
            gray = np.rint(gray[: h * 2, : w * 2].reshape(h, 2, w, 2).mean(axis=(1, 3)))
        own = images.where(F.col("origin").endswith(name)).select("image_id")
        got = dense(raster.tiles_to_pixels(tiles.join(own, "image_id").select(*tiles.columns)), gray.shape)
        assert (got == gray).all()


def test_list_and_copy_files(spark, photos, tmp_path):
    folder, _ = photos
    (folder / "coco.json").write_text("{}")
    files = catalog.list_files(spark, str(tmp_path / "dirt"))
    picked = catalog.pick_first(catalog.path_facts(files.where("name like '%.bmp'")))
    assert {r["surface"] for r in picked.collect()} == {"frontal", "rear"}
    target = tmp_path / "copies"
    pairs = catalog.copy_manifest(picked.withColumn("path", F.regexp_replace("path", "^file:/*", "/")), str(target))
    sinks.copy_files(pairs)
    made = sorted(str(p.relative_to(target)) for p in target.rglob("*.*"))
    assert made == [
        "dirt/a_1_0_0_7/labels_patch.json", "dirt/a_1_0_0_7/original_image.bmp", "dirt/a_2_3_1_7/labels_patch.json", "dirt/a_2_3_1_7/original_image.bmp",
    ]


def test_copies_take_uris_and_report_failures(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.txt").write_text("x")
    pairs = [(f"file:{tmp_path}/a b/x.txt", f"file://{tmp_path}/out/deep/x.txt"), (f"{tmp_path}/none.txt", f"{tmp_path}/out/none.txt")]
    manifest = spark.createDataFrame(pairs, "src string, dst string")
    rows = {r["src"]: r["error"] for r in sinks.copy_files(manifest, str(tmp_path / "report")).collect()}
    assert rows[pairs[0][0]] is None and "none.txt" in rows[pairs[1][0]]
    assert (tmp_path / "out" / "deep" / "x.txt").read_text() == "x"
    with pytest.raises(Exception, match="none.txt"):
        sinks.copy_files(manifest)


def test_limits_read_the_first_photos_only(spark, photos, tmp_path):
    folder, _ = photos
    names = sorted(f.name for f in folder.iterdir() if f.suffix == ".bmp")
    for n in (0, 1, 2):
        rows = catalog.scan_images(spark, str(folder), max_images=n)
        assert sorted(r["origin"].rsplit("/", 1)[1] for r in rows.collect()) == names[:n]
    odd = tmp_path / "odd"
    odd.mkdir()
    for name in ("a[1].bmp", "b{x}.bmp", "c.bmp"):
        (odd / name).write_bytes((folder / names[0]).read_bytes())
    every = sorted(r["stem"] for r in catalog.scan_images(spark, str(odd)).collect())
    assert len(every) == 3 and sorted(r["stem"] for r in catalog.scan_images(spark, str(odd), max_images=2).collect()) == every[:2]
    paths = spark.createDataFrame([(f"p{i:02d}",) for i in range(30)], "path string")
    assert sorted(r["path"] for r in catalog.limit_images(paths, 3, "path").collect()) == ["p00", "p01", "p02"]
    assert catalog.limit_images(paths, 0, "path").count() == 0 and catalog.limit_images(paths, None).count() == 30


def test_scratch_masks_of_the_main_folder(spark):
    images = spark.createDataFrame([("s1",), ("s2",), ("s3",), (None,)], "stem string")
    files = [("m/s1", "scratches_mask.png"), ("m", "s2_screen_scratches_mask.png"), ("m", "dirt_mask.png"), ("m", "scratches_mask.png")]
    found = catalog.resolve_scratch_masks(images, spark.createDataFrame(files, "dir string, name string"), "m")
    assert {r["stem"]: (r["dir"], r["name"]) for r in found.collect()} == {"s1": files[0], "s2": files[1], "s3": files[2]}
    alone = catalog.resolve_scratch_masks(images, spark.createDataFrame(files[:1], "dir string, name string"), "m")
    assert [tuple(r) for r in alone.collect()] == [("s1", *files[0])]


def test_label_files(spark, tmp_path):
    doc = {
        "annotations": [{"bbox": [1, 2, 3, 4], "segmentation": [[1, 2, 4, 2, 4, 6]], "category_id": 2, "category_name": "dirt", "area": 12}],
        "categories": {"2": {"name": "dirt", "supercategory": "defect", "id": 2}}, "image_size": [10, 20], "boundary_pixels": [0, 0, 20, 10],
        "category_statistics": {"dirt": 1}, "original_global_offset": [5, 6], "parent_image": "p.bmp", "patch_boundary_in_full": [0, 0, 5, 5],
    }
    (tmp_path / "labels_patch.json").write_text(json.dumps(doc, indent=2))
    rows = labels.read_labels(spark, str(tmp_path), patch=True)
    one = rows.first()
    assert one["parent_image"] == "p.bmp" and one["categories"]["2"]["name"] == "dirt" and one["success_rates"] is None
    ann = labels.explode_annotations(rows).first()
    assert (ann["x"], ann["y"], ann["w"], ann["h"], ann["area"]) == (1, 2, 3, 4, 12)
    out = str(tmp_path / "out")
    labels.write_labels(rows.select(F.lit(4).alias("image_id"), F.to_json(F.struct("annotations")).alias("json")), out)
    again = spark.read.text(out).select(labels.parse_labels(F.col("value")).alias("l")).first()
    assert again["l"]["annotations"][0]["area"] == 12


def test_coco_joins_by_id(spark, tmp_path):
    coco = {
        "images": [{"id": 3, "file_name": "c.bmp", "width": 250, "height": 500}, {"id": 9, "file_name": "i.bmp", "width": 250, "height": 500}],
        "annotations": [{"image_id": 9, "category_id": 5, "bbox": [25, 50, 62.5, 50]}, {"image_id": 3, "category_id": 4, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 4, "name": "other"}, {"id": 5, "name": "suction"}],
    }
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    rows = labels.coco_to_yolo(labels.explode_coco(labels.read_coco(spark, str(tmp_path)), "suction")).collect()
    assert [(r["file_name"], r["cx"], r["cy"], r["nw"], r["nh"]) for r in rows] == [("i.bmp", 0.2, 0.15, 0.2, 0.1)]  # 62.5/25 = 2.5 -> 2
    assert labels.explode_coco(labels.read_coco(spark, str(tmp_path)), "absent").count() == 0
    out = str(tmp_path / "yolo")
    labels.write_yolo(labels.coco_to_yolo(labels.explode_coco(labels.read_coco(spark, str(tmp_path)), "suction")), out)
    assert spark.read.text(out).first()["value"] == "0 0.2 0.15 0.2 0.1"


def test_write_patches(spark, tmp_path):
    a = np.zeros((8, 8), int)
    a[1, 1:4], a[5, 2] = 1, 3
    px = pixel_rows(spark, {(1, "m"): a})
    runs = raster.pixels_to_runs(px)
    boxes = spark.createDataFrame([(1, 1, 2, 3)], "image_id long, ann_id long, x int, y int")
    sinks.write_patches(raster.pixels_to_tiles(px, 4), runs, boxes, str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p" / "masks"))
    counts = {r["layer"]: r["n"] for r in kept.groupBy("layer").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).collect()}
    assert counts == {"combined": 4, "multiclass": 4, "class_1": 3, "class_3": 1}  # no empty class_2
    assert spark.read.parquet(str(tmp_path / "p" / "images")).count() == 4


# ------------------------------------------------------------------------------ scoring
def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(no, value):
    if isinstance(value, int):
        return varint(no << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(no << 3 | 2) + varint(len(value)) + value


def conv_model(weights, bias) -> bytes:
    """An ONNX model y = conv1x1(x) written as raw protobuf: one input channel, len(weights) classes."""

    def tensor(name, dims, values):
        return b"".join(field(1, d) for d in dims) + field(2, 1) + field(8, name) + field(9, np.asarray(values, np.float32).tobytes())

    def value_info(name, dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    n = len(weights)
    node = field(1, "x") + field(1, "w") + field(1, "b") + field(2, "y") + field(4, "Conv")
    graph = (
        field(1, node) + field(2, "g") + field(5, tensor("w", [n, 1, 1, 1], weights)) + field(5, tensor("b", [n], bias))
        + field(11, value_info("x", ["n", 1, "h", "w"])) + field(12, value_info("y", ["n", n, "h", "w"]))
    )
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


W, B = [0.0, 4.0, 9.0, 16.0], [2.0, 0.0, -3.0, -9.0]


def test_onnx_scoring(spark, tmp_path):
    path = tmp_path / "tiny_levels.onnx"
    path.write_bytes(conv_model(W, B))
    spark.sparkContext.addFile(str(path))
    a = RNG.integers(0, 256, (11, 9))
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(1, "g"): a}), 5)
    frames = spark.createDataFrame([(1, 0, 0, 9, 11)], "image_id long, x int, y int, w int, h int")
    patches = scoring.cut_patches(tiles, frames, 4, 1)
    padded = {(r["y0"], r["x0"]): np.frombuffer(r["px"], np.uint8).reshape(4, 4) for r in patches.collect()}
    assert set(padded) == {(y, x) for y in range(0, 11, 3) for x in range(0, 9, 3)}
    assert (padded[(9, 6)][2:, :] == 0).all() and (padded[(9, 6)][:2, :3] == a[9:, 6:]).all()
    scored, seen = scoring.observe_classes(scoring.score(patches, scoring.onnx_model("tiny_levels.onnx")), "onnx")
    assert scored.where("status <> 'ok'").count() == 0
    scored.write.format("noop").mode("overwrite").save()
    assert seen.get == {"num_classes": 4, "errors": 0}
    got = dense(raster.tiles_to_pixels(voting.vote_tiles(scored, frames, 6).drop("probs", "cover")), a.shape)
    logits = (a / 255.0)[None] * np.array(W)[:, None, None] + np.array(B)[:, None, None]
    assert (got == logits.argmax(axis=0)).all()


def test_failing_patch_is_a_row_and_does_not_vote(spark):
    def failing():
        def predict(images):
            if images.max() > 0.9:
                raise RuntimeError("too bright")
            return np.repeat(images[:, None], 4, axis=1)

        return predict

    a = np.zeros((8, 8), int)
    a[:4, :4] = 255
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(1, "g"): a}), 8)
    frames = spark.createDataFrame([(1, 0, 0, 8, 8)], "image_id long, x int, y int, w int, h int")
    scored = scoring.score(scoring.cut_patches(tiles, frames, 4, 0), failing)
    rows = {r["patch_id"]: r for r in scored.collect()}
    assert rows[0]["status"] == "error" and rows[0]["probs"] is None and "too bright" in rows[0]["error"]
    assert [rows[i]["status"] for i in (1, 2, 3)] == ["ok"] * 3
    tile = voting.vote_tiles(scored, frames, 8).first()
    cover = np.frombuffer(tile["cover"], np.int32)
    assert (cover == 1).all() and tile["h"] * tile["w"] == 64  # uncovered pixels count as 1 with zero scores
    detections = scoring.detect(tiles.withColumn("px", F.lit(b"x")), failing, 2)
    assert detections.first()["status"] == "error"


def test_target_size_and_modes(spark):
    a = np.repeat(np.repeat(RNG.integers(0, 256, (4, 4)), 2, 0), 2, 1)
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(1, "g"): a, (2, "g"): a}), 8)
    frames = spark.createDataFrame([(i, 0, 0, 8, 8) for i in (1, 2)], "image_id long, x int, y int, w int, h int")
    patches = scoring.cut_patches(tiles, frames, 8, 0)

    def quarter():
        return lambda images: np.stack([1 - images, images, images * 0, images * 0], axis=1)

    whole = sorted(bytes(r["probs"]) for r in scoring.score(patches, quarter).collect())
    assert whole == sorted(bytes(r["probs"]) for r in scoring.score(patches, quarter, (4, 4)).collect())
    one = inspect(tiles, frames, quarter, patch_size=8, overlap=0, tile=8, only_image=2)
    assert {r["image_id"] for r in one["class_stats"].collect()} == {2}
    assert "metrics" not in one
    truth = one["class_runs"]
    same = inspect(tiles, frames, quarter, patch_size=8, overlap=0, tile=8, only_image=2, truth=truth)["metrics"].collect()
    assert all(r["iou"] == 1 for r in same)


def test_vote_forms_agree_with_overlap(spark):
    rows = []
    for pid, (y0, x0) in enumerate([(0, 0), (0, 3), (2, 1), (5, 5)]):
        for y in range(4):
            for x in range(4):
                e = RNG.integers(1, 9, 4) / 8.0
                rows.append((1, pid, y0 + y, x0 + x, [float(v) for v in e], "error" if pid == 1 else "ok"))
    px = spark.createDataFrame(rows, "image_id long, patch_id long, y int, x int, probs array<double>, status string")
    frames = spark.createDataFrame([(1, 7, 8)], "image_id long, h int, w int")
    by_pixel = {(r["y"], r["x"]): (r["class_id"], r["n"]) for r in voting.vote_pixels(px.where("y < 7 and x < 8"), frames).collect()}
    packed = voting.pack_patches(px).withColumn("status", F.when(F.col("patch_id") == 1, "error").otherwise("ok"))
    for size in (3, 8):
        tiles = voting.vote_tiles(packed, frames, size)
        got = {(r["y"], r["x"]): r["value"] for r in raster.tiles_to_pixels(tiles.drop("probs", "cover")).collect()}
        assert got == {k: v[0] for k, v in by_pixel.items()}


def test_every_scorer_is_its_own(spark):
    """Closures made and dropped one after another never get each other's model, and a worker keeps few."""
    patch = spark.createDataFrame([(1, 0, 0, 0, 2, 2, bytearray(4))], scoring.PATCH)
    for level in range(6):
        scored = scoring.score(patch, lambda level=level: lambda images: np.full((1, 4, *images.shape[1:]), level, np.float32)).first()
        assert np.frombuffer(scored["probs"], np.float32)[0] == level
    for i in range(10):
        assert scoring._worker_scorer(str(i), lambda i=i: i) == i and len(scoring._loaded) <= scoring.LOADED


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("with_truth", [True, False])
@pytest.mark.parametrize("only", [None, 2**62 + 5])
def test_inspection_scores_every_patch_once(spark, full, with_truth, only):
    """All eight modes, with image ids as large as hashes: one model call per patch over all tables."""
    ids = [2**62 + 5, -(2**62)]
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(i, "g"): RNG.integers(0, 256, (8, 8)) for i in ids}), 8)
    frames = spark.createDataFrame([(i, 0, 0, 8, 8) for i in ids], "image_id long, x int, y int, w int, h int")
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def predict(images):
            calls.add(1)
            return np.stack([1 - images, images, images * 0, images * 0], axis=1)

        return predict

    truth = None
    if with_truth:
        keys = "image_id long, layer string, class_id int, y int, x0 int, x1 int" + ("" if full else ", patch_id long")
        truth = spark.createDataFrame([(i, "truth", 1, 0, 0, 3, *([] if full else [0])) for i in ids], keys)
    tables = inspect(tiles, frames, counting, patch_size=4, overlap=0, tile=8, full=full, truth=truth, only_image=only)
    images = {only} if only else set(ids)
    names = ["status", "class_runs", "class_stats", "regions", *(["metrics"] if with_truth else [])]
    for name in names:
        rows = tables[name].collect()
        assert {r["image_id"] for r in rows} == images, name
        assert full or {r["patch_id"] for r in rows} <= set(range(4)), name
    assert tables["summary"].count() > 0 and calls.value == 4 * len(images)


def some_patches(spark, n, shapes=((4, 4), (3, 5)), partitions=1):
    rows = []
    for i in range(n):
        h, w = shapes[i % len(shapes)]
        rows.append((i // 8, i % 8, 0, 0, h, w, bytearray(RNG.integers(0, 200, h * w).astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, scoring.PATCH).coalesce(partitions)


def counted(spark, bad=lambda image: False):
    calls = spark.sparkContext.accumulator(0)

    def scorer():
        def predict(images):
            calls.add(1)
            if any(bad(i) for i in images):
                raise RuntimeError("bad patch")
            return np.stack([1 - images, images, images * 0, images * 0], axis=1)

        return predict

    return scorer, calls


def as_rows(scored):
    return sorted((r["image_id"], r["patch_id"], r["h"], r["w"], r["status"], r["error"], r["probs"]) for r in scored.collect())


def test_stacks_give_the_rows_of_single_calls(spark):
    patches = some_patches(spark, 64).cache()
    alone, single_calls = counted(spark)
    stacked, stacked_calls = counted(spark)
    assert as_rows(scoring.score(patches, alone)) == as_rows(scoring.score(patches, stacked, stack_bytes=16 * 64))
    assert single_calls.value == 64 and stacked_calls.value <= 8


def test_failing_patches_are_found_in_their_stacks(spark):
    marks = {3, 4, 17, 40}
    rows = [(0, i, 0, 0, 2, 2, bytearray([255 if i in marks else i, 0, 0, 0])) for i in range(64)]
    patches = spark.createDataFrame(rows, scoring.PATCH).coalesce(1).cache()
    alone, _ = counted(spark, lambda image: image[0, 0] == 1)
    stacked, calls = counted(spark, lambda image: image[0, 0] == 1)
    wanted = as_rows(scoring.score(patches, alone))
    assert wanted == as_rows(scoring.score(patches, stacked, stack_bytes=1 << 20))
    assert {r[1] for r in wanted if r[4] == "error"} == marks and calls.value <= 2 * len(marks) * 7


def test_wrong_number_of_results_and_bad_bytes_are_errors(spark):
    patches = some_patches(spark, 6, ((2, 2),))
    short = scoring.score(patches, lambda: lambda images: np.zeros((len(images) + 1, 4, 2, 2)), stack_bytes=1 << 20).collect()
    assert all(r["status"] == "error" and "results for" in r["error"] for r in short)
    cut = patches.withColumn("px", F.when(F.col("patch_id") == 2, F.lit(b"x").cast("binary")).otherwise(F.col("px")))
    scorer, _ = counted(spark)
    assert [r["patch_id"] for r in scoring.score(cut, scorer, stack_bytes=1 << 20).where("status = 'error'").collect()] == [2]


def test_cubic_weights_keep_constants_and_lines():
    for n, m in ((2, 4), (7, 3), (5, 5), (8, 21), (1, 6)):
        weights = scoring._cubic_weights(n, m)
        assert np.allclose(weights.sum(axis=1), 1)
    line = scoring._cubic_weights(12, 12) @ np.arange(12.0)
    assert np.allclose(line, np.arange(12))
    flat = scoring.resize_cubic(np.full((3, 4, 4), 0.25), 9, 7)
    assert flat.shape == (3, 9, 7) and np.allclose(flat, 0.25)
    with pytest.raises(ValueError, match="unknown resize"):
        scoring.score(None, None, shrink="cubic")


def test_class_check_measures_while_it_stores(spark):
    scorer, calls = counted(spark)
    kept, report = scoring.check_classes(scoring.score(some_patches(spark, 8), scorer), ["a", "b", "c", "d"])
    assert report.collect() == [(4, 0, [])] and kept.count() == 8 and calls.value == 8
    _, odd = scoring.check_classes(scoring.score(some_patches(spark, 8), scorer), ["a"])
    assert "4 classes but 1 names" in odd.first()["warnings"][0]
    failing, _ = counted(spark, lambda image: True)
    assert scoring.check_classes(scoring.score(some_patches(spark, 8), failing), ["a"])[1].collect() == [(None, 8, ["no patch was scored"])]


def test_batches_of_small_rows_are_bounded_by_rows():
    rows = ({"image_id": i, "patch_id": 0, "x0": 0, "y0": 0, "h": 1, "w": 1, "px": b"1"} for i in range(20_000))
    sizes = [b.num_rows for b in voting._batched(rows, scoring._PATCH_ARROW)]
    assert sum(sizes) == 20_000 and max(sizes) <= 4096


def test_tiles_vote_on_doubles(spark):
    """Class 1 leads by less than a float32 can hold."""
    probs = [0.3, 0.3 + 1e-12, 0.2, 0.2 - 1e-12]
    px = spark.createDataFrame([(1, 0, 0, x, probs) for x in range(2)], "image_id long, patch_id long, y int, x int, probs array<double>")
    frames = spark.createDataFrame([(1, 1, 2)], "image_id long, h int, w int")
    tiles = voting.vote_tiles(voting.pack_patches(px), frames, 1)
    assert [r["value"] for r in raster.tiles_to_pixels(tiles.drop("probs", "cover")).collect()] == [1, 1]
