import random

import pytest
from pyspark.sql import functions as F

from panescan.checks import derived, files_plans
from panescan.operators import patches, scoring
from panescan.plans import history, placement, sampling

FRAMES = "image_id long, x long, y long, w long, h long"
BOXES = "image_id long, ann_id long, category_id long, x long, y long, w long, h long"


def test_patches_cover_the_frame_once(spark):
    frames = spark.createDataFrame([(1, 3, 5, 100, 70), (2, 0, 0, 64, 64), (3, 0, 0, 0, 5)], FRAMES)
    rows = patches.patch_grid(frames, 32, 0).collect()
    area = {}
    for r in rows:
        area[r["image_id"]] = area.get(r["image_id"], 0) + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    assert area == {1: 7000, 2: 4096}
    assert [r["patch_id"] for r in rows if r["image_id"] == 2] == [0, 1, 2, 3]


@pytest.mark.parametrize("overlap", [0, 0.25, 7])
def test_boxes_to_patches_brute_force(spark, overlap):
    frames = [(1, 10, 20, 90, 75)]
    boxes = [
        (1, 1, 1, 10, 20, 32, 32),  # exactly one cell
        (1, 2, 1, 42, 20, 5, 5),  # starts on a grid line
        (1, 3, 2, 30, 40, 40, 40),  # over four patches
        (1, 4, 2, 200, 200, 5, 5),  # outside
        (1, 5, 3, 0, 0, 10, 20),  # touches the corner only
        (1, 6, 3, 0, 0, 300, 300),  # larger than the frame
        (1, 7, 3, 99, 94, 4, 4),
    ]
    step = patches.grid_step(32, overlap)
    want = set()
    _, fx, fy, fw, fh = frames[0]
    cols = len(range(fx, fx + fw, step))
    for i, py in enumerate(range(fy, fy + fh, step)):
        for j, px in enumerate(range(fx, fx + fw, step)):
            x1, y1 = min(px + 32, fx + fw), min(py + 32, fy + fh)
            for _, ann, _, x, y, w, h in boxes:
                bw, bh = min(x + w, x1) - max(x, px), min(y + h, y1) - max(y, py)
                if bw > 0 and bh > 0:
                    want.add((i * cols + j, ann, max(x, px) - px, max(y, py) - py, bw, bh))
    fr, bx = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(boxes, BOXES)
    got = {(r["patch_id"], r["ann_id"], r["bx"], r["by"], r["bw"], r["bh"]) for r in patches.boxes_to_patches(bx, fr, 32, overlap).collect()}
    assert got == want
    kept = patches.boxes_to_patches(bx, fr, 32, overlap, keep_empty=True)
    assert kept.select("patch_id").distinct().count() == patches.patch_grid(fr, 32, overlap).count()


def test_bad_steps():
    for size, overlap in ((32, 1.0), (32, 32), (1, 0.5)):
        with pytest.raises(ValueError):
            patches.grid_step(size, overlap)


def plan_is_stable(spark, build):
    seen = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(build(int(n)).collect()))
    assert seen[0] == seen[1] == seen[2] and seen[0]
    return seen[0]


def test_split_is_exact_and_stable(spark):
    def build(n):
        return sampling.train_val_split(spark.range(0, 1003).repartition(n), "id")

    rows = plan_is_stable(spark, build)
    assert sum(r["split"] == "val" for r in rows) == 201 and len(rows) == 1003


def test_weighted_draw_loses_empty_categories(spark):
    slots = spark.range(0, 4000).withColumnRenamed("id", "slot")
    samples = spark.range(0, 50).select(F.col("id").alias("sample_id"), F.lit("dirt").alias("category"))
    weights = [("dirt", 0.3), ("scratch", 0.7)]
    rows = plan_is_stable(spark, lambda n: sampling.weighted_draw(slots.repartition(n), samples, weights, 1, ["slot"]))
    assert 1000 < len(rows) < 1400 and len({r["sample_id"] for r in rows}) == 50


def test_placements_never_overlap(spark):
    slots = spark.range(0, 20).select(
        F.col("id").alias("image_id"), *[F.lit(v).cast("bigint").alias(c) for c, v in (("x", 5), ("y", 7), ("w", 400), ("h", 300), ("sw", 90), ("sh", 60))]
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot"))

    def build(n):
        return placement.accept_non_overlapping(placement.placement_candidates(slots.repartition(n), 4, 3))

    rows = plan_is_stable(spark, build)
    for a in rows:
        assert 5 <= a["x0"] and a["x1"] <= 405 and 7 <= a["y0"] and a["y1"] <= 307
        for b in rows:
            if a["image_id"] == b["image_id"] and a["slot"] != b["slot"]:
                assert not (a["x0"] < b["x1"] and a["x1"] > b["x0"] and a["y0"] < b["y1"] and a["y1"] > b["y0"])
    assert len({(r["image_id"], r["slot"]) for r in rows}) == len(rows)


def test_quotas():
    assert sampling.quotas(20, ["scratch"]) == [("condensation", 6), ("dirt", 6)]
    assert sampling.quotas(10, of_total=True) == [("condensation", 3), ("dirt", 3), ("scratch", 3)]


def stop_by_walk(values, patience, delta):
    best, counter = None, 0
    for epoch, v in enumerate(values):
        if best is None or v < best - delta:
            best, counter = v, 0
        else:
            counter += 1
        if counter >= patience:
            return epoch
    return None


@pytest.mark.parametrize("delta", [0.0, 0.5])
def test_early_stop(spark, delta):
    runs = {
        1: [5, 4, 3, 2, 1], 2: [1, 2, 3, 4, 5], 3: [5, 4.9, 4.8, 4.7, 4.4, 4.3, 4.2], 4: [3], 5: [5, 6, 4, 6, 6, 3, 7, 7, 7, 2],
    }
    df = spark.createDataFrame([(k, e, float(v)) for k, vs in runs.items() for e, v in enumerate(vs)], "run_id long, epoch long, value double")
    got = {r["run_id"]: r["stop_epoch"] for r in history.early_stop_epoch(df, 3, delta).collect()}
    want = {k: stop_by_walk(vs, 3, delta) for k, vs in runs.items()}
    assert got == {k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize("delta, patience", [(0.0, 3), (0.7, 3), (2.0, 6), (1.0, 1), (0.5, 40), (0.5, 0)])
def test_early_stop_links_over_pieces(spark, monkeypatch, delta, patience):
    monkeypatch.setattr(history, "EPOCHS_PER_PIECE", 4)
    draw = random.Random(7)
    runs = {k: [max(0.0, 60 - e * draw.random()) + draw.choice([0, 0, 1.5, 3]) for e in range(draw.randrange(1, 90))] for k in range(25)}
    runs[99] = [100.0 - e for e in range(80)] + [50.0] * 10
    df = spark.createDataFrame([(k, e, float(v)) for k, vs in runs.items() for e, v in enumerate(vs)], "run_id long, epoch long, value double")
    got = {r["run_id"]: r["stop_epoch"] for r in history.early_stop_epoch(df.repartition(5), patience, delta).collect()}
    want = {k: stop_by_walk(vs, patience, delta) for k, vs in runs.items()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_early_stop_of_a_million_epochs(spark):
    """One falling run: every third epoch is accepted, until it rises."""
    run = spark.range(1_000_000).select(F.lit(1).alias("run_id"), F.col("id").alias("epoch"), F.when(F.col("id") < 900_000, -F.col("id")).otherwise(0).cast("double").alias("value"))
    assert [tuple(r) for r in history.early_stop_epoch(run, 5, 2.5).collect()] == [(1, 899_997 + 5)]


def test_class_warnings():
    assert scoring.class_warnings(4, ["a", "b", "c", "d"]) == []
    assert len(scoring.class_warnings(2, ["a"])) == 2


def test_short_rows_that_grow_are_dealt_to_many_tasks(spark, tmp_path):
    """One file is one task to the reader, and each of its rows becomes dozens."""
    n = F.col("id")
    part = spark.range(20_000).select(n.alias("p_partkey"), (n % 50).cast("int").alias("p_size"))
    vectors = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i * n % 97).cast("float"))
    embeddings = spark.range(10_000).select(n.alias("vec_id"), vectors.alias("embedding"), (n % 10).cast("int").alias("label"))
    supplier = spark.range(2_000).select(n.alias("s_suppkey"))
    for name, rows in (("part", part), ("embeddings", embeddings), ("supplier", supplier)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    made = {
        "placement_candidates": lambda: files_plans.placement_candidates(spark, str(tmp_path)),
        "jitter_polygon": lambda: files_plans.jitter_polygon(spark, str(tmp_path)),
        "gray": lambda: derived.gray(spark, str(tmp_path)),
        "logits": lambda: derived.logits(spark, str(tmp_path)),
        "class_runs": lambda: derived.class_runs(spark, str(tmp_path)),
    }
    for name, make in made.items():
        counts = [r["count"] for r in make().groupBy(F.spark_partition_id()).count().collect()]
        assert max(counts) < 0.8 * sum(counts), name


def test_draws_of_a_plan_are_made_once(spark):
    """A filter on the size of an array of draws draws them all once more."""
    shapes = spark.createDataFrame([(1, 100, 200)], "image_id long, w long, h long")
    slots = shapes.selectExpr("*", "1 as slot", "0L as x", "0L as y", "10L as sw", "20L as sh")
    found = placement.placement_candidates(slots, 3, 21)
    for df in (found, placement.jitter_polygon(shapes, 3, 0.1, 31), placement.accept_non_overlapping(found)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter (size(" not in plan and "(size(" not in plan


def test_boxes_are_numbered_in_tasks_by_rows(spark, monkeypatch):
    plain = derived.boxes(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr("panescan.session.CELLS_PER_TASK", 300)
    dealt = derived.boxes(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert dealt.rdd.getNumPartitions() == -(-2 * lines // 300)
    assert sorted(dealt.collect()) == sorted(plain.collect())
