import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import dense, flood, pixel_rows
from panescan.operators import focal, geometry, gray, masks, metrics, raster, regions, summary, tiles

RNG = np.random.default_rng(7)


def masks_of_every_kind():
    h, w = 21, 17
    diagonal = np.eye(h, w, dtype=int)
    spot = np.zeros((h, w), int)
    spot[20, 16] = 3
    return {
        (1, "pred"): np.zeros((h, w), int),
        (2, "pred"): np.ones((h, w), int) * 2,
        (3, "pred"): spot,
        (4, "pred"): diagonal,
        (5, "pred"): RNG.integers(0, 4, (h, w)),
        (6, "pred"): np.repeat(np.repeat(RNG.integers(0, 4, (7, 6)), 3, 0), 3, 1)[:, :w],
    }


def test_three_forms_agree(spark):
    given = masks_of_every_kind()
    px = pixel_rows(spark, given)
    by_runs = raster.pixels_to_runs(px)
    for size in (4, 5, 32):
        tiles = raster.pixels_to_tiles(px, size)
        assert sorted(raster.tiles_to_pixels(tiles).collect()) == sorted(px.collect())
        assert sorted(raster.tiles_to_runs(tiles).collect()) == sorted(by_runs.collect())
    back = raster.runs_to_pixels(by_runs).select(*px.columns)
    assert sorted(back.collect()) == sorted(px.collect())


def test_class_stats_add_up(spark):
    given = masks_of_every_kind()
    runs = raster.pixels_to_runs(pixel_rows(spark, given))
    for with_background in (True, False):
        rows = summary.class_stats(runs if with_background else runs.where("class_id > 0 or image_id = 1"), 21 * 17).collect()
        for (i, _), a in given.items():
            got = {r["class_id"]: r["pixels"] for r in rows if r["image_id"] == i}
            assert got == {c: int((a == c).sum()) for c in range(4)}


@pytest.mark.parametrize("connectivity,block", [(4, 3), (8, 4), (4, 64)])
def test_regions_equal_flood_fill(spark, connectivity, block):
    given = masks_of_every_kind()
    spiral = np.zeros((21, 17), int)  # one long winding region over many blocks
    spiral[::2, :] = 1
    spiral[1::4, -1] = 1
    spiral[3::4, 0] = 1
    given[(7, "pred")] = spiral
    found = regions.connected_regions(raster.pixels_to_runs(pixel_rows(spark, given)), connectivity, 0, block).collect()
    for (i, _), a in given.items():
        want = flood(a, connectivity)
        got = {(r["class_id"], r["region"]): r for r in found if r["image_id"] == i}
        assert got.keys() == want.keys()
        for key, cells in want.items():
            r, ys, xs = got[key], [c[0] for c in cells], [c[1] for c in cells]
            assert (r["area"], r["min_y"], r["min_x"], r["max_y"], r["max_x"]) == (len(cells), min(ys), min(xs), max(ys), max(xs))
            assert r["cy"] == pytest.approx(np.mean(ys)) and r["cx"] == pytest.approx(np.mean(xs))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tasks_at_block_borders_follow_the_rows(spark, monkeypatch, connectivity):
    runs = raster.pixels_to_runs(pixel_rows(spark, {(1, "a"): np.random.default_rng(5).integers(0, 3, (30, 30))}))
    plain = sorted(regions.connected_regions(runs, connectivity, 0, 5).collect())
    plans, contract = [], regions.contract
    monkeypatch.setattr(regions, "contract", lambda edges, keys: plans.append(edges._jdf.queryExecution().toString()) or contract(edges, keys))
    monkeypatch.setattr("panescan.session.CELLS_PER_TASK", 40)
    assert sorted(regions.connected_regions(runs, connectivity, 0, 5).collect()) == plain
    assert "REPARTITION_BY_NUM" in plans[0]


def test_regions_do_not_depend_on_partitions(spark):
    runs = raster.pixels_to_runs(pixel_rows(spark, masks_of_every_kind()))
    results = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(regions.connected_regions(runs, 4, 0, 5).collect()))
    assert results[0] == results[1]


def greedy(pairs, threshold):
    used_p, used_t, out = set(), set(), []
    for iou, p, t in sorted(((i, p, t) for p, t, i in pairs if i >= threshold), key=lambda q: (-q[0], q[1], q[2])):
        if p not in used_p and t not in used_t:
            used_p.add(p), used_t.add(t), out.append((p, t))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_greedy_match(spark, threshold):
    chain = [(k // 2 + k % 2, k // 2, 0.11 + 0.001 * k) for k in range(10)]  # every pair blocks the next
    wild = [(int(p), int(t), round(float(v), 2)) for p, t, v in zip(RNG.integers(0, 15, 120), RNG.integers(0, 15, 120), RNG.random(120))]
    wild = list({(p, t): (p, t, v) for p, t, v in wild}.values())
    for pairs in (chain, wild if threshold < 0.5 else [(1, 1, 0.5), (2, 2, 0.9)]):
        df = spark.createDataFrame([(1, 1, p, t, v) for p, t, v in pairs], "image_id long, class_id int, p long, t long, iou double")
        got = sorted((r["p"], r["t"]) for r in regions.greedy_match(df, threshold).collect())
        assert got == greedy(pairs, threshold)


def test_overlay_metrics_equal_dense(spark):
    given = masks_of_every_kind()
    truth = {(i, "truth"): RNG.permutation(a.ravel()).reshape(a.shape) for (i, _), a in given.items()}
    runs = raster.pixels_to_runs(pixel_rows(spark, {**given, **truth}))
    rows = metrics.full_metrics(metrics.confusion_counts(raster.overlay(runs, "pred", "truth")), 4).collect()
    flipped = metrics.full_metrics(metrics.confusion_counts(raster.overlay(runs, "truth", "pred")), 4).collect()
    assert {(r["image_id"], r["class_id"], r["iou"]) for r in rows} == {(r["image_id"], r["class_id"], r["iou"]) for r in flipped}
    for r in rows:
        p, t = given[(r["image_id"], "pred")] == r["class_id"], truth[(r["image_id"], "truth")] == r["class_id"]
        assert (r["inter"], r["pred_n"], r["true_n"]) == ((p & t).sum(), p.sum(), t.sum())
        if (p | t).any():
            assert r["iou"] == pytest.approx((p & t).sum() / (p | t).sum())
            assert r["dice"] == pytest.approx(2 * r["iou"] / (1 + r["iou"]))
        else:
            assert r["iou"] == r["dice"] == 1


def test_absent_sides(spark):
    """Absent on both sides: 1 or no row or 0 by rule; on one side: 0."""
    a, b = np.zeros((6, 6), int), np.zeros((6, 6), int)
    a[0, 0] = 1
    runs = raster.pixels_to_runs(pixel_rows(spark, {(1, "pred"): a, (1, "truth"): b}))
    counts = metrics.confusion_counts(raster.overlay(runs, "pred", "truth"))
    simple = {r["class_id"]: r for r in metrics.iou_dice(counts, 4).collect()}
    assert (simple[1]["iou"], simple[2]["iou"], simple[2]["dice"]) == (0.0, 1.0, 0.0)
    grown = {r["class_id"]: r for r in metrics.dilated_metrics(metrics.dilated_sums(runs, "pred", "truth", 3, 6, 6)).collect()}
    assert grown.keys() == {0, 1} and grown[1]["iou"] == 0


def test_dilation_equals_dense(spark):
    a = (RNG.random((15, 22)) < 0.05).astype(int)
    runs = raster.pixels_to_runs(pixel_rows(spark, {(1, "m"): a})).where("class_id > 0")
    row = ("image_id", "y")
    grown = raster.sweep(raster.run_events(metrics.dilate_runs(runs, 3, 15, 22), row, n=F.lit(1).cast("bigint")), row, ["n"]).where("n > 0")
    got = dense(grown.select("y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(1).alias("value")), a.shape)
    want = np.zeros_like(a)
    half = [0, 2, 3, 3, 3, 2, 0]
    for y, x in zip(*np.nonzero(a)):
        for dy, hw in zip(range(-3, 4), half):
            if 0 <= y + dy < 15:
                want[y + dy, max(0, x - hw) : x + hw + 1] = 1
    assert (got == want).all()


def test_mask_algebra(spark):
    a, b = RNG.integers(0, 4, (9, 14)), RNG.integers(0, 2, (9, 14))
    ra, rb = (raster.pixels_to_runs(pixel_rows(spark, {(1, "m"): m})).where("class_id > 0").drop("layer") for m in (a, b))

    def shown(runs):
        return dense(raster.runs_to_pixels(runs, ("image_id",)), a.shape)

    assert (shown(masks.intersect_runs(ra, rb)) == np.where(b > 0, a, 0)).all()
    assert (shown(masks.except_runs(ra, rb)) == np.where(b > 0, 0, a)).all()
    assert (shown(masks.binary_union(ra.unionByName(rb))) == ((a > 0) | (b > 0))).all()
    assert (shown(masks.merge_masks(ra.unionByName(rb))) == np.maximum(a, b)).all()


FILTERS = [("min", 3, "rect"), ("max", 5, "disc"), ("mean", 3, "rect"), ("median", 5, "rect"), ("median", 13, "rect"), ("rank", 3, "rect"), ("binomial", 5, "rect")]


@pytest.mark.parametrize("stat,size,shape", FILTERS)
def test_focal_over_tile_borders(spark, stat, size, shape):
    a = RNG.integers(0, 256, (19, 23))
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(1, "g"): a}), 4)
    border = "reflect" if stat == "binomial" else "edge"
    got = dense(raster.tiles_to_pixels(focal.focal(tiles, 4, a.shape, stat, size, shape, 0.8, border)), a.shape)
    r = size // 2
    padded = np.pad(a, r, mode=border)
    window = focal.footprint(size, shape)
    weights = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            part = padded[y : y + size, x : x + size]
            v = np.sort(part[window])
            want = {
                "min": v[0], "max": v[-1], "mean": int(np.floor(v.mean() + 0.5)), "median": v[len(v) // 2],
                "rank": v[min(len(v) - 1, int(len(v) * 0.8))], "binomial": (int((part * weights).sum()) + 128) // 256 if size == 5 else 0,
            }[stat]
            assert got[y, x] == want, (y, x)


@pytest.mark.parametrize("stat,size", [("max", 3), ("median", 5)])
def test_focal_of_images_of_different_sizes(spark, stat, size):
    arrays = {1: RNG.integers(0, 256, (8, 8)), 2: RNG.integers(0, 256, (12, 13)), 3: RNG.integers(0, 256, (6, 5))}
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(i, "g"): a for i, a in arrays.items()}), 4)
    frames = spark.createDataFrame([(i, *a.shape) for i, a in arrays.items()], "image_id long, height int, width int")
    out = raster.tiles_to_pixels(focal.focal(tiles, 4, frames, stat, size)).cache()
    for i, a in arrays.items():
        one, padded, r = out.where(F.col("image_id") == i), np.pad(a, size // 2, mode="edge"), size
        assert one.count() == a.size
        part = lambda y, x: np.sort(padded[y : y + r, x : x + r].ravel())  # noqa: B023, E731
        want = [[part(y, x)[-1 if stat == "max" else r * r // 2] for x in range(a.shape[1])] for y in range(a.shape[0])]
        assert (dense(one, a.shape) == np.array(want)).all()
    with pytest.raises(Exception, match="outside the frame"):
        focal.focal(tiles, 4, (8, 8), stat, size).count()


def test_resize_paste_dilation_and_audit_of_images_of_different_sizes(spark):
    arrays = {1: RNG.integers(0, 3, (8, 8)), 2: RNG.integers(0, 3, (12, 13)), 3: RNG.integers(0, 3, (6, 5))}
    px = pixel_rows(spark, {(i, "g"): a for i, a in arrays.items()})
    sizes = spark.createDataFrame([(i, *a.shape) for i, a in arrays.items()], "image_id long, h int, w int")
    sized, h, w = px.join(sizes, "image_id").cache(), F.col("h"), F.col("w")
    resized = gray.resize_nearest(sized, (h, w), (2 * h - 3, 7)).cache()
    pasted = gray.paste(sized, w - 4, -1, h, w, (h, w), (h + 2, w)).cache()
    runs = raster.pixels_to_runs(px).where("class_id = 1").join(sizes, "image_id")
    row = ("image_id", "y")
    events = raster.run_events(metrics.dilate_runs(runs, 3, h, w), row, n=F.lit(1).cast("bigint"))
    grown = raster.sweep(events, row, ["n"]).where("n > 0").select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(1).alias("value")).cache()
    for i, a in arrays.items():
        of = lambda d: d.where(F.col("image_id") == i)  # noqa: B023, E731
        (n, m), th = a.shape, 2 * a.shape[0] - 3
        want = a[np.arange(th) * n // th][:, np.arange(7) * m // 7]
        assert of(resized).count() == want.size and (dense(of(resized), want.shape) == want).all()
        want = np.zeros_like(a)
        larger = a[np.arange(n + 2) * n // (n + 2)] > 0
        want[:, m - 4 :] = larger[1 : n + 1, :4]
        assert (dense(of(pasted), a.shape) == want).all()
        want = np.zeros_like(a)
        for y, x in zip(*np.nonzero(a == 1)):
            for dy, hw in zip(range(-3, 4), [0, 2, 3, 3, 3, 2, 0]):
                if 0 <= y + dy < n:
                    want[y + dy, max(0, x - hw) : x + hw + 1] = 1
        assert (dense(of(grown), a.shape) == want).all()
    audited = masks.mask_audit(sized, [0, 1, 2], size=(h, w + F.when(F.col("image_id") == 3, 1).otherwise(0)))
    assert {r["image_id"]: r["ok"] for r in audited.collect()} == {1: True, 2: True, 3: False}


def test_otsu_of_a_gigapixel_histogram(spark):
    hist = spark.createDataFrame([(1, 10, 3 * 10**9), (1, 20, 10**9), (1, 240, 4 * 10**9)], "image_id long, value int, n long")
    assert [r["threshold"] for r in gray.otsu_threshold(hist).collect()] == [20]


def test_class_stats_of_a_mask_without_runs(spark):
    runs = spark.createDataFrame([(1, "pred", 2, 0, 0, 4)], "image_id long, layer string, class_id int, y int, x0 int, x1 int")
    listed = spark.createDataFrame([(1, "pred"), (2, "pred")], "image_id long, layer string")
    rows = {(r["image_id"], r["class_id"]): r["pixels"] for r in summary.class_stats(runs, 20, masks=listed).collect()}
    assert rows == {(1, 0): 15, (1, 1): 0, (1, 2): 5, (1, 3): 0, (2, 0): 20, (2, 1): 0, (2, 2): 0, (2, 3): 0}


def test_set_algebra_of_overlapping_layers(spark):
    schema = "image_id long, layer string, class_id int, y int, x0 int, x1 int"
    runs = spark.createDataFrame([(1, "a", 1, 0, 0, 9), (1, "b", 2, 0, 5, 14), (1, "c", 1, 0, 0, 3)], schema)
    other = spark.createDataFrame([(1, "o", 3, 0, 4, 7), (1, "p", 3, 0, 6, 7)], schema)
    shown = lambda d: sorted((r["class_id"], r["x0"], r["x1"]) for r in d.collect())
    assert shown(masks.intersect_runs(runs, other)) == [(1, 4, 7), (2, 5, 7)]
    assert shown(masks.except_runs(runs, other)) == [(1, 0, 3), (1, 8, 9), (2, 8, 14)]


PAIR = "image_id long, class_id int, p long, t long, iou double"


def test_long_chain_of_falling_overlaps_is_matched(spark):
    """5,000 links, each blocking the next, in one pass: the jobs are those of cutting components."""
    chain = [(1, 1, i, i + d, 0.49 - 0.0001 * (2 * i + d) / 2) for i in range(2500) for d in (0, 1)]
    context = spark.sparkContext
    context.setJobGroup("chain", "greedy match of a long chain")
    got = regions.greedy_match(spark.createDataFrame(chain, PAIR), 0.1).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("chain"))
    context.setJobGroup("", "")
    assert sorted((r["p"], r["t"]) for r in got) == [(i, i) for i in range(2500) if 0.49 - 0.0001 * i >= 0.1]
    assert jobs < 300


@pytest.mark.parametrize("limit", [1, 6, 1000])
def test_greedy_match_of_small_and_large_components(spark, limit):
    """Several images and classes at once, ties of IoU, components above and below the limit."""
    draw = np.random.default_rng(8)
    made = {(int(i), int(c), int(p), int(t)): round(float(v), 1) for i, c, p, t, v in zip(draw.integers(0, 3, 90), draw.integers(1, 3, 90), draw.integers(0, 12, 90), draw.integers(0, 12, 90), draw.random(90))}
    frame = spark.createDataFrame([(*key, iou) for key, iou in made.items()], PAIR)
    got = regions.greedy_match(frame, 0.1, limit=limit)
    assert got.columns == ["image_id", "class_id", "p", "t", "iou"]
    found = {}
    for r in got.collect():
        found.setdefault((r["image_id"], r["class_id"]), []).append((r["p"], r["t"]))
        assert made[r["image_id"], r["class_id"], r["p"], r["t"]] == r["iou"]
    for group in {k[:2] for k in made}:
        assert sorted(found.get(group, [])) == greedy([(*k[2:], v) for k, v in made.items() if k[:2] == group], 0.1)
    assert regions.greedy_match(frame.where("false"), 0.1).count() == 0


def test_defect_extraction_finds_a_spot(spark):
    # grain keeps the Otsu level above 10; on a perfectly flat photo t-10 is negative and marks all
    a = 200 - np.random.default_rng(5).integers(0, 25, (24, 24))
    a[10:14, 9:15] = 60
    tiles = raster.pixels_to_tiles(pixel_rows(spark, {(1, "g"): a}), 8)
    out = focal.extract_defect_masks(tiles, 8, a.shape, background=15)
    high, low = dense(out, a.shape, "high"), dense(out, a.shape, "low")
    assert high[11:13, 10:14].all() and high.sum() <= 24
    assert (low >= high).all() and low.sum() < a.size / 2
    labels = dense(focal.extract_defect_masks(tiles, 8, a.shape, background=15, label_variant=True), a.shape, "high")
    assert labels[11:13, 10:14].all()


def inside_even_odd(poly, y, x):
    hit = False
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def test_polygon_fill(spark):
    shapes = {
        1: [(2, 1), (12, 1), (12, 9), (2, 9)],
        2: [(0, 0), (10, 5), (0, 10), (4, 5)],  # concave
        3: [(5, 5), (5, 5), (5, 5)],  # a point
        4: [(0, 0), (9, 9)],  # too few points
        5: [(0, 0), (9, 3), (18, 0)],
    }
    rows = [(k, [{"x": x, "y": y} for x, y in p]) for k, p in shapes.items()]
    df = spark.createDataFrame(rows, "k long, points array<struct<x:int,y:int>>")
    runs = geometry.polygon_to_runs(df, ["k"]).collect()
    for k, poly in shapes.items():
        cells = {(r["y"], x) for r in runs if r["k"] == k for x in range(r["x0"], r["x1"] + 1)}
        if len(poly) < 3:
            assert not cells
            continue
        assert all((y, x) in cells for x, y in poly)  # corners belong to the outline
        for y in range(-1, 12):
            for x in range(-1, 20):
                if inside_even_odd(poly, y, x):
                    assert (y, x) in cells, (k, y, x)
        near = {(y, x) for y, x in cells if not inside_even_odd(poly, y, x)}
        edges = list(zip(poly, poly[1:] + poly[:1]))
        for y, x in near:  # everything else lies within a pixel of an edge
            gaps = []
            for (ax, ay), (bx, by) in edges:
                d = np.array([bx - ax, by - ay], float)
                t = 0 if not d.any() else np.clip(np.dot([x - ax, y - ay], d) / d.dot(d), 0, 1)
                gaps.append(np.hypot(*(np.array([ax, ay]) + t * d - [x, y])))
            assert min(gaps) <= 1.0
    area = {r["k"]: 0 for r in runs}
    for r in runs:
        area[r["k"]] += r["x1"] - r["x0"] + 1
    assert area[1] == 11 * 9 and area[3] == 1


def test_exact_median(spark):
    rows = [(k, float(v)) for k, vs in {1: RNG.random(501), 2: RNG.integers(0, 3, 400), 3: [5.0], 4: [1, 2], 5: np.r_[np.zeros(300), RNG.random(10)]}.items() for v in vs]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r["median"] for r in summary.exact_median(df, ["k"], "v", 16).collect()}
    for k in got:
        assert got[k] == pytest.approx(np.median([v for q, v in rows if q == k]))


def test_order_image_is_that_of_doubles(spark):
    edges = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 0.1, 1 / 3, 1e16]
    powers = [2.0**e for e in range(-1074, 1024, 7)]
    near = [float(np.nextafter(v, side)) for v in powers for side in (0, np.inf)]
    bits = np.random.default_rng(9).integers(0, 2047 << 52, 2000).view(np.float64).tolist()
    values = [s * v for v in edges + powers + near + bits for s in (1.0, -1.0)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", summary.order_image(F.col("v")).alias("image")).collect()
    found = sorted((r["image"], r["v"]) for r in rows)
    assert [v for _, v in found] == sorted(values)
    assert len({i for i, _ in found}) == len(set(values))
    # neighbouring doubles are neighbouring images
    assert all(abs(r["image"]) == int(np.abs(np.float64(r["v"])).view(np.int64)) for r in rows)
    assert spark.range(1).select(summary.order_image(F.lit(float("nan")))).first()[0] == (1 << 63) - 1


@pytest.mark.parametrize("bits", [7, 16, 32])
def test_exact_median_of_skewed_series(spark, bits):
    """One far value, values in the last bits of one number, signs, ends of the scale, ranks that part early."""
    draw = np.random.default_rng(10)
    series = {
        1: np.r_[1e300, 1 + draw.integers(0, 200, 301) * 2.0**-52],
        2: -np.r_[1e-310, 1e-310 * draw.integers(1, 9, 40), 1.0],
        3: np.array([-1e308, 1e-300]),
        4: np.r_[np.repeat(-7.5, 300), draw.normal(size=300)],
        5: np.array([0.0, -0.0, 3.0, float("inf")]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in series.items() for v in vs] + [(1, None), (6, None)], "k int, v double")
    got = {r["k"]: r["median"] for r in summary.exact_median(df, ["k"], "v", bits).collect()}
    assert got == {k: float(np.median(v)) for k, v in series.items()}


def test_a_line_brighter_by_the_delta_to_the_dot_is_no_hit(spark):
    rows = [320, 130, 60]  # sums of three pixels; 320 / 3 is 50 above the mean
    image = np.array([[s // 3, s // 3, s - 2 * (s // 3)] for s in rows], int)
    pixels = pixel_rows(spark, {(i, "g"): image + (np.arange(len(rows)) == 0)[:, None] * i for i in (0, 1)})
    rects = spark.createDataFrame([(i, 0, 0, 0, 3, len(rows)) for i in (0, 1)], "image_id long, rect_id int, x int, y int, w int, h int")
    for found in (gray.bright_line_flag(pixels, rects), tiles.bright_line_flag(raster.pixels_to_tiles(pixels, 2), rects)):
        assert {r["image_id"]: r["power_on"] for r in found.collect()} == {0: False, 1: True}
