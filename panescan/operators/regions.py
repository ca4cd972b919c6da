"""Connected regions of class masks, object matching and region summaries.

Runs are cut at block borders and every block is labelled on its own, many blocks per
Arrow batch.  Only pieces that touch a neighbouring block enter a distributed
contraction: each piece points at its smallest neighbour, edges are rewritten to the
pointed-at pieces and the loop ends when no edge is left.  A region is named by its first
pixel in raster order, so names do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators.metrics import ratio
from panescan.operators.raster import length, run_events, sweep
from panescan.operators.summary import exact_median
from panescan.session import cut_lineage, deal, tasks_for

# a pixel position as one number: row * X_SPAN + column
X_SPAN = 1 << 24
LAYER_KEY = ("image_id", "layer", "class_id")
BLOCK_KEY = ("image_id", "by", "bx")
ROWS_PER_CHUNK = 1 << 16
BORDER_CELLS = 4  # what a run at a border is worth: two events, or three rows of a join

LABELLED = "image_id long, layer string, class_id int, y int, x0 int, x1 int, by int, bx int, piece long"


def cut_into_blocks(runs: DataFrame, block: int) -> DataFrame:
    """Runs cut at vertical block borders, with block coordinates."""
    first, last = F.floor(F.col("x0") / block).cast("int"), F.floor(F.col("x1") / block).cast("int")
    return (
        runs.select(*LAYER_KEY, "y", "x0", "x1", F.explode(F.sequence(first, last)).alias("bx"))
        .select(
            *LAYER_KEY,
            "y",
            F.greatest("x0", F.col("bx") * block).cast("int").alias("x0"),
            F.least("x1", F.col("bx") * block + block - 1).cast("int").alias("x1"),
            F.floor(F.col("y") / block).cast("int").alias("by"),
            "bx",
        )
    )


def _roots(parent_of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected node per node, edges a-b; hook to the smaller root, then jump."""
    root = parent_of
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        low, high = np.minimum(ra[differ], rb[differ]), np.maximum(ra[differ], rb[differ])
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _label_chunk(chunk: pa.Table, reach: int) -> pa.RecordBatch:
    """Label complete blocks; rows arrive sorted by block, layer, class, row and column."""
    col = {c: np.asarray(chunk[c].to_numpy()) for c in ("image_id", "class_id", "y", "x0", "x1", "by", "bx")}
    layer = chunk["layer"].combine_chunks().dictionary_encode()
    codes = np.asarray(layer.indices)
    n = chunk.num_rows
    same = np.zeros(n, bool)
    same[1:] = codes[1:] == codes[:-1]
    for c in ("image_id", "by", "bx", "class_id"):
        same[1:] &= col[c][1:] == col[c][:-1]
    group = np.cumsum(~same)
    # number line of (group, row): the row above sits exactly one line earlier
    y = col["y"].astype(np.int64)
    line = group * (int(y.max()) - int(y.min()) + 3) + (y - y.min())
    base = int(col["x0"].min())
    span = int(col["x1"].max()) - base + 3
    start, end = line * span + col["x0"] - base, line * span + col["x1"] - base
    # runs of the row above that overlap run i: those with end >= start_i and start <= end_i
    lo = np.searchsorted(end, start - span - reach, side="left")
    hi = np.searchsorted(start, end - span + reach, side="right")
    lo = np.maximum(lo, np.searchsorted(line, line - 1, side="left"))
    hi = np.minimum(hi, np.searchsorted(line, line - 1, side="right"))
    many = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(n), many)
    above = np.repeat(lo, many) + np.arange(len(below)) - np.repeat(np.cumsum(many) - many, many)
    root = _roots(np.arange(n), above, below)
    first = y * X_SPAN + col["x0"]
    return pa.RecordBatch.from_pydict(
        {
            "image_id": pa.array(col["image_id"]),
            "layer": pa.array(np.asarray(layer.dictionary.to_pylist(), object)[codes], pa.string()),
            **{c: pa.array(col[c].astype(np.int32)) for c in ("class_id", "y", "x0", "x1", "by", "bx")},
            "piece": pa.array(first[root]),
        }
    )


def label_blocks(cut: DataFrame, connectivity: int) -> DataFrame:
    """Adds ``piece``: first pixel of the block-local region.  A block bounds the group size."""
    reach = 0 if connectivity == 4 else 1

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS_PER_CHUNK:
                continue
            table = pa.Table.from_batches(held)
            blocks = np.stack([table[c].to_numpy() for c in BLOCK_KEY])
            changes = np.flatnonzero((blocks[:, 1:] != blocks[:, :-1]).any(axis=0))
            if len(changes) == 0:
                continue
            end = int(changes[-1]) + 1
            yield _label_chunk(table.slice(0, end), reach)
            held = table.slice(end).to_batches()
            rows = table.num_rows - end
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield _label_chunk(table, reach)

    order = [*BLOCK_KEY, "layer", "class_id", "y", "x0"]
    return cut.repartition(*BLOCK_KEY).sortWithinPartitions(*order).mapInArrow(label, LABELLED)


def _at_border(block: int) -> list[Column]:
    """Whether a run lies above, below, left and right of a block border."""
    y, x0, x1 = F.col("y"), F.col("x0"), F.col("x1")
    return [y % block == block - 1, (y % block == 0) & (y > 0), (x1 + 1) % block == 0, (x0 % block == 0) & (x0 > 0)]


def _border_edges(labelled: DataFrame, block: int, connectivity: int, tasks: int = 1) -> DataFrame:
    """Pairs of pieces that touch over a block border, from border rows and columns only, found in ``tasks`` tasks."""
    is_upper, is_lower, is_left, is_right = _at_border(block)
    reach = 0 if connectivity == 4 else 1
    key = [*LAYER_KEY, "line"]
    one = F.lit(0).cast("bigint")
    # horizontal borders: the last row of a block against the first row below
    upper = labelled.where(is_upper).withColumn("line", F.col("y"))
    lower = labelled.where(is_lower).withColumn("line", F.col("y") - 1)
    grown = F.col("x1") + reach  # overlap with one spare column on the right equals touching corners
    events = run_events(upper.withColumn("x1", grown), key, a=F.col("piece") + 1, b=one).unionByName(
        run_events(lower.withColumn("x1", grown), key, a=one, b=F.col("piece") + 1)
    )
    across_rows = sweep(deal(events, tasks, *key), key, ("a", "b")).where("a > 0 and b > 0")
    # vertical borders: runs that end at a border column against runs that start behind it
    left = labelled.where(is_left).select(*LAYER_KEY, (F.col("x1") + 1).alias("bar"), "y", (F.col("piece") + 1).alias("a"))
    right = labelled.where(is_right).select(*LAYER_KEY, F.col("x0").alias("bar"), "y", (F.col("piece") + 1).alias("b"))
    shifts = F.array(*[F.lit(d) for d in range(-reach, reach + 1)])
    moved = left.select(*LAYER_KEY, "bar", "a", F.explode(F.transform(shifts, lambda d: F.col("y") + d)).alias("y"))
    cell = [*LAYER_KEY, "bar", "y"]
    across_cols = deal(moved, tasks, *cell).join(deal(right, tasks, *cell), cell)
    pair = [*LAYER_KEY, (F.col("a") - 1).alias("u"), (F.col("b") - 1).alias("v")]
    return across_rows.select(*pair).unionByName(across_cols.select(*pair)).where("u <> v")


def contract(edges: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Map keys, node -> root (smallest node) for all nodes on edges (u, v); None without edges.

    Round: every node points at its neighbour of the lowest hash if that is below its own,
    pointers jump once, edges move to the new nodes.  Hashes differ per round, so chains of
    pointers stay short and the graph shrinks by a constant factor whatever its shape.
    Minima combine map-side; a joined side that may be hot meets one row per node, which
    AQE splits.  Rounds go on until no edge is left; edges and labels are checkpointed in each,
    so a lost executor costs one round and the plan does not grow.
    """
    keys = list(keys)
    edges = cut_lineage(edges.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if edges.isEmpty():
        return None
    labels: DataFrame | None = None
    for turn in count():
        step = cut_lineage(_point_and_jump(edges, keys, turn))
        if labels is None:
            labels = step
        else:
            moved = step.select(*keys, F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut_lineage(labels.join(moved, [*keys, "root"], "left").select(*keys, "node", F.coalesce("next", "root").alias("root")))
        to_u = step.select(*keys, F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = step.select(*keys, F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = cut_lineage(
            edges.join(to_u, [*keys, "u"]).join(to_v, [*keys, "v"]).where("ru <> rv")
            .select(*keys, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        )
        if edges.isEmpty():
            names = labels.groupBy(*keys, "root").agg(F.min("node").alias("first"))
            return labels.join(names, [*keys, "root"]).select(*keys, "node", F.col("first").alias("root"))


def _point_and_jump(edges: DataFrame, keys: list[str], turn: int) -> DataFrame:
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))
    )

    def rank(c):
        return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))

    near = edges.select(*keys, F.inline(ends)).groupBy(*keys, "node").agg(F.min(rank("other")).alias("near"))
    step = near.select(*keys, "node", F.least(F.col("near"), rank("node"))["n"].alias("parent"))
    up = step.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("root"))
    return step.join(up, [*keys, "parent"]).select(*keys, "node", "root")


def label_runs(runs: DataFrame, connectivity: int = 4, block: int = 1024) -> DataFrame:
    """Runs of defect classes with ``region``: the first pixel of the whole region.

    Runs shrink a hundredfold in a shuffle, so the tasks at borders are set by rows: adaptive execution
    would join them by bytes.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    cut = cut_into_blocks(runs.where("class_id > 0"), block)
    labelled = cut_lineage(label_blocks(cut, connectivity))
    at_borders = labelled.where(reduce(Column.__or__, _at_border(block))).count()
    tasks = tasks_for(runs.sparkSession, at_borders * BORDER_CELLS)
    roots = contract(_border_edges(labelled, block, connectivity, tasks), LAYER_KEY)
    if roots is None:
        return labelled.withColumnRenamed("piece", "region")
    return labelled.join(
        roots.withColumnRenamed("node", "piece"), [*LAYER_KEY, "piece"], "left"
    ).withColumn("region", F.coalesce("root", "piece")).drop("root", "piece")


def measure(labelled: DataFrame, min_area: int = 0) -> DataFrame:
    """Area, bounding box and centroid per region; sums only, so hot regions combine map-side."""
    n = length()
    return (
        labelled.groupBy(*LAYER_KEY, "region")
        .agg(
            F.sum(n).alias("area"),
            F.min("y").alias("min_y"),
            F.min("x0").alias("min_x"),
            F.max("y").alias("max_y"),
            F.max("x1").alias("max_x"),
            (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
            (F.sum(n * (F.col("x0") + F.col("x1")) / 2) / F.sum(n)).alias("cx"),
        )
        .where(F.col("area") >= min_area)
    )


def connected_regions(runs: DataFrame, connectivity: int = 4, min_area: int = 0, block: int = 1024) -> DataFrame:
    return measure(label_runs(runs, connectivity, block), min_area)


def region_summary(regions: DataFrame, masks: DataFrame, classes: Sequence[int] = range(1, schema.CLASS_COUNT)) -> DataFrame:
    """Count and area figures per mask and class; classes without regions give zeros.

    ``masks`` holds the (image_id, layer) pairs that exist.
    """
    stats = regions.groupBy(*LAYER_KEY).agg(
        F.count(F.lit(1)).alias("num"),
        F.sum("area").alias("total"),
        F.max("area").alias("largest"),
        F.min("area").alias("smallest"),
        F.avg("area").alias("mean"),
    )
    stats = stats.join(exact_median(regions, LAYER_KEY, "area"), list(LAYER_KEY))
    wanted = masks.select("image_id", "layer", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class_id"))
    return wanted.join(stats, list(LAYER_KEY), "left").na.fill(0, ["num", "total", "largest", "smallest", "mean", "median"])


def largest_region(regions: DataFrame, keys: Sequence[str] = ("image_id", "layer")) -> DataFrame:
    """Region of the largest area, the first in raster order on a tie."""
    best = F.min_by(F.struct("class_id", "region", "area"), F.struct((-F.col("area")).alias("a"), "region", "class_id"))
    return regions.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


# ---------------------------------------------------------------------- object matching
def region_overlaps(labelled: DataFrame, pred: str, truth: str) -> DataFrame:
    """Common pixels of predicted and true regions of one class; only pairs that meet exist."""
    row = ("image_id", "class_id", "y")
    is_pred = F.col("layer") == pred
    events = run_events(
        labelled.where(is_pred | (F.col("layer") == truth)),
        row,
        a=F.when(is_pred, F.col("region") + 1).otherwise(F.lit(0)).cast("bigint"),
        b=F.when(is_pred, F.lit(0)).otherwise(F.col("region") + 1).cast("bigint"),
    )
    return (
        sweep(events, row, ("a", "b"))
        .where("a > 0 and b > 0")
        .groupBy("image_id", "class_id", (F.col("a") - 1).alias("p"), (F.col("b") - 1).alias("t"))
        .agg(F.sum(length()).alias("inter"))
    )


def iou_pairs(labelled: DataFrame, regions: DataFrame, pred: str, truth: str) -> DataFrame:
    """IoU of every predicted and true region (of ``regions``) that share pixels."""
    side = lambda layer, name, area: regions.where(F.col("layer") == layer).select(
        "image_id", "class_id", F.col("region").alias(name), F.col("area").alias(area)
    )
    joined = (
        region_overlaps(labelled, pred, truth)
        .join(side(pred, "p", "p_area"), ["image_id", "class_id", "p"])
        .join(side(truth, "t", "t_area"), ["image_id", "class_id", "t"])
    )
    return joined.withColumn("iou", F.col("inter") / (F.col("p_area") + F.col("t_area") - F.col("inter")))


def _best_for_both(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that are the best of both their ends: what the greedy walk takes whatever else it does."""
    best = F.struct((-F.col("iou")).alias("r"), F.col("p"), F.col("t"))
    for end in ("p", "t"):
        pairs = pairs.withColumn(f"best_{end}", F.min(best).over(Window.partitionBy(*keys, end)))
    return pairs.where((best == F.col("best_p")) & (best == F.col("best_t"))).drop("best_p", "best_t")


def _walk_components(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The greedy walk over each ``root`` of ``pairs``, whole components per task, rows as they stream by."""
    cols = [*keys, "p", "t", "iou"]
    group = [*keys, "root"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used_p, used_t = None, set(), set()
        for batch in batches:
            taken = []
            heads = zip(*(batch.column(c).to_pylist() for c in group))
            for i, (head, p, t) in enumerate(zip(heads, batch.column("p").to_pylist(), batch.column("t").to_pylist())):
                if head != at:
                    at, used_p, used_t = head, set(), set()
                if p not in used_p and t not in used_t:
                    used_p.add(p)
                    used_t.add(t)
                    taken.append(i)
            yield batch.select(cols).take(pa.array(taken, pa.int64()))

    ordered = pairs.repartition(*group).sortWithinPartitions(*group, F.desc("iou"), "p", "t")
    return ordered.mapInArrow(walk, pairs.select(*cols).schema)


def greedy_match(
    pairs: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("image_id", "class_id"), limit: int = 1 << 20
) -> DataFrame:
    """One-to-one pairs by falling IoU, ties by (p, t).

    From .5 upwards regions that are disjoint on each side leave no second choice but ties, so the pairs
    that are best for both ends settle it; overlapping regions of one side must not be matched so.

    Below, pairs that share no region with others don't bear on each other: the graph of pairs is cut into
    connected components, and each of at most ``limit`` pairs is walked in one sorted pass, a chain of any
    length too. Of a larger one the pairs that are best for both ends are taken and all pairs of their
    regions dropped, until what is left falls into components within the limit.
    """
    keys = list(keys)
    cols = [*keys, "p", "t", "iou"]
    left = pairs.where(F.col("iou") >= threshold).select(*cols)
    if threshold >= 0.5:
        return _best_for_both(left, keys)
    left = cut_lineage(left)
    taken: list[DataFrame] = []
    while True:
        # regions of the two sides as nodes of one graph: even and odd
        ends = left.withColumn("u", F.col("p") * 2).withColumn("v", F.col("t") * 2 + 1)
        roots = contract(ends.select(*keys, "u", "v"), keys)
        if roots is None:
            break
        placed = ends.join(roots.withColumnRenamed("node", "u"), [*keys, "u"]).select(*cols, "root")
        sizes = placed.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("size"))
        large = cut_lineage(sizes.where(F.col("size") > limit).drop("size"))
        if large.isEmpty():
            taken.append(_walk_components(placed, keys))
            break
        taken.append(_walk_components(placed.join(large, [*keys, "root"], "left_anti"), keys))
        hard = cut_lineage(placed.join(large, [*keys, "root"]).select(*cols))
        sure = cut_lineage(_best_for_both(hard, keys))
        taken.append(sure)
        for end in ("p", "t"):
            hard = hard.join(sure.select(*keys, end), [*keys, end], "left_anti")
        left = cut_lineage(hard.select(*cols))
    return reduce(DataFrame.unionByName, taken) if taken else left


def object_metrics(regions: DataFrame, matches: DataFrame, pred: str, truth: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and mean matched IoU per (image, class) with any object."""
    key = ["image_id", "class_id"]
    counts = regions.groupBy(*key).agg(
        F.count_if(F.col("layer") == pred).alias("detected_objects"),
        F.count_if(F.col("layer") == truth).alias("ground_truth_objects"),
    )
    hit = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("avg_matched_iou"))
    tp = F.col("tp")
    return (
        counts.join(hit, key, "left")
        .na.fill(0, ["tp", "avg_matched_iou"])
        .withColumn("fp", F.col("detected_objects") - tp)
        .withColumn("fn", F.col("ground_truth_objects") - tp)
        .withColumn("precision", ratio(tp, tp + F.col("fp")))
        .withColumn("recall", ratio(tp, tp + F.col("fn")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


# -------------------------------------------------------------------- device candidates
def device_box(regions: DataFrame, images: DataFrame, scale: float, margins: dict | None = None) -> DataFrame:
    """Bounding box of the largest region scaled back to the photo, else the margin box.

    ``images``: image_id, frame_w, frame_h of the photo.
    """
    from panescan.operators.geometry import MARGINS, int_of, margin_box

    best = F.min_by(F.struct("min_x", "min_y", "max_x", "max_y"), F.struct((-F.col("area")).alias("a"), "region"))
    top = regions.groupBy("image_id").agg(best.alias("b"))
    fallback = margin_box(F.col("frame_w"), F.col("frame_h"), margins or MARGINS)
    found = {
        "x": F.col("b.min_x"), "y": F.col("b.min_y"),
        "w": F.col("b.max_x") - F.col("b.min_x") + 1, "h": F.col("b.max_y") - F.col("b.min_y") + 1,
    }
    return images.join(top, "image_id", "left").select(
        "image_id", *[F.coalesce(int_of(v / F.lit(scale)), fallback[c]).alias(c) for c, v in found.items()]
    )


def bright_region_box(regions: DataFrame, images: DataFrame, share: float = 0.2, pad: int = 10) -> DataFrame:
    """Padded box of the largest bright region if it covers ``share`` of the frame; no row otherwise."""
    best = F.min_by(F.struct("min_x", "min_y", "max_x", "max_y", "area"), F.struct((-F.col("area")).alias("a"), "region"))
    top = regions.groupBy("image_id").agg(best.alias("b")).join(images, "image_id")
    x, y = F.greatest(F.lit(0), F.col("b.min_x") - pad), F.greatest(F.lit(0), F.col("b.min_y") - pad)
    w, h = F.col("b.max_x") - F.col("b.min_x") + 1, F.col("b.max_y") - F.col("b.min_y") + 1
    return top.where(F.col("b.area") >= F.col("frame_w") * F.col("frame_h") * share).select(
        "image_id",
        x.cast("bigint").alias("x"),
        y.cast("bigint").alias("y"),
        F.least(F.col("frame_w") - x, w + 2 * pad).cast("bigint").alias("w"),
        F.least(F.col("frame_h") - y, h + 2 * pad).cast("bigint").alias("h"),
    )


def bright_threshold(max_level: Column) -> Column:
    """70 % of the brightest level, at least 128."""
    return F.greatest(max_level * 0.7, F.lit(128.0))
