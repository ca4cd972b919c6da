"""Plans for synthetic data: quotas, placement candidates, acceptance, outlines, crops.

A plan is rows only, reproducible from its seed, so it can be inspected before it is
applied.  Candidates of one image live in one array whose length is quota times attempts,
both plan parameters; acceptance therefore needs no shuffle and no unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan.functions.hashing import uniform, uniform_int
from panescan.operators.geometry import turned_size


def random_crops(rects: DataFrame, n: int, ratio: float, seed: int) -> DataFrame:
    """``n`` square crops per rectangle, offset by up to a quarter of each side."""
    i = F.col("i")
    slots = rects.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    zero = F.lit(0)
    return slots.withColumns(
        {
            "x0": F.col("x") + uniform_int(zero, F.floor(F.col("w") / 4), seed, F.lit("x"), F.col("image_id"), i),
            "y0": F.col("y") + uniform_int(zero, F.floor(F.col("h") / 4), seed, F.lit("y"), F.col("image_id"), i),
            "size": (F.col("w") * ratio).cast("bigint"),
        }
    )


# --- fixed values: scale and turn of a placed sample -------------------------------------
SCALE_RANGE, ANGLE_RANGE = (0.9, 1.15), (0.0, 360.0)


def placement_candidates(slots: DataFrame, attempts: int, seed: int) -> DataFrame:
    """Turned and scaled sample boxes at random legal places, ``attempts`` per slot.

    ``slots``: image_id, slot, frame x, y, w, h and sample size sw, sh.  A sample that does
    not fit gives no row for that attempt.
    """

    def draws(attempt):
        key = [F.col("image_id"), F.col("slot"), attempt]
        between = lambda name, ends: ends[0] + uniform(seed, F.lit(name), *key) * (ends[1] - ends[0])
        return F.struct(
            attempt.alias("attempt"), between("scale", SCALE_RANGE).alias("scale"), between("angle", ANGLE_RANGE).alias("angle"),
            uniform(seed, F.lit("x"), *key).alias("ux"), uniform(seed, F.lit("y"), *key).alias("uy"),
        )

    # each inline fixes its columns, so no draw is computed again in later expressions; the outer form, as the
    # plain one infers a filter on the array's size, which draws everything once more next to the scan
    tries = slots.select("*", F.inline_outer(F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), draws)))
    sized = tries.select("*", F.inline(F.array(turned_size(F.col("sw"), F.col("sh"), F.col("angle"), F.col("scale")).alias("t"))).alias("dw", "dh", "tw", "th"))
    fits = (F.col("tw") <= F.col("w")) & (F.col("th") <= F.col("h")) & (F.col("dw") > 0) & (F.col("dh") > 0)
    spot = F.struct(
        (F.col("x") + F.floor(F.col("ux") * (F.col("w") - F.col("tw") + 1))).cast("bigint").alias("x0"),
        (F.col("y") + F.floor(F.col("uy") * (F.col("h") - F.col("th") + 1))).cast("bigint").alias("y0"),
    )
    return sized.where(fits).select(
        "image_id", "slot", "attempt", "scale", "angle", spot["x0"].alias("x0"), spot["y0"].alias("y0"),
        (spot["x0"] + F.col("tw")).alias("x1"), (spot["y0"] + F.col("th")).alias("y1"),
    )


def accept_non_overlapping(candidates: DataFrame) -> DataFrame:
    """Accepted placements: in slot order, the first attempt that overlaps nothing accepted before.

    A group is one image's candidates: slots times attempts of the plan, never data sized.
    """
    c = F.struct("slot", "attempt", "x0", "y0", "x1", "y1")
    grouped = candidates.groupBy("image_id").agg(F.array_sort(F.collect_list(c)).alias("c"))
    none = F.array().cast("array<struct<slot:int,attempt:int,x0:bigint,y0:bigint,x1:bigint,y1:bigint>>")

    def step(acc, n):
        hit = F.exists(
            acc,
            lambda a: (a["slot"] == n["slot"])
            | ((n["x0"] < a["x1"]) & (n["x1"] > a["x0"]) & (n["y0"] < a["y1"]) & (n["y1"] > a["y0"])),
        )
        return F.when(hit, acc).otherwise(F.concat(acc, F.array(n)))

    # never empty, as a first candidate overlaps nothing; the plain form would accept twice, to filter by size
    return grouped.select("image_id", F.inline_outer(F.aggregate("c", none, step)))


def jitter_polygon(shapes: DataFrame, per_side: int, distortion: float, seed: int, key: str = "image_id") -> DataFrame:
    """Distorted square outlines fitted to (w, h): key, i, px, py in ring order."""
    side = per_side + 1
    # corners of the unit square in ring order
    cx, cy = F.array(*[F.lit(v) for v in (0.0, 1.0, 1.0, 0.0)]), F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])

    def point(i):
        a, t = F.floor(i / side).cast("int"), (i % side) / F.lit(float(side))
        b = (a + 1) % 4

        def coordinate(corners, name):
            start, end = F.get(corners, a), F.get(corners, b)
            shift = (uniform(seed, F.lit(name), F.col(key), i) * 2 - 1) * distortion
            return start + t * (end - start) + shift

        return F.struct(i.alias("i"), coordinate(cx, "x").alias("x"), coordinate(cy, "y").alias("y"))

    ring = shapes.select(key, "w", "h", F.transform(F.sequence(F.lit(0), F.lit(4 * side - 1)), point).alias("p"))
    xs, ys = F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"])
    ends = ring.withColumns({"lx": F.array_min(xs), "hx": F.array_max(xs), "ly": F.array_min(ys), "hy": F.array_max(ys)})
    fit = lambda v, lo, hi, size: ((v - F.col(lo)) / (F.col(hi) - F.col(lo)) * F.col(size)).cast("int")
    return ends.select(key, "w", "h", "lx", "hx", "ly", "hy", F.inline_outer("p")).select(
        key, "i", fit(F.col("x"), "lx", "hx", "w").alias("px"), fit(F.col("y"), "ly", "hy", "h").alias("py")
    )
