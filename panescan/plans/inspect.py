"""End-to-end inspection of photos as one composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators import metrics, raster, regions, scoring, summary, voting
from panescan.session import cut_lineage


class Tables(dict):
    """Tables by name; those in ``later`` are made when first asked for."""

    def __init__(self, ready: dict[str, DataFrame]):
        super().__init__(ready)
        self.later: dict = {}

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.later[name]()
        return self[name]


def inspect(tiles: DataFrame, frames: DataFrame, scorer: scoring.Scorer, *, patch_size: int = 1024, overlap: float | int = 0.2, tile: int = 1024, full: bool = True, truth: DataFrame | None = None, only_image: int | None = None, stack_bytes: int = 0) -> dict[str, DataFrame]:
    """Result tables of a batch, or of one image, with or without truth, voted over the screen or per patch.

    ``tiles``: grey tiles of the photos; ``frames``: screen box per image (image_id, x, y, w,
    h); ``truth``: class runs in screen coordinates.  A single image is a filter, so all
    eight modes share one plan.  ``full`` votes overlapping patches into the screen; without
    it every patch is an image of its own, truth has a patch_id and so have all tables but
    the summary.

    Patches are scored once, in stacks of ``stack_bytes`` (``scoring.score``): scores and class runs are checkpointed, and every table reads
    those.  Regions are found when ``tables["regions"]`` is first asked for.
    """
    if only_image is not None:
        tiles, frames = (d.where(F.col("image_id") == only_image) for d in (tiles, frames))
        truth = truth if truth is None else truth.where(F.col("image_id") == only_image)
    scored = scoring.score(scoring.cut_patches(tiles, frames, patch_size, overlap), scorer, stack_bytes=stack_bytes)
    scored = cut_lineage(scored.withColumn("unit", F.monotonically_increasing_id()))  # names a patch, whatever the ids
    units = scored.select("unit", "image_id", "patch_id")
    if full:
        size = frames.select("image_id", "h", "w")
        voted = voting.vote_tiles(scored.select("image_id", "patch_id", "x0", "y0", "h", "w", "status", "probs"), size, tile)
    else:
        alone = scored.withColumns({"image_id": F.col("unit"), "x0": F.lit(0).cast("int"), "y0": F.lit(0).cast("int")})
        size = alone.select("image_id", "h", "w")
        voted = voting.vote_tiles(alone.select("image_id", "patch_id", "x0", "y0", "h", "w", "status", "probs"), size, tile)
        if truth is not None:
            truth = truth.join(units, ["image_id", "patch_id"]).drop("image_id", "patch_id").withColumnRenamed("unit", "image_id")

    def named(found: DataFrame) -> DataFrame:
        return found if full else found.withColumnRenamed("image_id", "unit").join(units, "unit").drop("unit")

    runs = cut_lineage(raster.tiles_to_runs(voted.select("image_id", "layer", "ty", "tx", "y0", "x0", "h", "w", "px")))
    pixels = size.select("image_id", (F.col("h").cast("bigint") * F.col("w")).alias("frame_pixels"))
    stats = summary.class_stats(runs.join(pixels, "image_id"), F.col("frame_pixels"), ("image_id", "layer", "frame_pixels")).drop("frame_pixels")
    wide = stats.groupBy("image_id").agg(
        *[F.max(F.when(F.col("class_id") == c, F.col("percentage"))).alias(f"pct{c}") for c in range(schema.CLASS_COUNT)]
    )
    tables = Tables({"status": scored.drop("probs", "unit"), "class_runs": named(runs), "class_stats": named(stats), "summary": summary.batch_summary(wide)})
    tables.later["regions"] = lambda: named(regions.connected_regions(runs))
    if truth is not None:
        columns = ["image_id", "layer", "class_id", "y", "x0", "x1"]
        both = runs.select(columns).unionByName(truth.withColumn("layer", F.lit("truth")).select(columns))
        counts = metrics.confusion_counts(raster.overlay(both, "pred", "truth"))
        tables["metrics"] = named(metrics.full_metrics(counts, schema.CLASS_COUNT))
    return tables
