"""Embedding near-dedup by int8 tile products with rigorous bounds (operator 10).

Equal vectors are merged first, with their number, so a vector held by a third of all rows is one row.
Distinct vectors are quantised to int8 with a scale and the exact length of the quantisation error, and
dealt to tiles. Every pair of tiles is a task row of its own (the work is quadratic in distinct vectors;
rows and memory are bounded by the tile). A product of quantised vectors plus both error bounds is never
below the true cosine; only pairs whose bound reaches the threshold are computed in double precision. A
tile pair returns sums and a local star forest, never its links, so a dense group stays small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from panescan.llm.common import blocks, keep, partitions
from panescan.llm.components import components

TILE = 4096  # vectors of a tile
STRIP = 1024  # rows of a tile multiplied at once


def slack(dim: int) -> float:
    """Above the rounding of a single-precision product of unit vectors with ``dim`` components and two bounds.

    Each of the dim + 2 terms is rounded once in either factor, once as a product and at most dim + 1 times in
    the sum, by 2^-24 of itself; the terms' sizes add up to no more than 1 and what the bounds add.
    """
    return 2 * (dim + 5) * 2.0**-24


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: no square overflows, no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the exact error lengths of the unit vectors of ``x``."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def bounded(codes: np.ndarray, scale: np.ndarray, error: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products with the other side's bound the cosine from above.

    u.w = u'.w' + u'.f + e.w' + e.f for u = u'+e, w = w'+f; with |u'| <= 1+|e| the rest is at most
    |e| + |f| + 3|e||f|, and |e||f| <= (|e|^2 + |f|^2) / 2, so each side adds |e| + 1.5|e|^2.
    """
    own, one = (error + 1.5 * error**2)[:, None], np.ones((len(codes), 1))
    return np.hstack([codes * scale[:, None], *((own, one) if left else (one, own))]).astype(np.float32)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each node's component over links a-b and the stars that ``labels`` (places) already form."""
    nodes = np.arange(len(labels))
    a, b = np.r_[a, nodes], np.r_[b, labels]
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


class Tile:
    def __init__(self, row: dict):
        self.dim, self.ids = row["dim"], np.frombuffer(row["ids"], np.int64)
        self.copies, width = np.frombuffer(row["copies"], np.int64), len(row["raw"]) // (len(self.ids) * self.dim)
        self.raw = scaled(np.frombuffer(row["raw"], f"<f{width}").reshape(-1, self.dim).astype(float))
        self.codes, self.scale, self.error = np.frombuffer(row["codes"], np.int8).reshape(-1, row["dim"]), np.frombuffer(row["scale"]), np.frombuffer(row["error"])
        self.norm = np.linalg.norm(self.raw, axis=1)


def compare(x: Tile, y: Tile, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, links to other distinct vectors (copies counted) and least id of the local component, of vectors with a link."""
    ids = x.ids if same else np.r_[x.ids, y.ids]
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # places ordered by id, so least place is least id
    labels, sums, shift = np.arange(len(ids)), np.zeros(len(ids), np.int64), 0 if same else len(x.ids)
    right = bounded(y.codes, y.scale, y.error, False)
    for top in range(0, len(x.ids), STRIP):
        stop = min(top + STRIP, len(x.ids))
        upper = bounded(x.codes[top:stop], x.scale[top:stop], x.error[top:stop], True) @ right.T
        near = upper >= threshold - slack(x.dim)
        if same:
            near &= np.arange(top, stop)[:, None] < np.arange(len(y.ids))
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            continue
        exact = (x.raw[top:stop][rows] @ y.raw[cols].T) / (x.norm[top:stop][rows, None] * y.norm[cols])
        hit = near[np.ix_(rows, cols)] & (exact >= threshold)
        sums[top + rows] += hit @ y.copies[cols]
        sums[shift + cols] += x.copies[top:stop][rows] @ hit
        a, b = np.nonzero(hit)
        labels = join_labels(labels, rank[top + rows[a]], rank[shift + cols[b]])
    found = np.flatnonzero(sums)
    return ids[found], sums[found], np.sort(ids)[labels[rank[found]]]


_BLOB = "dim int, tile int, ids binary, copies binary, raw binary, codes binary, scale binary, error binary"
_FACTS = ["ids", "copies", "raw", "codes", "scale", "error"]


def _tiles(distinct: DataFrame, count: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        vectors = table.column("embedding").combine_chunks()
        raw = vectors.flatten().to_numpy().reshape(-1, dim)  # single or double, as given
        codes, scale, error = quantise(scaled(raw.astype(float)))
        blobs = [np.array(table.column(c).to_pylist(), np.int64) for c in ("id", "copies")] + [raw, codes, scale, error]
        names = [pa.array([v.tobytes()], pa.binary()) for v in blobs]
        return pa.table([pa.array([dim], pa.int32()), pa.array([table.column("tile")[0].as_py()], pa.int32()), *names], ["dim", "tile", *_FACTS])

    tiles = blocks(count, TILE)
    dealt = distinct.withColumn("dim", F.size("embedding")).withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    return dealt.groupBy("dim", "tile").applyInArrow(build, _BLOB)


def linked(distinct: DataFrame, threshold: float) -> DataFrame:
    """(id, links, least) for each tile pair in which a distinct vector (id, copies, embedding) has a link."""
    spark = distinct.sparkSession
    count = distinct.count()
    tiles, last = keep(_tiles(distinct, count)), blocks(count, TILE) - 1
    # row tile x meets every tile y >= x: y's copies go to one pair each, x's too
    row = tiles.withColumn("y", F.explode(F.sequence(F.col("tile"), F.lit(last)))).withColumnRenamed("tile", "x").withColumn("side", F.lit(0))
    col = tiles.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tile")))).withColumnRenamed("tile", "y").withColumn("side", F.lit(1)).where("x <> y")
    pairs = row.unionByName(col).repartition(max(partitions(spark), min(1000, (last + 1) * (last + 2) // 2)), "dim", "x", "y").sortWithinPartitions("dim", "x", "y", "side")

    def run(batches):
        at, own = None, None
        for batch in batches:
            for i in range(len(batch)):
                item = {c: batch.column(c)[i].as_py() for c in ["dim", "x", "y", "side", *_FACTS]}
                tile = Tile(item)
                if item["side"] == 0:
                    at, own = (item["dim"], item["x"], item["y"]), tile
                    if item["x"] != item["y"]:
                        continue
                elif at != (item["dim"], item["x"], item["y"]):
                    continue  # no row tile of this dimension
                ids, links, least = compare(own, tile, item["x"] == item["y"], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(least)], ["id", "links", "least"])

    return pairs.mapInArrow(run, "id long, links long, least long")


def near_vectors(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
    vectors of different lengths and rows with a null vec_id. A repeated row counts as another vector.
    Labels and other columns play no part. Components stay as precise as they are given: single stays single,
    all other numbers are taken as double. An empty table gives no rows.
    """
    single = embeddings.schema["embedding"].dataType == ArrayType(FloatType(), embeddings.schema["embedding"].dataType.containsNull)
    kind = "array<float>" if single else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))
    distinct = keep(rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    found = keep(linked(distinct, threshold))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    facts = keep(distinct.join(sums, "id", "left").join(groups, "id", "left").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    ))
    linked_rows = rows.where(good).join(facts, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
with recursive
v as (select vec_id, embedding::double[] e from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id x, b.vec_id y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
select vec_id, (select count(*) from l where x = vec_id) as n_links,
       least(vec_id, coalesce((select min(y) from r where x = vec_id), vec_id)) as component_id,
       vec_id = least(vec_id, coalesce((select min(y) from r where x = vec_id), vec_id)) as kept
from embeddings
"""
