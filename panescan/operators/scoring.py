"""Pluggable scoring of patches and photos inside Arrow tasks.

A scorer is a zero-argument factory; each Python worker calls it once and keeps the
result.  ``onnx_model`` makes one from a model file shipped with ``addFile``.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators.patches import grid_step
from panescan.operators.regrid import resize_array
from panescan.operators.voting import _batched
from panescan.session import cut_lineage

Scorer = Callable[[], Callable[[np.ndarray], np.ndarray]]

PATCH = "image_id long, patch_id long, x0 int, y0 int, h int, w int, px binary"
SCORED = "image_id long, patch_id long, x0 int, y0 int, h int, w int, status string, error string, probs binary"
_PATCH_ARROW = pa.schema(
    [("image_id", pa.int64()), ("patch_id", pa.int64())] + [(c, pa.int32()) for c in ("x0", "y0", "h", "w")] + [("px", pa.binary())]
)
_SCORED_ARROW = pa.schema(
    [("image_id", pa.int64()), ("patch_id", pa.int64())]
    + [(c, pa.int32()) for c in ("x0", "y0", "h", "w")]
    + [("status", pa.string()), ("error", pa.string()), ("probs", pa.binary())]
)
LOADED = 2  # models a worker keeps
_loaded: OrderedDict = OrderedDict()


def _scorer_key(factory: Scorer) -> str:
    """Name of a scorer for the workers' caches, made on the driver from what is sent to them."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _worker_scorer(key: str, factory: Scorer):
    if key not in _loaded:
        while len(_loaded) >= LOADED:
            _loaded.popitem(last=False)
        _loaded[key] = factory()
    _loaded.move_to_end(key)
    return _loaded[key]


class onnx_model:
    """Scorer factory over an ONNX file: float images [n,1,h,w] in 0..1 to class logits [n,c,h,w]."""

    def __init__(self, file_name: str):
        self.file_name = file_name

    def __call__(self):
        import onnxruntime

        session = onnxruntime.InferenceSession(SparkFiles.get(self.file_name), providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda images: _softmax(session.run(None, {name: images[:, None].astype(np.float32)})[0])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def resize_nearest(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Last two axes to (h, w); target row i reads floor(i * rows / h)."""
    if a.shape[-2:] == (h, w):
        return a
    rows, cols = np.arange(h) * a.shape[-2] // h, np.arange(w) * a.shape[-1] // w
    return a[..., rows[:, None], cols[None, :]]


def area_downscale(a: np.ndarray, factor: int) -> np.ndarray:
    """Area mean by a whole factor, remainder cut, whole levels."""
    h, w = a.shape[0] // factor, a.shape[1] // factor
    blocks = a[: h * factor, : w * factor].reshape(h, factor, w, factor)
    return np.floor(blocks.mean(axis=(1, 3)) + 0.5).astype(np.uint8)


# --- fixed values: the cubic kernel's parameter -----------------------------------------
CUBIC = -0.75


def _cubic_weights(n: int, m: int) -> np.ndarray:
    """Share of each of ``n`` cells in each of ``m``: cubic convolution about cell centres, borders replicate."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    out = np.zeros((m, n))
    for k in range(-1, 3):
        cell = np.floor(at).astype(int) + k
        d = np.abs(at - cell)
        near = (CUBIC + 2) * d**3 - (CUBIC + 3) * d**2 + 1
        far = CUBIC * (d**3 - 5 * d**2 + 8 * d - 4)
        np.add.at(out, (np.arange(m), np.clip(cell, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0.0)))
    return out


def resize_cubic(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Last two axes to (h, w), smoothly; values may leave their range a little next to steep edges."""
    if a.shape[-2:] == (h, w):
        return a
    return _cubic_weights(a.shape[-2], h) @ a @ _cubic_weights(a.shape[-1], w).T


def _judged(predict, stack: list[tuple]) -> Iterator[tuple]:
    """(patch, scores or error) of a stack of equal shape; a failing stack is halved down to its failing patches."""
    todo = [stack]
    while todo:
        part = todo.pop()
        try:
            found = np.asarray(predict(np.stack([image for _, image in part])))
            if len(found) != len(part):
                raise ValueError(f"{len(found)} results for {len(part)} patches")
        except Exception as error:  # the row carries the failure, the job goes on
            if len(part) == 1:
                yield part[0][0], error
            else:
                middle = len(part) // 2
                todo += [part[middle:], part[:middle]]
            continue
        yield from zip((p for p, _ in part), found)


def score(patches: DataFrame, scorer: Scorer, target: tuple[int, int] | None = None, shrink: str = "nearest", back: str = "nearest", stack_bytes: int = 0) -> DataFrame:
    """Class scores per patch (float32, class-major); a failing patch becomes an error row.

    The patch is brought to ``target`` (``shrink``: ``nearest`` or ``area``), scaled to 0..1,
    scored, and the scores are brought back to the patch size (``back``: ``nearest`` or ``cubic``).
    With ``stack_bytes`` 0 a patch is scored alone.  Otherwise a task stacks patches of equal shape
    until its stacks hold that many bytes and then scores the largest; the scorer judges each
    image of a stack by itself, and a stack that fails is halved down to the patches at fault.
    """
    if shrink not in ("nearest", "area") or back not in ("nearest", "cubic"):
        raise ValueError(f"unknown resize: {shrink}, {back}")
    key = _scorer_key(scorer)
    enlarge = resize_cubic if back == "cubic" else resize_nearest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _worker_scorer(key, scorer)

        def row(p: dict, found) -> dict:
            out = {k: p[k] for k in ("image_id", "patch_id", "x0", "y0", "h", "w")}
            try:
                if isinstance(found, Exception):
                    raise found
                probs = np.ascontiguousarray(enlarge(np.asarray(found, np.float32), p["h"], p["w"]), np.float32)
                return {**out, "status": "ok", "error": None, "probs": probs.tobytes()}
            except Exception as error:
                return {**out, "status": "error", "error": f"{type(error).__name__}: {error}", "probs": None}

        def rows():
            stacks, held = {}, 0
            for p in (p for batch in batches for p in batch.to_pylist()):
                try:
                    image = np.frombuffer(p["px"], np.uint8).reshape(p["h"], p["w"])
                    image = resize_array(image, *(target or image.shape), shrink).astype(np.float32) / np.float32(255.0)
                except Exception as error:
                    yield row(p, error)
                    continue
                stacks.setdefault(image.shape, []).append(({k: p[k] for k in p if k != "px"}, image))
                held += image.nbytes
                while held > stack_bytes:
                    fullest = max(stacks, key=lambda shape: sum(i.nbytes for _, i in stacks[shape]))
                    stack = stacks.pop(fullest)
                    held -= sum(i.nbytes for _, i in stack)
                    yield from (row(*judged) for judged in _judged(predict, stack))
            for stack in stacks.values():
                yield from (row(*judged) for judged in _judged(predict, stack))

        yield from _batched(rows(), _SCORED_ARROW)

    return patches.select("image_id", "patch_id", "x0", "y0", "h", "w", "px").mapInArrow(run, SCORED)


def score_pixels(scored: DataFrame, num_classes: int = schema.CLASS_COUNT) -> DataFrame:
    """Pixel view of scored patches: image_id, patch_id, y, x, probs, status of good patches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                h, w = p["h"], p["w"]
                probs = np.frombuffer(p["probs"], np.float32).reshape(num_classes, h * w).T.astype(np.float64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "image_id": pa.array(np.full(h * w, p["image_id"], np.int64)),
                        "patch_id": pa.array(np.full(h * w, p["patch_id"], np.int64)),
                        "y": pa.array((np.repeat(np.arange(h), w) + p["y0"]).astype(np.int32)),
                        "x": pa.array((np.tile(np.arange(w), h) + p["x0"]).astype(np.int32)),
                        "probs": pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1, dtype=np.int32) * num_classes), pa.array(probs.ravel())),
                    }
                )

    ok = scored.where("status = 'ok'").select("image_id", "patch_id", "x0", "y0", "h", "w", "probs")
    return ok.mapInArrow(run, "image_id long, patch_id long, y int, x int, probs array<double>").withColumn("status", F.lit("ok"))


def cut_patches(tiles: DataFrame, frames: DataFrame, size: int, overlap: float | int, pad: bool = True) -> DataFrame:
    """Patches of the frame (image_id, x, y, w, h) put together from the tiles they meet.

    Tiles send the parts each patch needs; a patch is assembled as its parts stream in.
    ``pad`` fills edge patches with zeros at the bottom and right up to ``size``.
    Coordinates count from the frame corner.
    """
    step = grid_step(size, overlap)
    fr = frames.select("image_id", *[F.col(c).cast("int").alias(f"f{c}") for c in ("x", "y", "w", "h")])
    carried = "image_id long, patch_id long, py int, px0 int, ph int, pw int, y0 int, x0 int, h int, w int, px binary"
    arrow = pa.schema(
        [("image_id", pa.int64()), ("patch_id", pa.int64())] + [(c, pa.int32()) for c in ("py", "px0", "ph", "pw", "y0", "x0", "h", "w")] + [("px", pa.binary())]
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for t in batch.to_pylist():
                    a = np.frombuffer(t["px"], np.uint8).reshape(t["h"], t["w"])
                    y0, x0 = t["y0"] - t["fy"], t["x0"] - t["fx"]
                    n_cols, n_rows = -(-t["fw"] // step), -(-t["fh"] // step)
                    for row in range(max(0, (y0 - size) // step + 1), min(n_rows, -(-(y0 + t["h"]) // step))):
                        for col in range(max(0, (x0 - size) // step + 1), min(n_cols, -(-(x0 + t["w"]) // step))):
                            top, left = row * step, col * step
                            bottom, right = min(top + size, t["fh"]), min(left + size, t["fw"])
                            u, v = max(y0, top), max(x0, left)
                            d, r = min(y0 + t["h"], bottom), min(x0 + t["w"], right)
                            if u < d and v < r:
                                yield {
                                    "image_id": t["image_id"], "patch_id": row * n_cols + col, "py": top, "px0": left,
                                    "ph": bottom - top, "pw": right - left, "y0": u, "x0": v, "h": d - u, "w": r - v,
                                    "px": a[u - y0 : d - y0, v - x0 : r - x0].tobytes(),
                                }

        yield from _batched(parts(), arrow)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole():
            rows = (r for batch in batches for r in batch.to_pylist())
            for (image_id, patch_id), group in groupby(rows, key=itemgetter("image_id", "patch_id")):
                out = None
                for r in group:
                    if out is None:
                        h, w = (size, size) if pad else (r["ph"], r["pw"])
                        out = np.zeros((h, w), np.uint8)
                    part = np.frombuffer(r["px"], np.uint8).reshape(r["h"], r["w"])
                    out[r["y0"] - r["py"] : r["y0"] - r["py"] + r["h"], r["x0"] - r["px0"] : r["x0"] - r["px0"] + r["w"]] = part
                yield {"image_id": image_id, "patch_id": patch_id, "x0": r["px0"], "y0": r["py"], "h": h, "w": w, "px": out.tobytes()}

        yield from _batched(whole(), _PATCH_ARROW)

    met = tiles.select("image_id", "y0", "x0", "h", "w", "px").join(fr, "image_id").mapInArrow(send, carried)
    return met.repartition("image_id", "patch_id").sortWithinPartitions("image_id", "patch_id").mapInArrow(assemble, PATCH)


# --------------------------------------------------------------------------- detection
DETECTION = "image_id long, det_id long, x0 double, y0 double, x1 double, y1 double, conf double, cls int, status string, error string"
_DETECTION_ARROW = pa.schema(
    [("image_id", pa.int64()), ("det_id", pa.int64())] + [(c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "conf")]
    + [("cls", pa.int32()), ("status", pa.string()), ("error", pa.string())]
)


def detect(photos: DataFrame, scorer: Scorer, factor: int = 25) -> DataFrame:
    """Boxes per photo (image_id, h, w, px grey) from a detector on the area-downscaled photo.

    The detector sees a 3-channel copy of the grey photo and returns rows x0, y0, x1, y1,
    conf, cls; boxes come back in photo pixels.  A failing photo gives one error row.
    """
    key = _scorer_key(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _worker_scorer(key, scorer)

        def rows():
            none = dict.fromkeys(("x0", "y0", "x1", "y1", "conf", "cls"))
            for batch in batches:
                for p in batch.to_pylist():
                    try:
                        small = area_downscale(np.frombuffer(p["px"], np.uint8).reshape(p["h"], p["w"]), factor)
                        for i, (x0, y0, x1, y1, conf, cls) in enumerate(predict(np.repeat(small[..., None], 3, axis=2))):
                            corners = {n: float(int(v * factor)) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))}
                            yield {"image_id": p["image_id"], "det_id": i, **corners, "conf": float(conf), "cls": int(cls), "status": "ok", "error": None}
                    except Exception as error:  # the row carries the failure, the job goes on
                        yield {"image_id": p["image_id"], "det_id": 0, **none, "status": "error", "error": f"{type(error).__name__}: {error}"}

        yield from _batched(rows(), _DETECTION_ARROW)

    return photos.select("image_id", "h", "w", "px").mapInArrow(run, DETECTION)


# --------------------------------------------------------------------------- class checks
def class_warnings(num_classes: int, names: Sequence[str]) -> list[str]:
    """Warnings, never errors: name count off, or fewer classes than a multi-class model has."""
    found = []
    if num_classes != len(names):
        found.append(f"model has {num_classes} classes but {len(names)} names are given")
    if num_classes < 3:
        found.append(f"model has only {num_classes} classes")
    return found


def observe_classes(scored: DataFrame, name: str = "classes") -> tuple[DataFrame, Observation]:
    """Class count and failure count measured while the job runs."""
    seen = Observation(name)
    n = F.length("probs") / (F.col("h") * F.col("w") * 4)
    return scored.observe(seen, F.max(n).cast("int").alias("num_classes"), F.count_if(F.col("status") == "error").alias("errors")), seen


def check_classes(scored: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scored patches, stored, and one row (num_classes, errors, warnings) about what was in them.

    Counts are measured while the patches are stored, so the check costs no second pass.  A mismatch
    is a warning, never an error; ``num_classes`` is null and warned of if no patch could be scored.
    """
    observed, seen = observe_classes(scored)
    kept = cut_lineage(observed)
    n, errors = (seen.get[c] for c in ("num_classes", "errors"))
    warnings = ["no patch was scored"] if n is None else class_warnings(n, names)
    report = scored.sparkSession.range(1).select(
        F.lit(n).cast("int").alias("num_classes"), F.lit(errors).cast("bigint").alias("errors"),
        F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"),
    )
    return kept, report
