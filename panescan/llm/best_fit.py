"""Best-fit packing planned on the histogram of lengths (operator 12).

Pass one encodes each document and cuts what is longer than a sequence; every piece is stored with its
length and its rank among the pieces of that length in its partition. Counts by length, one row per
length and so at most ``width`` rows, are all that the plan is made of: best-fit decreasing runs over
counts, moving whole groups of equal sequences at once, and gives for each length a short list of runs
(first rank, first sequence, pieces a sequence takes of this length, their place in it). A piece's global
rank within its length is its rank in the partition plus the pieces of that length in earlier partitions,
a running sum over (length, partition) counts; the rank decides the slot. So no task sees all pieces of a
length, and no piece is exchanged with its ids.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panescan.llm.common import keep
from panescan.llm.packing import encoder

WIDTH = 2048
_PIECE = "doc_id long, part int, piece int, start long, length long, local long, ids_crc32 long, ids binary"


def cut(docs: DataFrame, path: str, end: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, part, piece, start, length, local, ids_crc32, ids): pieces of every document's ids and ``end``.

    ``local`` numbers the pieces of one length within a partition; ``ids`` are compressed, four bytes each.
    """

    def run(batches):
        part, seen, ids_of, press = TaskContext.get().partitionId(), defaultdict(int), encoder(path), zstandard.ZstdCompressor(1).compress
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(ids_of(text.as_py()), np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), width)):
                    own = ids[start : start + width]
                    data, n = own.tobytes(), len(own)
                    out.append((doc, part, piece, start, n, seen[n], zlib.crc32(data), press(data)))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], [c.split()[0] for c in _PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, _PIECE)


def plan(counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, first sequence, pieces a sequence, place) runs.

    A group is a number of equal sequences: (number, first sequence, room). The next piece of a length goes
    where the least room is left that holds it; a sequence just given one has less room than its equals, so
    it takes as many as fit before the next one is touched, and whole groups move at once. A length splits
    at most one group, so there are at most two groups and runs more for each length.
    """
    runs, opened = [], 0
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first sequence, number)
    for length in sorted(counts, reverse=True):
        rest, rank = counts[length], 0
        rooms = [r for r in groups if r >= length]
        heapify(rooms)
        while rest:
            if rooms:
                room = rooms[0]
                first, number = groups[room].pop()
                if not groups[room]:
                    del groups[heappop(rooms)]
            else:
                room, first = width, opened
                number = -(-rest // (width // length))
                opened += number
            each = room // length
            full = min(number, rest // each)
            taken = [(first, full, each)] if full else []
            if full < number and (over := rest - full * each):  # the last sequence that gets any gets fewer
                taken.append((first + full, 1, over))
            used = 0
            for at, some, times in taken:
                runs.append((length, rank, at, times, width - room))
                rank, rest, used = rank + some * times, rest - some * times, used + some
                if room - times * length:
                    groups[room - times * length].append((at, some))
            if used < number:
                if room not in groups and room >= length and rest:
                    heappush(rooms, room)
                groups[room].append((first + used, number - used))
    return runs


def place(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """``pieces`` with sequence_id and offset instead of part and local. ``pieces`` must be stored: it is read three times."""
    tally = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``width`` rows
    runs = np.array(sorted(plan(counts, width)), np.int64).reshape(-1, 5)
    length, rank, sequence, each, offset = runs.T.copy()
    # a run's key orders by length, then rank; ranks of one length stay below SPAN
    span = np.int64(1 << 48)
    keys = length * span + rank

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("part", "local", "base")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches):
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, n * span + r, "right") - 1
            nth, turn = np.divmod(r - rank[at], each[at]) if len(at) else (at, at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[at] + nth, pa.int64()), pa.array(offset[at] + turn * n, pa.int64())], [*names, "sequence_id", "offset"])

    shape = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(run, f"{shape}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, end: int = 0, width: int = WIDTH, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, four bytes each) of all pieces.

    Only documents of more than ``width`` ids are cut; no other piece is ever split, and sequences are as
    few as best-fit decreasing makes them. Every row is packed, repeated rows and null or repeated doc_ids
    too; a null or empty text gives its end id alone; a very long one gives as many pieces as it needs. An
    empty table gives no rows. Other columns play no part.
    """
    stored = keep(cut(docs, path, end, width))
    if not ids:
        return place(stored.drop("ids"), width)

    def run(batches):
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            data = pa.array([unpress(d.as_buffer()) for d in batch.column("ids")], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", data)

    placed = place(stored, width)
    return placed.mapInArrow(run, placed.schema)
