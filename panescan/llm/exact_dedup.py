"""Exact dedup by minimal perfect hash (operator 6).

Historical distinct digests are cut into buckets; each bucket is an index row: the levels of a
minimal perfect hash, and slots that hold the full digest, the winner's id and the group's size.
Rows meet the index by (bucket, slice): a hot bucket is cut into many slices, each with a copy of the
bounded index row, so a digest held by a third of all rows fills many tasks. A lookup compares all 32
digest bytes; what fails is no member. Nonmembers are grouped on their own (counts are combined before
the exchange), the digests that repeat among them form the next index, and the same lookup gives
their members the winner.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import blocks, keep, partitions

BUCKET_KEYS = 2_000  # digests of an index row: 48 bytes each
SLICE_ROWS = 2_000  # rows that meet one copy of an index row
BROADCAST_ROWS = 1_000_000  # more index rows than this are joined by a shuffle


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """A hash of each digest (its four 64-bit words) per level."""
    x = words[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: bit levels, keys that collide go one deeper."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.concatenate([[0], np.cumsum([int(bits.sum()) for bits in levels])])
        self.ranks = [np.cumsum(bits) - bits for bits in levels]

    @staticmethod
    def build(words: np.ndarray) -> PerfectHash:
        levels, left, level = [], np.arange(len(words)), 0
        while len(left):
            place = (_mix(words[left], level) % np.uint64(2 * len(left) + 1)).astype(np.int64)
            hits = np.bincount(place, minlength=2 * len(left) + 1)
            levels.append((hits == 1).astype(np.int64))
            left, level = left[hits[place] > 1], level + 1
        return PerfectHash(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each digest; one that was not built in gets any slot or -1."""
        out, left = np.full(len(words), -1), np.arange(len(words))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            place = (_mix(words[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place] == 1
            out[left[hit]] = self.before[level] + self.ranks[level][place[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.levels], b"".join(np.packbits(b.astype(np.uint8)).tobytes() for b in self.levels)

    @staticmethod
    def load(lengths: list[int], data: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in lengths:
            size = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(np.int64))
            at += size
        return PerfectHash(levels)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text with A-Z lower-cased; null counts as empty."""

    def digest(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [hashlib.sha256(t.lower()).digest() for t in texts]  # bytes.lower() changes A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(digest, "doc_id long, digest binary")


def _bucket(digest: str, buckets: int):
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def build_index(groups: DataFrame, buckets: int, rows: int) -> DataFrame:
    """Index rows of ``groups`` (digest distinct, winner, size); ``slices`` says how many copies a bucket
    needs when ``rows`` rows are looked up: by the members it holds, or by its even share."""
    even = blocks(rows, buckets * SLICE_ROWS)

    def build(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        words = _words(digests)
        hashed = PerfectHash.build(words)
        order = np.argsort(hashed.slots(words))
        lengths, bits = hashed.dump()
        size = np.array(table.column("size").to_pylist(), np.int64)[order]
        ids = table.column("winner").to_pylist()
        known = np.array([w is not None for w in ids])[order]
        winner = np.array([w or 0 for w in ids], np.int64)[order]
        return pa.table(
            {
                "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                "slices": pa.array([even + int(size.sum()) // SLICE_ROWS], pa.int32()),
                "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "bits": pa.array([bits], pa.binary()),
                "digests": pa.array([words[order].tobytes()], pa.binary()),
                "winners": pa.array([winner.tobytes()], pa.binary()),
                "known": pa.array([known.tobytes()], pa.binary()),
                "sizes": pa.array([size.tobytes()], pa.binary()),
            }
        )

    schema = "bucket int, slices int, lengths array<int>, bits binary, digests binary, winners binary, known binary, sizes binary"
    return groups.withColumn("bucket", _bucket("digest", buckets)).groupBy("bucket").applyInArrow(build, schema)


def look_up(rows: DataFrame, groups: DataFrame, distinct: int) -> DataFrame:
    """``rows`` (doc_id, digest) with ``winner`` and ``size`` of their group; size is null for nonmembers.

    ``distinct`` is the number of groups; an index row holds BUCKET_KEYS of them on average.
    """
    buckets = blocks(distinct, BUCKET_KEYS)
    total = rows.count()
    index = keep(build_index(groups, buckets, total))
    slices = index.select("bucket", "slices")  # 8 bytes for BUCKET_KEYS groups
    slices = F.broadcast(slices) if buckets <= BROADCAST_ROWS else slices
    # by place, so that copies with null ids or one and the same id spread like any others
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.withColumn("bucket", _bucket("digest", buckets)).join(slices, "bucket", "left")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("place", F.lit(7)), F.coalesce("slices", F.lit(blocks(total, buckets * SLICE_ROWS)))).cast("int"))
    copies = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    facts = ["lengths", "bits", "digests", "winners", "known", "sizes"]
    both = dealt.select("bucket", "slice", F.lit(1).alias("kind"), "doc_id", "digest", *[F.lit(None).alias(c) for c in facts])
    both = copies.select("bucket", "slice", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), *facts).unionByName(both)
    both = both.repartition(partitions(rows.sparkSession), "bucket", "slice").sortWithinPartitions("bucket", "slice", "kind")

    def probe(batches):
        at, hashed, full, winners, known, sizes = None, None, None, None, None, None
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist())
            heads = np.array(batch.column("bucket").to_pylist(), np.int64) * (1 << 31) + np.array(batch.column("slice").to_pylist(), np.int64)
            cuts = np.flatnonzero(np.r_[True, (heads[1:] != heads[:-1]) | (kinds[:-1] == 0)]) if len(kinds) else []
            for a, b in zip(cuts, [*cuts[1:], len(kinds)]):
                if kinds[a] == 0:
                    row = {c: batch.column(c)[int(a)].as_py() for c in facts}
                    at, hashed = heads[a], PerfectHash.load(row["lengths"], row["bits"])
                    full = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
                    winners, sizes = np.frombuffer(row["winners"], np.int64), np.frombuffer(row["sizes"], np.int64)
                    known = np.frombuffer(row["known"], bool)
                    continue
                part = batch.slice(int(a), int(b - a))
                found, slot = np.zeros(len(part), bool), np.zeros(len(part), np.int64)
                if heads[a] == at:
                    words = _words(part.column("digest").to_pylist())
                    slot = hashed.slots(words)
                    found = (slot >= 0) & (full[np.maximum(slot, 0)] == words).all(1)
                    slot = np.where(found, slot, 0)
                w = winners[slot] if heads[a] == at else np.zeros(len(part), np.int64)
                n = sizes[slot] if heads[a] == at else w
                has = known[slot] & found if heads[a] == at else found
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(w, pa.int64(), mask=~has), pa.array(n, pa.int64(), mask=~found)],
                    ["doc_id", "digest", "winner", "size"],
                )

    return both.mapInArrow(probe, "doc_id long, digest binary, winner long, size long")


def exact_groups(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` (digest, winner, size), digests distinct, comes from earlier runs; its members keep the
    winner stored there, so all of today's repeats of them go. Without it, all rows are nonmembers.
    Null and empty texts form one group. A repeated doc_id shares its group's verdict with its twin; a
    null doc_id stays only where its whole group has null ids. Other columns play no part.
    """
    rows = keep(fingerprints(docs))
    members, rest = None, rows
    if history is not None:
        looked = keep(look_up(rows, history, history.count()))
        members, rest = looked.where("size is not null"), looked.where("size is null").select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size")).where("size > 1")
    groups = keep(groups)
    found = look_up(rest, groups, groups.count())
    single = F.col("size").isNull()
    found = found.select("doc_id", "digest", F.when(single, F.col("doc_id")).otherwise(F.col("winner")).alias("winner"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    if members is not None:
        found = members.unionByName(found)
    return found.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that lose to an equal text; all columns as they were.

    Rows are judged, not ids: a null or repeated doc_id loses only with the texts that lose.
    """
    lost = exact_groups(docs).where("not kept").select(F.col("doc_id").alias("_lost"), F.col("text_sha256").alias("_digest")).distinct()
    digest = F.sha2(F.translate(F.coalesce(docs["text"], F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["_lost"]) & (digest == lost["_digest"]), "left_anti")


SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents)
select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
       doc_id = max(doc_id) over (partition by x) as kept, sha256(x) as text_sha256 from t
"""
