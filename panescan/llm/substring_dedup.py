"""Substring dedup (operator 4): words inside a repeated window of 35 go.

Two ways, for two kinds of reference:

* ``strip_reference``: the dealt method. The reference is cut into shards, each becomes a suffix
  automaton of its words, broadcast; documents stream past for matching statistics, and maximal spans
  of at least ``width`` words go. The reference is bounded and its size is checked, since an automaton
  takes some hundred bytes a word.
* ``strip_repeats``: the corpus is its own reference, so the automata would have to hold all of it and
  every document would stream past all of them, work that grows with the square of the corpus. Here
  windows are compared by a 64-bit fingerprint instead: documents are stored in chunks of bounded size;
  a chunk sends its distinct window fingerprints, sorted and cut into hash ranges, to the ranges'
  tasks; a range answers one bit per fingerprint, whether it starts anywhere else. A window that a third
  of all documents hold comes once per chunk, so no range is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import blocks, keep, partitions

WIDTH = 35
CHUNK_BYTES = 2_000_000  # text of a chunk, but for a longer single document
RANGE_WINDOWS = 250_000  # fingerprints of a hash range
REFERENCE_WORDS = 200_000  # words of a broadcast reference, all shards
SHARD_WORDS = 50_000

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, np.uint64(base))
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def windows(words: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the windows that lie within one document of the joined ``words``."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(_PRIME, n), out=sums[1:])
    found = (sums[width:] - sums[: n - width + 1]) * _powers(_INVERSE, n - width + 1)
    found = (found ^ (found >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths)[: n - width + 1] - np.arange(n - width + 1)
    starts = np.flatnonzero(room >= width)
    return starts, found[starts]


def covered(flags: np.ndarray, starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` words lie in a flagged window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[flags], 1)
    np.add.at(edge, starts[flags] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, known, sizes, data, words): documents of a partition in rows of bounded size."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, room = [], [], CHUNK_BYTES
        pack = zstandard.ZstdCompressor(level=1)

        def row():
            words = sum(len(t.split()) for t in texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            known = np.array([i is not None for i in ids])
            values = [(part << 32) + number], [np.array([i or 0 for i in ids], np.int64).tobytes()], [known.tobytes()], [sizes.tobytes()], [pack.compress(b"".join(texts))], [words]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64()] + [pa.binary()] * 4 + [pa.int64()])], ["chunk", "ids", "known", "sizes", "data", "words"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if ids and len(text) > room:
                    yield row()
                    ids, texts, room, number = [], [], CHUNK_BYTES, number + 1
                ids.append(doc)
                texts.append(text)
                room -= len(text)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk long, ids binary, known binary, sizes binary, data binary, words long")


class Chunk:
    """A chunk's documents as words, and its windows; ``distinct`` fingerprints are sorted."""

    def __init__(self, row: dict, width: int):
        data, sizes = zstandard.ZstdDecompressor().decompress(row["data"]) if row["data"] else b"", np.frombuffer(row["sizes"], np.int64)
        ends = np.cumsum(sizes)
        self.docs = [data[e - s : e].split() for s, e in zip(sizes.tolist(), ends.tolist())]
        self.ids = [i if k else None for i, k in zip(np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["known"], bool).tolist())]
        self.words = [w for words in self.docs for w in words]
        self.lengths = np.array([len(d) for d in self.docs], np.int64)
        self.starts, marks = windows(self.words, self.lengths, width)
        self.distinct, self.place, self.counts = np.unique(marks, return_inverse=True, return_counts=True)

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each hash range begins in ``distinct``."""
        edges = (np.arange(ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)
        return np.append(np.searchsorted(self.distinct, edges), len(self.distinct))

    def result(self, again: np.ndarray, width: int) -> pa.RecordBatch:
        gone = covered(again[self.place], self.starts, len(self.words), width)
        out, at = [], 0
        for doc, words in zip(self.ids, self.docs):
            lost = gone[at : at + len(words)]
            kept = [w for w, g in zip(words, lost.tolist()) if not g] if lost.any() else words
            out.append((doc, len(words), len(words) - len(kept), b" ".join(kept)))
            at += len(words)
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.binary()])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


_CHUNK = ["ids", "known", "sizes", "data"]


def strip_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, as UTF-8 bytes.

    A null, empty or blank text has no words. A repeated row repeats all of its windows, so of equal
    texts with ``width`` words or more nothing is left; null and repeated doc_ids are rows like others.
    Windows never cross documents. Other columns play no part. An empty table gives no rows.
    """
    stored = keep(chunks(docs))
    total = stored.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    ranges = blocks(total, RANGE_WINDOWS)

    def send(batches):
        for batch in batches:
            for i in range(len(batch)):
                chunk = Chunk({c: batch.column(c)[i].as_py() for c in _CHUNK}, width)
                cuts = chunk.cuts(ranges)
                full = np.flatnonzero(np.diff(cuts))
                marks = [chunk.distinct[cuts[r] : cuts[r + 1]].tobytes() for r in full]
                twice = [np.packbits(chunk.counts[cuts[r] : cuts[r + 1]] > 1).tobytes() for r in full]
                number = pa.array([batch.column("chunk")[i].as_py()] * len(full), pa.int64())
                yield pa.RecordBatch.from_arrays([number, pa.array(full, pa.int32()), pa.array(marks, pa.binary()), pa.array(twice, pa.binary())], ["chunk", "range", "marks", "twice"])

    def answer(table: pa.Table) -> pa.Table:
        marks = [np.frombuffer(m, np.uint64) for m in table.column("marks").to_pylist()]
        sizes = [len(m) for m in marks]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(table.column("twice").to_pylist(), sizes)])
        distinct, place, counts = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
        again = counts > 1
        np.logical_or.at(again, place, twice > 0)
        flags = again[place]
        bits = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
        return pa.table([table.column("chunk"), table.column("range"), pa.array(bits, pa.binary())], ["chunk", "range", "bits"])

    sent = stored.select("chunk", *_CHUNK).mapInArrow(send, "chunk long, range int, marks binary, twice binary")
    answers = sent.groupBy("range").applyInArrow(answer, "chunk long, range int, bits binary")
    one = stored.select("chunk", F.lit(-1).alias("range"), F.lit(None).cast("binary").alias("bits"), *_CHUNK)
    both = one.unionByName(answers.select("chunk", "range", "bits", *[F.lit(None).cast("binary").alias(c) for c in _CHUNK]))
    both = both.repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "range")

    def finish(batches):
        chunk, cuts, again = None, None, None
        for batch in batches:
            for i, place in enumerate(batch.column("range").to_pylist()):
                if place < 0:
                    if chunk is not None:
                        yield chunk.result(again, width)
                    chunk = Chunk({c: batch.column(c)[i].as_py() for c in _CHUNK}, width)
                    cuts, again = chunk.cuts(ranges), np.zeros(len(chunk.distinct), bool)
                else:
                    a, b = cuts[place], cuts[place + 1]
                    again[a:b] = np.unpackbits(np.frombuffer(batch.column("bits")[i].as_py(), np.uint8), count=b - a)
        if chunk is not None:
            yield chunk.result(again, width)

    return both.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept binary")


def repeat_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of ``strip_repeats``."""
    return strip_repeats(docs, width).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


class SuffixAutomaton:
    """All runs of words of a reference shard; documents of the shard are kept apart by unique words."""

    def __init__(self, texts: list[list[bytes]]):
        self.next, self.link, self.length, last = [{}], [-1], [0], 0
        for n, words in enumerate(texts):
            for word in [*words, n]:  # a number never equals a word
                last = self._extend(last, word)

    def _extend(self, last: int, word) -> int:
        made = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[p] + 1 < self.length[q]:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = q = copy
            self.link[made] = q
        return made

    def statistics(self, words: list[bytes]) -> np.ndarray:
        """For each word, how many words up to and with it occur together in the shard."""
        state, size, out = 0, 0, np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                size = 0
            out[i] = size
        return out


def strip_reference(docs: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): without the words of ``docs`` in spans of ``width`` or more words that ``reference`` (text) holds too."""
    spark = docs.sparkSession
    size = reference.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    if size > REFERENCE_WORDS:
        raise ValueError(f"the reference has {size} words; {REFERENCE_WORDS} may be broadcast")
    shards, room = [[]], SHARD_WORDS
    for row in reference.select(F.coalesce("text", F.lit("")).alias("text")).orderBy("text").collect():
        words = row["text"].encode().split()
        if len(words) > room and shards[-1]:
            shards.append([])
            room = SHARD_WORDS
        shards[-1].append(words)
        room -= len(words)
    sent = [spark.sparkContext.broadcast(SuffixAutomaton(s)) for s in shards]

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_py().split()
                gone = np.zeros(len(words), bool)
                for shard in sent:
                    sizes = shard.value.statistics(words)
                    ends = np.flatnonzero(sizes >= width)
                    gone |= covered(np.ones(len(ends), bool), ends - width + 1, len(words), width)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((doc, len(words), len(words) - len(kept), b" ".join(kept)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.int64(), pa.binary()])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


SQL = r"""
with t as (select doc_id, row_number() over () as d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select d, doc_id, len(w) n, unnest(w) word, unnest(range(1, len(w) + 1)) i, w from t),
g as (select d, doc_id, n, word, i, case when i + 34 <= n then md5(array_to_string(w[i:i + 34], ' ')) end h from p),
c as (select *, case when h is null then 0 else (count(*) over (partition by h) > 1)::int end again from g),
m as (select *, max(again) over (partition by d order by i rows between 34 preceding and current row) gone from c),
k as (select d, count(*) filter (gone = 1) r, string_agg(word, ' ' order by i) filter (gone = 0) kept from m group by d)
select t.doc_id, len(t.w) as n_words, coalesce(k.r, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from t left join k using (d)
"""
