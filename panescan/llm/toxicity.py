"""Toxicity by a convolutional text classifier (operator 3), trained here in numpy.

A word is the sum of hashed embeddings: its own and those of its stems, its first letters, so that an
unseen ending of a known stem still counts. Filters of width one to three run over the whole text; each
keeps its largest value, and a logistic layer turns those into a score. A filter is a sum of one table
row per word in its window, so scoring looks rows up and adds them. Scores see the text alone.

Fitting learns from every labelled row that is not held out, but for each fifth by hashed id: those, all
of them, set the thresholds by language that ``flagged`` uses. The driver only finds a start, on SAMPLE rows
of each class. From it tasks learn on in parallel, each on its own rows, and what they move is averaged, an
embedding by how often each task met it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import partitions

SAMPLE = 2_000  # labelled documents of each class from which the start is found
SHARD = 2_000  # labelled documents of a task that learns on
CHECKS = 5  # each so many-th labelled document sets thresholds
BROADCAST_ROWS = 1_000_000  # more labels than this meet the documents by a shuffle
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
STEMS = (4, 5, 6, 8)  # letters of a word's stems
PARTS = 1 + len(STEMS)
STEPS, BATCH, RATE, SEED = 700, 32, 0.08, 3
WORDS = 200_000  # words whose table rows a worker remembers
TOGETHER = 40_000  # words scored, or learned from, at once
BLOCK = 512  # embeddings that are averaged together
CUT = 0.7
SIDES = "".join(chr(c) for c in range(0x250) if not chr(c).isalnum())


# a word's own bucket and those of its stems begin their checksums with a mark of their own
WHOLE, MARKS = crc32(b"w"), [(n, crc32(b"%d" % n)) for n in STEMS]


def features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its stems; bucket 0 stays zero."""
    word = word.lower().strip(SIDES)
    data = word.encode()
    if not data:
        return (0,) * PARTS
    size, text = len(word), data if len(word) == len(data) else None
    out = [1 + crc32(data, WHOLE) % (BUCKETS - 1)]
    for n, mark in MARKS:
        if size < n:
            out += [0] * (PARTS - len(out))
            break
        out.append(1 + crc32(text[:n] if text else word[:n].encode(), mark) % (BUCKETS - 1))
    return tuple(out)


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: np.ndarray  # DIM x (FILTERS for each place of each width)
    bias: np.ndarray  # FILTERS for each width
    weights: np.ndarray
    shift: float
    thresholds: dict[str, float]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """What each word adds to each place of each filter."""
        return self.embedding[codes].sum(1) @ self.filters

    @staticmethod
    def responses(rows: np.ndarray) -> np.ndarray:
        """Filter values at every place; the last words of the rows must be blanks."""
        out, at = [], 0
        for width in WIDTHS:
            total = rows[:, at : at + FILTERS].copy()
            for j in range(1, width):
                total[:-j] += rows[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            out.append(total)
            at += width * FILTERS
        return np.hstack(out)

    def largest(self, words: np.ndarray) -> np.ndarray:
        """Largest filter values of one text, given its words' rows."""
        if not len(words):
            return np.zeros(len(self.bias), np.float32)
        blank = np.zeros((len(WIDTHS) - 1, words.shape[1]), words.dtype)
        return self.responses(np.vstack([words, blank]))[: len(words)].max(0)

    def scores(self, largest: np.ndarray) -> np.ndarray:
        hidden = np.maximum(largest + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.shift, -30, 30)))


class Learner:
    """Moves a copy of a model by Adagrad; ``met`` counts how often each embedding was moved."""

    # where each filter's place lies in `filters`, and which word of the window it reads
    COLUMNS = [(w, j, sum(WIDTHS[:w]) * FILTERS + j * FILTERS) for w, width in enumerate(WIDTHS) for j in range(width)]

    def __init__(self, model: Model, sums: dict | None = None):
        self.model = replace(model, **{k: v.copy() for k, v in vars(model).items() if isinstance(v, np.ndarray)})
        self.sums = {k: v.copy() for k, v in sums.items()} if sums else {k: np.full_like(v, 1e-6) for k, v in vars(model).items() if isinstance(v, np.ndarray)} | {"shift": np.float64(1e-6)}
        self.met = np.zeros(BUCKETS, np.int64)

    def step(self, name, grad, at=slice(None)):
        self.sums[name][at] += grad * grad
        getattr(self.model, name)[at] -= RATE * grad / np.sqrt(self.sums[name][at])

    def peaks(self, codes: np.ndarray, starts: list[int]) -> np.ndarray:
        """Where each filter is largest in each of the texts that start at ``starts``; a text ends with blanks."""
        model, blanks = self.model, len(WIDTHS) - 1
        ends = [*starts[1:], len(codes)]
        if len(codes) <= 2 * TOGETHER:
            values = model.responses(self.words(codes) @ model.filters)
            return np.vstack([a + values[a : max(a + 1, b - blanks)].argmax(0) for a, b in zip(starts, ends)])
        best = []
        for a, b in zip(starts, ends):
            at, top = np.full(len(model.bias), a), np.full(len(model.bias), -np.inf)
            for first in range(a, max(a + 1, b - blanks), TOGETHER):
                stop = min(first + TOGETHER + blanks, b)
                values = model.responses(self.words(codes[first:stop]) @ model.filters)[: max(1, stop - first - blanks)]
                own = values.max(0)
                at, top = np.where(own > top, first + values.argmax(0), at), np.maximum(own, top)
            best.append(at)
        return np.vstack(best)

    def words(self, codes: np.ndarray) -> np.ndarray:
        total = self.model.embedding[codes[:, 0]]
        for part in range(1, PARTS):
            total += self.model.embedding[codes[:, part]]
        return total

    def learn(self, texts: list[np.ndarray], toxic: np.ndarray) -> None:
        """One step on (words x PARTS) bucket arrays."""
        model, blanks = self.model, np.zeros((len(WIDTHS) - 1, PARTS), np.int32)
        codes = np.vstack([x for t in texts for x in (t, blanks)])
        best = self.peaks(codes, (np.cumsum([len(t) + len(blanks) for t in texts]) - [len(t) + len(blanks) for t in texts]).tolist())
        places = [np.minimum(best[:, w * FILTERS : (w + 1) * FILTERS] + j, len(codes) - 1) for w, j, _ in self.COLUMNS]
        windows = [self.words(codes[p.ravel()]).reshape(*p.shape, DIM) for p in places]
        largest = np.tile(model.bias, (len(texts), 1))
        for (w, _, at), words in zip(self.COLUMNS, windows):
            largest[:, w * FILTERS : (w + 1) * FILTERS] += np.einsum("nfd,df->nf", words, model.filters[:, at : at + FILTERS])
        hidden = np.maximum(largest, 0)
        error = (model.scores(largest - model.bias) - toxic).astype(np.float32) / len(texts)
        back = error[:, None] * model.weights * (largest > 0)
        self.step("weights", hidden.T @ error + 1e-4 * model.weights)
        self.sums["shift"] += float(error.sum()) ** 2
        model.shift -= RATE * float(error.sum()) / np.sqrt(self.sums["shift"])
        self.step("bias", back.sum(0))
        grad, moved, touched = np.zeros_like(model.filters), [], []
        for (w, _, at), place, words in zip(self.COLUMNS, places, windows):
            part = back[:, w * FILTERS : (w + 1) * FILTERS]
            grad[:, at : at + FILTERS] = np.einsum("nfd,nf->df", words, part)
            moved.append((part[:, :, None] * model.filters[:, at : at + FILTERS].T[None]).reshape(-1, DIM))
            touched.append(codes[place].reshape(-1, PARTS))
        self.step("filters", grad + 1e-4 * model.filters)
        ids, where = np.unique(np.concatenate(touched), return_inverse=True)
        sparse = np.zeros((len(ids), DIM), np.float32)
        np.add.at(sparse, where.reshape(-1), np.repeat(np.concatenate(moved), PARTS, 0))
        sparse[ids == 0] = 0
        self.step("embedding", sparse, ids)
        self.met[ids] += 1


def fit(texts: list[np.ndarray], toxic: np.ndarray) -> Learner:
    """A start: what is learned from (words x PARTS) bucket arrays of a few documents."""
    rng = np.random.default_rng(SEED)
    places = sum(WIDTHS) * FILTERS
    model = Model(
        (rng.normal(0, 0.1, (BUCKETS, DIM))).astype(np.float32),
        rng.normal(0, 0.3, (DIM, places)).astype(np.float32),
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        -1.0,
        {},
    )
    model.embedding[0] = 0
    if len(set(toxic.tolist())) < 2:
        model.shift = -30.0 if not toxic.any() else 30.0
        model.weights[:] = 0
        return Learner(model)
    learner, parts = Learner(model), max(1, len(texts) // BATCH)
    for _ in range(-(-STEPS // parts)):
        for some in np.array_split(rng.permutation(len(texts)), parts):
            learner.learn([texts[i] for i in some], toxic[some])
    return learner


TRIES = np.round(np.arange(0.5, 0.901, 0.02), 2)


def best_threshold(counts: dict[tuple[int, int], int]) -> float:
    """The middle of the thresholds in TRIES of the best F1; CUT where one class is rare.

    ``counts`` has the documents by class and by the number of TRIES that their score reaches.
    """
    reached = np.array([[sum(n for (toxic, most), n in counts.items() if toxic == c and most > i) for i in range(-1, len(TRIES))] for c in (0, 1)], float)
    if reached[:, 0].min() < 10:
        return CUT
    clean, toxic = reached[:, 1:]
    hits = 2 * toxic / (toxic + clean + reached[1, 0])
    return float(np.median(TRIES[hits >= hits.max() - 1e-9]))


def _codes(text: str) -> np.ndarray:
    words = text.split()
    known = {w: features(w) for w in set(words)}
    return np.array([known[w] for w in words], np.int32).reshape(-1, PARTS)


def held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1


def _coded(rows: DataFrame, shape: str) -> DataFrame:
    """``rows`` with the buckets of their words instead of ``text``; texts without words go, as they teach nothing."""
    names = [c for c in rows.columns if c != "text"]

    def code(batches):
        for batch in batches:
            data = pa.array([_codes(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            coded = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), data], [*names, "data"])
            yield coded.filter(pa.array([len(d) > 0 for d in data.to_pylist()], pa.bool_()))

    return rows.mapInArrow(code, f"{shape}, data binary")


def learned(rows: DataFrame, start: Learner, tasks: int) -> Model:
    """The start's model after every one of ``rows`` (doc_id, text, toxic) moved it in one of ``tasks`` tasks."""
    model, sums = start.model, start.sums
    dense = lambda m: np.concatenate([m.filters.ravel(), m.bias, m.weights, [m.shift]]).astype(float)
    order = F.xxhash64("doc_id", F.lit(SEED))

    def learn(batches):
        learner, number, texts, toxic, room = Learner(model, sums), 0, [], [], TOGETHER
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                codes = _codes(text.as_py())
                if not len(codes):
                    continue
                texts.append(codes)
                toxic.append(label)
                room -= len(codes)
                if len(texts) == BATCH or room <= 0:
                    learner.learn(texts, np.array(toxic))
                    number, texts, toxic, room = number + len(texts), [], [], TOGETHER
        if texts:
            learner.learn(texts, np.array(toxic))
            number += len(texts)
        moved, out = learner.model.embedding - model.embedding, []
        for block in np.unique(np.flatnonzero(learner.met) // BLOCK).tolist():
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            met = learner.met[at].astype(float)
            out.append((block, np.hstack([met[:, None], moved[at] * met[:, None]]).tobytes()))
        if number:
            out.append((-1, (np.r_[1, dense(learner.model) - dense(model)] * number).tobytes()))
        part = TaskContext.get().partitionId()
        columns = [pa.array([b for b, _ in out], pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "part", "data"])

    def total(batches):
        at, held = None, None
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                values = np.frombuffer(data.as_buffer())
                if block != at and at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["block", "data"])
                at, held = block, held + values if block == at else values
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["block", "data"])

    dealt = rows.select("doc_id", "text", "toxic").repartition(tasks, order).sortWithinPartitions(order, "doc_id", "toxic", "text")
    moved = dealt.mapInArrow(learn, "block int, part int, data binary")
    moved = moved.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "part")
    done = Learner(model).model
    for block, data in moved.mapInArrow(total, "block int, data binary").collect():  # one model, whatever the rows
        values = np.frombuffer(data)
        if block < 0:
            sizes = np.cumsum([model.filters.size, model.bias.size, model.weights.size])
            parts = np.split(dense(model) + values[1:] / values[0], sizes)
            done.filters, done.bias, done.weights = (p.reshape(x.shape).astype(np.float32) for p, x in zip(parts, (model.filters, model.bias, model.weights)))
            done.shift = float(parts[3][0])
        else:
            met, sums_of = np.split(values.reshape(-1, 1 + DIM), [1], 1)
            done.embedding[block * BLOCK : (block + 1) * BLOCK] += (sums_of / np.maximum(met, 1)).astype(np.float32)
    return done


def thresholds(rows: DataFrame, model: Model) -> dict[str, float]:
    """The best threshold of each language over all ``rows`` (text, lang, toxic); only counts come to the driver."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            most = np.searchsorted(TRIES, scorer(batch.column("text").to_pylist()), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(most)], ["lang", "toxic", "most"])

    found = rows.where("lang is not null").select("text", "lang", "toxic").mapInArrow(run, "lang string, toxic int, most int")
    counts: dict[str, dict] = defaultdict(dict)
    for lang, toxic, most, n in found.groupBy("lang", "toxic", "most").count().collect():  # 44 rows a language at most
        counts[lang][toxic, most] = n
    return {lang: best_threshold(own) for lang, own in sorted(counts.items())}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows that are not held out. Null labels and ids count for nothing, nor do texts without words."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    usable = usable.withColumn("checks", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(CHECKS)) == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))

    def labelled(some: DataFrame, few: bool) -> DataFrame:
        return rows.join(F.broadcast(some) if few else some, "doc_id")

    learning = usable.where("not checks").drop("checks")
    picked = [learning.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE) for c in (1, 0)]
    first = _coded(labelled(picked[0].unionByName(picked[1]), True).select("doc_id", "text", "toxic"), "doc_id long, toxic int").collect()
    first.sort(key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"], r["toxic"], len(r["data"])))
    start = fit([np.frombuffer(r["data"], np.int32).reshape(-1, PARTS) for r in first], np.array([r["toxic"] for r in first], int))
    if len({r["toxic"] for r in first}) < 2:
        return start.model
    number = learning.count()
    few = number <= BROADCAST_ROWS  # 24 bytes each
    model = learned(labelled(learning, few), start, -(-number // SHARD))
    model.thresholds = thresholds(labelled(usable.where("checks").drop("checks"), few), model)
    return model


class Scorer:
    """Scores lists of texts; remembers, within a bound, what a word adds to the filters."""

    def __init__(self, model: Model):
        self.model, self.known = model, {"": 0}
        self.rows = np.zeros((WORDS + 1, sum(WIDTHS) * FILTERS), np.float32)

    def learn(self, flat: list[str]) -> None:
        words = set(flat)
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > len(self.rows):  # what is met again now stays, all else is forgotten
            kept = [w for w in words.intersection(self.known) if w]
            rows = self.rows[[self.known[w] for w in kept]]
            if len(kept) + len(new) >= len(self.rows):  # one text with more words than are remembered
                self.rows = np.zeros((len(kept) + len(new) + 1, self.rows.shape[1]), np.float32)
            self.rows[1 : len(kept) + 1] = rows
            self.known = {"": 0} | dict(zip(kept, range(1, len(kept) + 1)))
        if new:
            n = len(self.known)
            self.rows[n : n + len(new)] = self.model.rows(np.array([features(w) for w in new]))
            self.known.update(zip(new, range(n, n + len(new))))

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            some, room = [], TOGETHER
            while at < len(texts) and (room > 0 or not some):
                some.append((texts[at] or "").split() + [""] * (len(WIDTHS) - 1))
                room -= len(some[-1])
                at += 1
            flat = [w for words in some for w in words]
            self.learn(flat)
            ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            counts = np.array([len(words) for words in some])
            starts, blanks = np.cumsum(counts) - counts, len(WIDTHS) - 1
            # windows start at words only; every other segment holds the blanks
            spans = np.stack([starts, starts + counts - blanks], 1).ravel()
            largest = np.maximum.reduceat(Model.responses(self.rows[ids]), spans, 0)[::2]
            largest[counts == blanks] = 0
            out.append(self.model.scores(largest).astype(float))
        return np.concatenate(out)

    def limits(self, langs: list[str | None]) -> np.ndarray:
        return np.array([self.model.thresholds.get(x, CUT) for x in langs], float)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, flagged of every whole text.

    A null or empty text gets the score of no words. Unknown or null languages get the threshold 0.7.
    Repeated rows are scored each; a null doc_id is not held out. Other columns play no part.
    """

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores, limits = scorer(batch.column("text").to_pylist()), scorer.limits(batch.column("lang").to_pylist())
            columns = [pa.array(scores), pa.array((scores >= CUT).astype(np.int32)), pa.array(limits), pa.array((scores >= limits).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "score", "predicted", "lang_threshold", "flagged"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, lang_threshold double, flagged int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts whose score reaches their language's threshold; rows and columns stay as they were."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            clean = scorer(batch.column("text").to_pylist()) < scorer.limits(batch.column("lang").to_pylist())
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
