"""Ranked lexical search by presence masks (operator 13).

Queries are a table of items, taken in blocks of bounded size; documents are all of a table. Pass one turns
blocks of documents into postings of the queries' terms, stored by Spark, and sums what scores need: the
documents, their terms, and each term's documents. Pass two takes a stored block at a time. For each item
the postings of its terms, one bit each, are summed to one mask per document; documents of equal masks are
one group, and a mask's maximum score is the sum of the largest score each of its terms reaches in the
block. Masks are scored exactly in order of falling maximum, until the ``top``-th exact score is above the
next maximum: no document of the masks that are left can enter the list. Blocks send their lists, at most
``top`` rows an item, and these are merged in two steps.
"""

from __future__ import annotations

import math
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panescan.llm.common import blocks as blocks_of
from panescan.llm.common import forget, keep

ITEM_BYTES = 8 << 20  # of the items' distinct terms, 16 bytes each besides their letters, in one block of items
DOCS, WORDS = 4096, 1 << 21  # documents, or words, of a block
LISTS = 64  # first step of the merge: lists of an item meet in so many groups
BITS = 52  # of a mask in one exact double
# Fixed value: what belongs to a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, once each; rows of one item_id are one item."""
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(docs, words, terms, df, data) of blocks of documents.

    ``docs`` counts those with a term, ``words`` all their terms; ``terms`` are the places in ``vocabulary``
    that occur, each in ``df`` documents; ``data`` holds ids, lengths and, by term, documents and counts.
    """
    places = {t.encode(): i for i, t in enumerate(vocabulary)}

    def run(batches):
        ids, missing, lengths, codes = [], [], [], []
        press = zstandard.ZstdCompressor(1).compress

        def block():
            n = np.array(lengths, np.int64)
            flat = np.concatenate(codes)
            owner = np.repeat(np.arange(len(n)), [len(c) for c in codes])
            hit = flat >= 0
            keys, tf = np.unique(flat[hit] * np.int64(len(n)) + owner[hit], return_counts=True)
            term, doc = np.divmod(keys, len(n))
            terms, df = np.unique(term, return_counts=True)
            parts = [np.array([len(n), len(keys)], np.int64), np.array(ids, np.int64), np.array(missing, np.int64), n, doc.astype(np.int64), tf.astype(np.int64)]
            data = press(np.concatenate(parts).tobytes())
            for held in (ids, missing, lengths, codes):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.array([terms.astype(np.int32)], pa.list_(pa.int32())), pa.array([df.astype(np.int32)], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                ["docs", "words", "terms", "df", "data"],
            )

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().translate(_TABLE).split()
                ids.append(0 if doc is None else doc)
                missing.append(doc is None)
                lengths.append(len(words))
                codes.append(np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words)))
                size += len(words)
                if len(ids) == DOCS or size >= WORDS:
                    yield block()
                    size = 0
        if ids:
            yield block()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "docs long, words long, terms array<int>, df array<int>, data binary")


def masks_of(bits: np.ndarray, docs: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks (rows of 0 and 1), and each matched document with the place of its mask.

    ``docs`` lists documents term by term, ``starts`` where each term begins; a sum of distinct powers of
    two is the union of one-bit maps.
    """
    words = []
    for at in range(0, len(starts) - 1, BITS):
        own = slice(starts[at], starts[min(at + BITS, len(starts) - 1)])
        words.append(np.bincount(docs[own], weights=np.exp2(bits[own] - at), minlength=size).astype(np.int64))
    matched = np.flatnonzero(np.any(words, 0))
    group = np.zeros(len(matched), np.int64)
    for word in words:
        values, place = np.unique(word[matched], return_inverse=True)
        _, first, group = np.unique(group * len(values) + place, return_index=True, return_inverse=True)
    rows = [((word[matched][first][:, None] >> np.arange(min(BITS, len(starts) - 1 - j * BITS))) & 1) for j, word in enumerate(words)]
    return np.concatenate(rows, 1), matched, group


def best_of(docs: np.ndarray, gains: np.ndarray, starts: np.ndarray, size: int, ids: np.ndarray, missing: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``top`` best of one item in a block: ``gains`` are what each posting adds."""
    lengths = np.diff(starts)
    bits = np.repeat(np.arange(len(lengths)), lengths)
    masks, matched, group = masks_of(bits, docs, starts, size)
    most = masks @ np.maximum.reduceat(gains, starts[:-1])
    falling = np.argsort(-most, kind="stable")
    members, cut = np.argsort(group, kind="stable"), np.r_[0, np.cumsum(np.bincount(group))]
    found, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(falling):
        if len(found) == top and most[falling[at]] < scores[-1]:
            break
        some, room = [], max(4 * top, at)
        while at < len(falling) and room > 0:
            mask = falling[at]
            some.append(matched[members[cut[mask] : cut[mask + 1]]])
            room -= len(some[-1])
            at += 1
        chosen = np.zeros(size, bool)
        chosen[np.concatenate(some)] = True
        own = chosen[docs]
        exact = np.bincount(docs[own], weights=gains[own], minlength=size).astype(np.int64)  # sums below 2^53
        new = np.flatnonzero(exact)
        found, scores = np.r_[found, new], np.r_[scores, exact[new]]
        order = np.lexsort((ids[found], missing[found], -scores))[:top]
        found, scores = found[order], scores[order]
    return found, scores


def _search(stored: DataFrame, vocabulary: list[str], items: list[tuple[int | None, list[int]]], top: int) -> DataFrame:
    """(item_id, doc_id, score) of each block's best documents for each item."""
    n_docs, n_words = stored.agg(F.sum("docs"), F.sum("words")).first()
    counts = stored.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).groupBy("e.terms").agg(F.sum("e.df").alias("df")).collect()  # at most the vocabulary
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts:
        weights[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    wanted = [(i, np.array(t, np.int64)) for i, t in items]

    def run(batches):
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for terms, df, data in zip(batch.column("terms"), batch.column("df"), batch.column("data")):
                terms, df = terms.values.to_numpy(), df.values.to_numpy()
                flat = np.frombuffer(unpress(data.as_buffer()), np.int64)
                size, n = flat[:2]
                ids, missing, lengths, docs, tf = np.split(flat[2:], np.cumsum([size, size, size, n]))
                gains = weights[np.repeat(terms, df)] * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + 90 * lengths * n_docs // n_words)[docs])) if n else tf
                starts = np.r_[0, np.cumsum(df.astype(np.int64))]
                local = np.full(len(weights), -1, np.int64)
                local[terms] = np.arange(len(terms))
                out = []
                for item, own in wanted:
                    own = local[own]
                    own = own[own >= 0]
                    if not len(own):
                        continue
                    many = df[own].astype(np.int64)
                    ends = np.r_[0, np.cumsum(many)]
                    at = np.arange(ends[-1]) + np.repeat(starts[own] - ends[:-1], many)
                    found, scores = best_of(docs[at], gains[at], ends, int(size), ids, missing, top)
                    out += [(item, None if missing[d] else int(ids[d]), int(s)) for d, s in zip(found, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["item_id", "doc_id", "score"])

    return stored.select("terms", "df", "data").mapInArrow(run, "item_id long, doc_id long, score long")


def _first(found: DataFrame, top: int, *by: Column | str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item, equal scores by doc_id, nulls last.

    A null text has no terms: such an item finds nothing, such a document is not found and not counted.
    Rows of one item_id, null or not, are one item; every row of documents is one, repeated rows and null
    doc_ids too. A very long text is taken whole. Other columns play no part. An empty table on either side
    gives no rows.
    """
    terms = keep(item_terms(items))
    weight = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    parts, out = blocks_of(weight, ITEM_BYTES), None
    for part in range(parts):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # ITEM_BYTES on average
        vocabulary = sorted({r["term"] for r in rows})
        place, wanted = {t: i for i, t in enumerate(vocabulary)}, {}
        for r in rows:
            wanted.setdefault(r["item_id"], []).append(place[r["term"]])
        stored = keep(postings(docs, vocabulary))
        lists = _search(stored, vocabulary, [(i, sorted(t)) for i, t in wanted.items()], top)
        lists = keep(_first(lists.withColumn("list", F.pmod(F.spark_partition_id(), F.lit(LISTS))), top, "item_id", "list").drop("rank", "list"))
        forget(stored)
        out = lists if out is None else out.unionByName(lists)
    return _first(out, top, "item_id").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
x as (select doc_id, len(w) n from d where len(w) > 0),
s as (select count(*) nn, sum(n)::bigint ll from x),
f as materialized (select doc_id, t, count(*) tf from (select doc_id, unnest(w) t from d) group by all),
g as (select t, count(*) df from f group by t),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
w as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint w from g, s),
m as (select doc_id, 10 + (90 * n * nn) // ll m from x, s),
c as (select item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
      from i join f on f.t = i.t join w on w.t = i.t join m on m.doc_id = f.doc_id group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from c where score > 0)
select * from r where rank <= 10
"""
