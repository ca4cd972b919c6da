"""Collocations by stripes (operator 11).

A stripe is a prefix with a counter of the words that follow it. Tasks count stripes over blocks of
text, stripes of one prefix are merged element by element, and what is merged gives the extensions of the
prefix with their counts, the totals that scores divide by, and the largest extension of each phrase.

Only what can still become a candidate is counted, and no list of words or phrases is broadcast:

* blocks of text become codes into the block's own words, stored once;
* the words of all blocks are summed, and each block is told which of its words are frequent enough;
* stripes of one word hold only frequent words; merged, each block is told which pairs are frequent enough;
* stripes of a pair hold only words that make a frequent pair with the pair's second word. A phrase occurs
  no more often than any part of it, so nothing is lost.

Words and stripes are dealt to buckets whose number follows the input; a hot prefix is cut into slices by
the next word, as many as its count asks for, so a bucket is bounded. What a block sends to a bucket, or a
bucket to a block, is one packed row: there are never more rows than entries, and few while blocks are few.
"""

from __future__ import annotations

import string
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panescan.llm.common import forget, keep

BLOCK = 1 << 21  # words of a block; one document may go beyond
SLICE = 200_000  # occurrences of a prefix that meet in one slice
BUCKET = 1 << 20  # occurrences that are merged at once
# What ends a piece, and what parts its words.
ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", "\t "
_END = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans((string.ascii_uppercase + ENDS + "\t").encode(), string.ascii_lowercase.encode() + _END * len(ENDS) + b" ")
_ASKS = "lang string, block long, bucket long, data binary"
_WORDS = "lang string, block long, data binary, id long, word string, f long"
_PHRASES = "lang string, block long, data binary, prefix long, prefix_f long, next long, id long, f long"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, with ``_END`` wherever a piece ends."""
    return (text.translate(_TABLE).replace(_END, b" " + _END + b" ") + b" " + _END).split()


def _packed(*columns: np.ndarray, text: bytes = b"") -> bytes:
    """Whole-number columns of one length, byte planes apart so that they compress, and some bytes."""
    planes = [np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    head = np.array([len(columns), len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(planes) + text)


def _unpacked(data: pa.Scalar) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data.as_buffer())
    width, n = np.frombuffer(raw, np.int64, 2).tolist()
    planes = np.frombuffer(raw, np.uint8, 8 * width * n, 16).reshape(width, 8, n)
    return [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes], raw[16 + 8 * width * n :]


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _runs(values: np.ndarray) -> list[tuple[int, slice]]:
    """(value, its slice) of sorted values."""
    cuts = np.r_[0, np.flatnonzero(np.diff(values)) + 1, len(values)].tolist() if len(values) else [0]
    return [(int(values[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ (x.astype(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, n, words, codes): the words of some documents of one language; code 0 ends a piece."""

    def run(batches):
        part, numbers, press = TaskContext.get().partitionId(), count(), zstandard.ZstdCompressor(1).compress
        held: dict[str, tuple[dict, list]] = {}

        def rows():
            out = []
            for lang, (index, codes) in held.items():
                codes = np.concatenate(codes)
                out.append((part << 32 | next(numbers), lang, int((codes > 0).sum()), press(b" ".join(index)), press(codes.tobytes())))
            held.clear()
            return _table(out, "block long, lang string, n long, words binary, codes binary").to_batches()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    index = defaultdict(count().__next__)
                    held[lang] = (index, [np.array([index[_END]], np.int32)])
                index, codes = held[lang]
                words = words_of(text.as_py())
                codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK:
                    yield from rows()
                    size = 0
        yield from rows()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "block long, lang string, n long, words binary, codes binary")


def ask_words(made: DataFrame, buckets: int) -> DataFrame:
    """What each block sends to each bucket: words, their codes and counts."""

    def run(batches):
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                lang, block = batch.column("lang")[row].as_py(), batch.column("block")[row].as_py()
                words = unpress(batch.column("words")[row].as_buffer()).split(b" ")
                counts = np.bincount(np.frombuffer(unpress(batch.column("codes")[row].as_buffer()), np.int32), minlength=len(words))
                seed = xxhash.xxh32_intdigest(lang)
                places = np.fromiter((xxhash.xxh64_intdigest(w, seed) % buckets for w in words), np.int64, len(words))
                order = np.argsort(places, kind="stable")
                order = order[order > 0]  # the mark of a piece's end is no word
                out = []
                for bucket, own in _runs(places[order]):
                    codes = order[own]
                    out.append((lang, block, bucket, _packed(codes, counts[codes], text=b" ".join([words[i] for i in codes.tolist()]))))
                yield from _table(out, _ASKS).to_batches()

    return made.select("lang", "block", "words", "codes").mapInArrow(run, _ASKS)


def merge_words(asks: DataFrame, least: int) -> DataFrame:
    """Words that occur ``least`` times or more, ``block`` null; and for each block which of its codes these are, packed."""

    def run(rows):
        bucket = rows.column("bucket")[0].as_py()
        totals: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        asked = []
        for lang, block, data in zip(rows.column("lang").to_pylist(), rows.column("block").to_pylist(), rows.column("data")):
            (codes, counts), text = _unpacked(data)
            words, total = text.split(b" "), totals[lang]
            asked.append((lang, block, codes, words))
            for w, c in zip(words, counts.tolist()):
                total[w] += c
        ids, out = count(bucket << 32), []
        known = {lang: {w: (next(ids), f) for w, f in sorted(total.items()) if f >= least} for lang, total in totals.items()}
        for lang, own in known.items():
            out += [(lang, None, None, i, w.decode(), f) for w, (i, f) in own.items()]
        for lang, block, codes, words in asked:
            found = [known[lang].get(w) for w in words]
            left = np.array([x is not None for x in found], bool)
            if left.any():
                pairs = np.array([x for x in found if x is not None], np.int64)
                out.append((lang, block, _packed(codes[left], pairs[:, 0], pairs[:, 1]), None, None, None))
        return _table(out, _WORDS)

    return asks.groupBy("bucket").applyInArrow(run, _WORDS)


def _told(replies: pa.Table, width: int) -> list[np.ndarray]:
    parts = [_unpacked(d)[0] for d in replies.column("data")]
    return [np.concatenate([p[i] for p in parts]) for i in range(width)]


def _stripes(lang: str, block: int, buckets: int, prefix: np.ndarray, after: np.ndarray, ids: np.ndarray, f: np.ndarray, words: np.ndarray) -> list[tuple]:
    """One row per bucket: ``prefix`` are places in ``ids`` and ``f``, ``after`` places in ``words``."""
    keys, counts = np.unique(prefix * np.int64(len(words)) + after, return_counts=True)
    p, q = np.divmod(keys, max(1, len(words)))
    prefix, nexts = ids[p], words[q]
    piece = _mixed(nexts) % (f[p] // SLICE + 1).astype(np.uint64)
    bucket = (_mixed(_mixed(prefix) + piece) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((nexts, prefix, bucket))
    columns = [c[order] for c in (prefix, f[p], nexts, counts)]
    return [(lang, block, at, _packed(*(c[own] for c in columns))) for at, own in _runs(bucket[order])]


def ask_pairs(made: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """Stripes of single words; and one row per block, ``bucket`` null, with its state: its frequent words and their places."""

    def run(own, words):
        if not own.num_rows or not words.num_rows:
            return _table([], _ASKS)
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(own.column("codes")[0].as_buffer()), np.int32)
        pos, ids, f = _told(words, 3)
        places = np.full(codes.max() + 1, -1, np.int64)
        places[pos] = np.arange(len(pos))
        seq = places[codes]
        ok = (seq[:-1] >= 0) & (seq[1:] >= 0)
        # words without a frequent neighbour on either side are in no longer phrase
        state = np.where(np.r_[False, ok] | np.r_[ok, False], seq, -1)
        state = state[np.r_[True, (state[1:] >= 0) | (state[:-1] >= 0)]].astype(np.int32)
        lang, block = own.column("lang")[0].as_py(), own.column("block")[0].as_py()
        rows = _stripes(lang, block, buckets, seq[:-1][ok], seq[1:][ok], ids, f, ids)
        return _table([*rows, (lang, block, None, _packed(ids, text=state.tobytes()))], _ASKS)

    return made.select("block", "lang", "codes").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, _ASKS)


def merge(stripes: DataFrame, least: int, replies: bool) -> DataFrame:
    """Merged stripes: extensions (lang, prefix, prefix_f, next, id, f) with f >= least, ``block`` null.

    With ``replies`` also, for each row that came in, what of it is left, packed, under its block.
    """

    def run(rows):
        parts = [_unpacked(d)[0] for d in rows.column("data")]
        prefix, prefix_f, nexts, counts = (np.concatenate([p[i] for p in parts]) for i in range(4))
        names, p = np.unique(prefix, return_inverse=True)
        others, q = np.unique(nexts, return_inverse=True)
        pairs, first, at = np.unique(p * np.int64(len(others)) + q, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(pairs)).astype(np.int64)  # sums below 2^53
        left = total >= least
        # a bucket is one group of one task, so its number makes the ids unique
        ids = np.full(len(pairs), -1, np.int64)
        ids[left] = (rows.column("bucket")[0].as_py() << 32) + np.arange(left.sum())
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        keep_, n = first[left], int(left.sum())
        langs = rows.column("lang").combine_chunks().take(pa.array(owner[keep_]))
        columns = [langs, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *(pa.array(c) for c in (prefix[keep_], prefix_f[keep_], nexts[keep_], ids[left], total[left]))]
        out = [pa.table(columns, [c.split()[0] for c in _PHRASES.split(", ")])]
        if replies:
            entries = np.flatnonzero(left[at])
            of = at[entries]
            sent = [prefix[entries], nexts[entries], ids[of], total[of]]
            blocks_, lang = rows.column("block").to_pylist(), rows.column("lang").to_pylist()
            out.append(_table([(lang[i], blocks_[i], _packed(*(c[own] for c in sent)), *[None] * 5) for i, own in _runs(owner[entries])], _PHRASES))
        return pa.concat_tables(out)

    return stripes.groupBy("bucket").applyInArrow(run, _PHRASES)


def ask_triples(states: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """Stripes of pairs, over each block's state and the pairs it was told."""

    def run(own, pairs):
        if not own.num_rows or not pairs.num_rows:
            return _table([], _ASKS)
        (words,), text = _unpacked(own.column("data")[0])
        seq, n = np.frombuffer(text, np.int32).astype(np.int64), len(words)
        prefix, nexts, ids, f = _told(pairs, 4)
        order = np.argsort(words)
        p, q = (order[np.searchsorted(words, c, sorter=order)] for c in (prefix, nexts))
        keys = p * np.int64(n) + q
        sort = np.argsort(keys)
        keys, ids, f = keys[sort], ids[sort], f[sort]
        here = np.where((seq[:-1] >= 0) & (seq[1:] >= 0), seq[:-1] * np.int64(n) + seq[1:], -1)
        at = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
        pair = np.where(keys[at] == here, at, -1)
        ok = (pair[:-1] >= 0) & (pair[1:] >= 0)
        return _table(_stripes(own.column("lang")[0].as_py(), own.column("block")[0].as_py(), buckets, pair[:-1][ok], seq[2:][ok], ids, f, words), _ASKS)

    return states.select("block", "lang", "data").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, _ASKS)


def _score(a: str, left: str, right: str) -> Column:
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({wide(a)} * {wide(a)} as decimal(31,0))) div cast({wide(left)} * {wide(right)} as decimal(38,0))")


def collocations(docs: DataFrame, least: int = 10, overlap: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to 3 words.

    Phrases occur within pieces and count as often as they occur; candidates occur ``least`` times or more.
    The score is the least over the cuts of floor(1000000 a a / (l r)), in exact decimals. A candidate goes
    if a longer one that holds it occurs at least ``overlap`` percent as often. Ties in score and a go by
    the bytes of the phrase. A null text is empty, a null language is ``und``; repeated rows and null ids
    count each; a very long text is one block of its own. Other columns play no part. An empty table, or
    one without a candidate, gives no rows.
    """
    made = keep(blocks(docs))
    totals = keep(made.groupBy("lang").agg(F.sum("n").alias("n")))
    buckets = int(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET + 1
    told = lambda df: df.where("block is not null").select("block", "data")
    known = keep(merge_words(ask_words(made, buckets), least))
    words = known.where("block is null").select("id", "word", "f")

    first = keep(ask_pairs(made, told(known), buckets))
    forget(made)
    merged = keep(merge(first.where("bucket is not null"), least, True))
    pairs = merged.where("block is null").join(words.select(F.col("id").alias("next"), F.col("f").alias("r")), "next")
    pairs = keep(pairs.select("lang", "id", F.col("prefix").alias("w1"), F.col("next").alias("w2"), F.col("f").alias("a"), F.col("prefix_f").alias("l"), "r"))
    triples = keep(merge(ask_triples(first.where("bucket is null"), told(merged), buckets), least, False))
    forget(first)
    forget(merged)
    triples = triples.select("lang", F.col("prefix").alias("id"), F.col("next").alias("w3"), F.col("f").alias("a"), F.col("prefix_f").alias("l2"))

    rest = pairs.select(F.col("id").alias("rest"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    triples = keep(triples.join(pairs.select("id", "w1", "w2", F.col("l").alias("l1")), "id").join(rest, ["w2", "w3"]))
    one, two = _score("a", "l1", "r1"), _score("a", "l2", "r2")
    cut = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    long = triples.withColumn("s1", one).withColumn("s2", two).select("lang", "w1", "w2", "w3", "a", cut("l1", "l2").alias("l"), cut("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    held = triples.select("id", "a").unionByName(triples.select(F.col("rest").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("longest"))
    short = pairs.join(held, "id", "left").where((F.col("longest").isNull()) | (F.col("longest") * 100 < F.col("a") * overlap))
    short = short.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", _score("a", "l", "r").alias("score"))

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = keep(short.unionByName(long).withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"))
    for w in ("w1", "w2", "w3"):
        found = found.join(words.select(F.col("id").alias(w), F.col("word").alias(f"{w}_text")), w, "left")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("phrase", F.concat_ws(" ", "w1_text", "w2_text", "w3_text")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from d),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
n as (select lang, sum(len(w))::bigint n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) g from w, (values (1), (2), (3)) v(k) where len(w) >= k),
f as materialized (select lang, k, g, count(*) f from g group by all),
q as materialized (select lang, k, g, f a, cut, g[1:cut] x, g[cut + 1:] y from f, (select unnest([1, 2]) cut) where k >= 2 and f >= 10 and cut < k),
c as (select q.lang, q.k, q.g, a, x.f l, y.f r, cut, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) score
      from q join f x on x.lang = q.lang and x.g = q.x join f y on y.lang = q.lang and y.g = q.y),
s as (select lang, k, g, a, arg_min({'l': l, 'r': r, 's': score}, score * 10 + cut) b from c group by all),
h as (select lang, g, max(a) m from (select lang, g[1:2] g, a from s where k = 3 union all select lang, g[2:3], a from s where k = 3) group by all),
z as (select s.lang, array_to_string(s.g, ' ') phrase, a, b.l l, b.r r, b.s::bigint score from s left join h on h.lang = s.lang and h.g = s.g where h.m is null or 100 * h.m < 50 * a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select o.lang, o.rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where o.rank <= 2000
"""
