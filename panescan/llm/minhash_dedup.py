"""Near-dedup by HyperMinHash (operator 9).

A register is the least value of one hash function over a document's shingles, kept as the number of
leading zeros and ten bits of mantissa: two bytes. Four registers, eight bytes, are a band; documents
that share a band value are candidates. A pair goes on if the share of equal registers, corrected for
chance collisions of compressed registers, is not far below the threshold, and is then confirmed on the
full shingle sets.

No bucket is expanded into its pairs:

* documents of equal sets are one row from the start;
* round one links every document to the first of one of its buckets, the one it shares most bands with,
  and contracts what is confirmed into components;
* round two takes only buckets that still hold several components. The members outside a bucket's
  largest component are compared with all members of buckets around that component, block against
  block, sizes of intersections by one matrix product, and a pair of blocks returns a star forest. After
  it, no two documents that share a band and are similar are in different components.

Round one deals sets by (first document, slice): each set travels once, and a hub is cut into slices.
Round two cuts both sides into blocks of bounded shingles; a set travels once per block of the other side.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import keep, partitions
from panescan.llm.components import components
from panescan.llm.embedding_dedup import join_labels

WORDS, BANDS, ROWS = 5, 32, 4
REGISTERS = BANDS * ROWS
PERCENT = 75
MARGIN = 0.23  # six standard deviations of the estimate at the threshold
BLOCK = 400_000  # shingles of a block of round two
TOGETHER = 100_000  # shingles of the sets multiplied at once
CELLS = 1 << 22  # pairs of sets judged at once: sets of few shingles are many in a block
SLICE = 256  # documents that are compared with one copy of a hub
BROADCAST_ROWS = 1_000_000  # more routes than this meet the documents by a shuffle
CHUNK = 1 << 15  # shingles hashed at once

_PRIME, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FUNCTIONS = np.random.default_rng(9).integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text in UTF-8; bytes.lower() and split() know ASCII only."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(codes))
    total = np.full(len(codes) - width + 1, np.uint64(width))
    for j in range(width):
        total = total * _PRIME + codes[j : len(codes) - width + 1 + j]
    return np.unique(_mixed(total))


def registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least value of each hash function."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), CHUNK):
        least = np.minimum(least, (_FUNCTIONS[:, None] * values[at : at + CHUNK]).min(1))
    part, power = np.frexp((least >> np.uint64(12)).astype(float))
    zeros = np.where(part > 0, 52 - power, 52)
    mantissa = np.where(part > 0, (part * 2 - 1) * 1024, 0)
    return (zeros.astype(np.uint16) << np.uint16(10)) | mantissa.astype(np.uint16)


@lru_cache(1)
def collision_table() -> np.ndarray:
    """Chance that a register of two disjoint sets agrees, by the binary logarithms of their sizes."""
    zeros, mantissa = np.arange(53)[:, None], np.arange(1024)
    low = (2.0 ** -(zeros + 1) * (1 + mantissa / 1024)).ravel()
    high = low + np.repeat(2.0 ** -(np.arange(53) + 1) / 1024, 1024)
    sizes = 2.0 ** np.arange(26)[:, None]
    share = np.exp(sizes * np.log1p(-low)) - np.exp(sizes * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return share @ share.T


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard of register rows, corrected for chance collisions."""
    equal = (a == b).mean(1)
    chance = collision_table()[np.log2(n).astype(int).clip(0, 25), np.log2(m).astype(int).clip(0, 25)]
    return (equal - chance) / (1 - chance)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a column that numbers the rows, and its name: ids and texts may repeat, numbers don't."""
    name = "row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return keep(docs.withColumn(name, F.monotonically_increasing_id())), name


def sketch(texts: DataFrame) -> DataFrame:
    """(row, doc_id, n, lo, hi, bands): size, digest and bands of the set of each of ``texts`` (row, doc_id, text); bands are null for empty sets."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                bands = registers(found).view(np.int64).tolist() if len(found) else None
                out.append((len(found), int(found.sum().astype(np.int64)), int(_mixed(found + _PRIME).sum().astype(np.int64)), bands))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds))], ["row", "doc_id", "n", "lo", "hi", "bands"])

    return texts.mapInArrow(run, "row long, doc_id long, n long, lo long, hi long, bands array<long>")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose corrected estimate is not far below it."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("bands").alias("ab"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("bands").alias("bb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * PERCENT)

    def run(batches):
        for batch in batches:
            x, y = (np.array(batch.column(c).flatten()).view(np.uint16).reshape(-1, REGISTERS) for c in ("ab", "bb"))
            sizes = (np.array(batch.column(c)) for c in ("an", "bn"))
            go = estimate(x, y, *sizes) >= PERCENT / 100 - MARGIN if len(x) else []
            yield batch.select(["a", "b"]).filter(pa.array(go, pa.bool_()))

    return both.select("a", "b", "an", "bn", "ab", "bb").mapInArrow(run, "a long, b long")


def confirm(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows that are similar on full sets. Texts are read again; each set travels once per pair's hub slice."""
    spark = texts.sparkSession
    hubs = pairs.groupBy("a").agg((F.floor(F.count("*") / SLICE) + 1).cast("int").alias("slices"))
    hubs = keep(hubs)
    members = pairs.join(hubs, "a").select(F.col("b").alias("row"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"))
    copies = hubs.select(F.col("a").alias("row"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"))
    routes = keep(members.unionByName(copies))
    if routes.count() <= BROADCAST_ROWS:  # 24 bytes each
        routes = F.broadcast(routes)

    def sets(batches):
        for batch in batches:
            data = pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "hub", "slice", "kind")] + [data], ["row", "hub", "slice", "kind", "data"])

    dealt = texts.join(routes, "row").select("row", "hub", "slice", "kind", "text").mapInArrow(sets, "row long, hub long, slice int, kind int, data binary")
    dealt = dealt.repartition(partitions(spark), "hub", "slice").sortWithinPartitions("hub", "slice", "kind")

    def compare(batches):
        at, own = None, None
        for batch in batches:
            a, b = [], []
            for row, hub, slice_, kind, data in zip(*(batch.column(c) for c in ("row", "hub", "slice", "kind", "data"))):
                values = np.frombuffer(data.as_buffer(), np.uint64)
                where = (hub.as_py(), slice_.as_py())
                if kind.as_py() == 0:
                    at, own = where, values.copy()
                elif where == at:
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    if 100 * both >= PERCENT * (len(own) + len(values) - both):
                        a.append(where[0])
                        b.append(row.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct sets, over the values that occur on both sides."""
    total = np.zeros((len(left), len(right)))
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return owner[hit][order], at[hit][order]

    (lo, lp), (ro, rp) = places(left), places(right)
    width = max(1, 2_000_000 // (len(left) + len(right)))  # columns held dense at once
    for at in range(0, len(shared), width):
        dense = []
        for owner, place, n in ((lo, lp, len(left)), (ro, rp, len(right))):
            a, b = np.searchsorted(place, [at, at + width])
            block = np.zeros((n, min(width, len(shared) - at)), np.float32)
            block[owner[a:b], place[a:b] - at] = 1
            dense.append(block)
        total += dense[0] @ dense[1].T
    return total


def links(own_ids: list[int], own: list[np.ndarray], ids: list[int], others: list[np.ndarray]) -> pa.RecordBatch:
    """Links (a, b) that connect what is similar among ``own`` and ``others``: a star for each component. Pairs are judged CELLS at a time."""
    nodes, place = np.unique(np.r_[np.array(own_ids), np.array(ids)], return_inverse=True)
    labels, left, right = np.arange(len(nodes)), place[: len(own)], place[len(own) :]
    sizes, step = np.array([len(s) for s in others]), max(1, CELLS // len(others))
    for first in range(0, len(own), step):
        some, rows = own[first : first + step], left[first : first + step]
        both = overlaps(some, others)
        total = np.array([len(s) for s in some])[:, None] + sizes
        a, b = np.nonzero((100 * both >= PERCENT * (total - both)) & (rows[:, None] != right))
        labels = join_labels(labels, rows[a], right[b])
    return pa.RecordBatch.from_arrays([pa.array(nodes[labels], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def confirm_blocks(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is similar among ``roles`` (hub, id, n, outside): of each hub, the ids outside against all its ids."""
    spark = texts.sparkSession
    size = lambda c: F.floor(F.coalesce(F.sum(c), F.lit(0)) / BLOCK + 1).cast("int")
    cuts = roles.groupBy("hub").agg(size(F.when(F.col("outside") == 1, F.col("n"))).alias("rows"), size(F.col("n")).alias("cols"))
    met = roles.join(keep(cuts), "hub").withColumn("r", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int")).withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.col("cols")).cast("int"))
    some = ["id", "hub"]
    one = met.where("outside = 1").select(*some, "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), F.lit(0).alias("kind"))
    two = met.select(*some, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "c", F.lit(1).alias("kind"))
    routes = keep(one.unionByName(two))
    ids = keep(roles.select(F.col("id").alias("row")).distinct())
    if routes.count() <= BROADCAST_ROWS:  # 36 bytes each; ids are fewer
        routes, ids = F.broadcast(routes), F.broadcast(ids)

    def sets(batches):
        for batch in batches:
            data = pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), data], ["id", "data"])

    made = texts.join(ids, "row").select("row", "text").mapInArrow(sets, "id long, data binary")
    dealt = made.join(routes, "id").select("hub", "r", "c", "kind", "id", "data")
    dealt = dealt.repartition(partitions(spark), "hub", "r", "c").sortWithinPartitions("hub", "r", "c", "kind", "id")

    def compare(batches):
        at, own_ids, own, ids, others, held = None, [], [], [], [], 0
        for batch in batches:
            for hub, r, c, kind, doc, data in zip(*(batch.column(n) for n in ("hub", "r", "c", "kind", "id", "data"))):
                where, values = (hub.as_py(), r.as_py(), c.as_py()), np.frombuffer(data.as_buffer(), np.uint64).copy()
                if others and (where != at or held > TOGETHER):
                    yield links(own_ids, own, ids, others)
                    ids, others, held = [], [], 0
                if where != at:
                    at, own_ids, own = where, [], []
                if kind.as_py() == 0:
                    own_ids.append(doc.as_py())
                    own.append(values)
                elif own:
                    ids.append(doc.as_py())
                    others.append(values)
                    held += len(values)
        if others:
            yield links(own_ids, own, ids, others)

    return dealt.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def near_rows(texts: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, stays) of stored ``texts`` (row, doc_id, text): one row of each component stays."""
    rows = keep(sketch(texts))
    sets = rows.where("n > 0 and doc_id is not null").groupBy("n", "lo", "hi").agg(F.min(F.struct("doc_id", "row", "bands")).alias("least"))
    sets = keep(sets.select("n", "lo", "hi", F.col("least.row").alias("id"), F.col("least.doc_id").alias("doc_id"), F.col("least.bands").alias("bands")))
    bands = sets.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("key"))
    firsts = keep(bands.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1").select("key", "first"))
    members = keep(bands.join(firsts, "key").select("key", "id", "first"))
    shared = members.where("id <> first").groupBy("id", "first").agg(F.count("*").alias("bands"))
    best = shared.groupBy("id").agg(F.max(F.struct("bands", (-F.col("first")).alias("first"))).alias("best"))
    tried = keep(likely(best.select((-F.col("best.first")).alias("a"), F.col("id").alias("b")), sets))
    links = keep(confirm(texts, tried))
    groups = keep(components(links))

    inside = members.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    counts = inside.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = keep(mixed.select("key", F.col("main.component").alias("main")))
    roles = inside.join(mixed, "key").groupBy(F.col("main").alias("hub"), "id").agg(F.max((F.col("component") != F.col("main")).cast("int")).alias("outside"))
    roles = keep(roles.join(sets.select("id", "n"), "id"))
    more = keep(confirm_blocks(texts, roles))
    groups = components(links.unionByName(more))

    placed = keep(sets.select("n", "lo", "hi", "id", "doc_id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")))
    winners = placed.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("least"))
    facts = keep(placed.join(winners, "component").select("n", "lo", "hi", F.col("least.doc_id").alias("component_id"), F.col("least.id").alias("winner")))
    known = rows.where("n > 0 and doc_id is not null").join(facts, ["n", "lo", "hi"])
    known = known.select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("winner")).alias("stays"))
    alone = rows.where("n = 0 or doc_id is null").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return known.unionByName(alone)


def _texts(stored: DataFrame, number: str) -> DataFrame:
    return stored.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def near_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A null, empty or blank text has an empty set and links with nothing, and so does a row with a null
    doc_id. Rows are judged, not ids: repeated rows have equal sets and share a component, and texts that
    share a doc_id each have their own. A very long text is taken whole. Other columns play no part. An
    empty table gives no rows.
    """
    found = near_rows(_texts(*numbered(docs.select("doc_id", "text"))))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns as they were.

    Rows with a null doc_id, or without words, are in no component and stay.
    """
    stored, number = numbered(docs)
    lost = near_rows(_texts(stored, number)).where("not stays").select(F.col("row").alias(number))
    return stored.join(lost, number, "left_anti").select(*docs.columns)


SQL = r"""
with recursive
t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from t),
n as (select doc_id, count(*) n from s group by doc_id),
h as (select doc_id, n, (select md5(string_agg(g, chr(10) order by g)) from s where s.doc_id = n.doc_id) h from n),
u as (select min(doc_id) doc_id, n, h from h group by n, h),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id
      where a.doc_id in (select doc_id from u) and b.doc_id in (select doc_id from u) group by all),
e as (select x, y from p join n i on i.doc_id = x join n j on j.doc_id = y where 100 * c >= 75 * (i.n + j.n - c)),
l as (select x, y from e union all select y, x from e),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
k as (select u.n, u.h, least(u.doc_id, coalesce((select min(y) from r where x = u.doc_id), u.doc_id)) c from u)
select t.doc_id, coalesce(h.n, 0) as n_shingles, coalesce(k.c, t.doc_id) as component_id, t.doc_id = coalesce(k.c, t.doc_id) as kept
from t left join h on h.doc_id = t.doc_id left join k on k.n = h.n and k.h = h.h
"""
