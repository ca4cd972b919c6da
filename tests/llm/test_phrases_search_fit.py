"""Collocations, best-fit packing and lexical search against brute force."""

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panescan.llm import best_fit, collocations, lexical_search, packing, queries
from panescan.llm.common import Remembered
from tests.llm.conftest import EXTRA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# what workers remember


def test_remembered_makes_again_only_what_two_generations_lost():
    made = []
    known = Remembered(lambda k: made.append(k) or k.encode(), 10 * (Remembered.ENTRY + 4))
    for _ in range(3):
        for i in range(9):
            assert known[f"k{i}"] == f"k{i}".encode()
    assert len(made) == 9
    for i in range(200):
        assert known[f"n{i}"] == f"n{i}".encode()
        assert known["k0"] == b"k0" and len(known) + len(known.older) <= 26
    assert made.count("k0") == 1 and made.count("n0") == 1


def test_one_encoder_serves_a_worker():
    assert packing.encoder(queries.word_vocabulary()) is packing.encoder(queries.word_vocabulary())


def test_an_encoder_remembers_within_its_own_bound():
    words = [f"w{i}x" for i in range(30_000)]
    wide, narrow = packing.ChunkEncoder(queries.word_vocabulary()), packing.ChunkEncoder(queries.word_vocabulary(), 1 << 20)
    assert (wide(" ".join(words)) == narrow(" ".join(words))).all()
    assert len(wide.known) == 30_000 and len(narrow.known) + len(narrow.known.older) < 15_000
    assert corpus_pipeline.PACKING_BYTES < packing.CHUNK_BYTES


def test_chunks_have_the_library_s_ids():
    """Texts that are lower-cased as a whole and others share one memory; letters whose lower case is beyond Latin too."""
    encode = packing.ChunkEncoder(queries.word_vocabulary())
    special = ["<|endoftext|> The", "<|ENDOFTEXT|> the", "a<|EndOfText|>b", "THE the. It's \xa0x\x85y\x1cz", "\u0130 i\u0307", "e\u0301 \xe9."]
    texts = [t for c in map(chr, range(0x250)) for t in (f"A{c}b, It'S", f"{c}{c.upper()} \u0253")] + special
    wrong = [t for t in texts if encode(t).tolist() != encode.tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []


# best fit


def fewest(counts, width):
    """Sequences of best-fit decreasing, one piece after the other."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(rooms, length)
            room = rooms.pop(i) if i < len(rooms) else width
            bisect.insort(rooms, room - length)
    return len(rooms)


def test_plan_fills_like_best_fit_decreasing():
    draw = random.Random(3)
    for _ in range(300):
        width = draw.choice([7, 20, 64, 100])
        counts = {n: draw.randrange(1, draw.choice([3, 30, 200])) for n in draw.sample(range(1, width + 1), draw.randrange(1, width + 1))}
        runs, filled = sorted(best_fit.plan(counts, width)), defaultdict(list)
        for i, (n, rank, sequence, each, place) in enumerate(runs):
            stop = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else counts[n]
            for k in range(rank, stop):
                nth, turn = divmod(k - rank, each)
                filled[sequence + nth].append((place + turn * n, n))
        assert sum(map(len, filled.values())) == sum(counts.values())
        for parts in filled.values():
            at = 0
            for place, n in sorted(parts):
                assert place == at
                at += n
            assert at <= width
        assert len(filled) == fewest(counts, width)


def test_plan_is_small_whatever_the_counts():
    assert len(best_fit.plan({n: 10**12 + n for n in range(1, 2049)}, 2048)) < 3 * 2048
    assert best_fit.plan({}, 2048) == []


@pytest.mark.parametrize("ids", [True, False])
def test_best_fit_packs_every_piece_once(spark, odd, ids):
    library, width = Tokenizer.from_file(queries.word_vocabulary()), 64
    pieces = best_fit.pack(odd.repartition(5), queries.word_vocabulary(), width=width, ids=ids).collect()
    want, counts = Counter(), Counter()
    for r in odd.select("doc_id", "text").collect():
        all_ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(all_ids), width)):
            data = np.array(all_ids[start : start + width], "<u4").tobytes()
            want[r["doc_id"], piece, start, len(data) // 4, zlib.crc32(data)] += 1
            counts[len(data) // 4] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    place = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == place[p["sequence_id"]]
        place[p["sequence_id"]] += p["length"]
        assert not ids or zlib.crc32(p["ids"]) == p["ids_crc32"]
    assert max(place.values()) <= width and len(place) == fewest(counts, width)


def test_best_fit_with_one_hot_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two three").otherwise(F.lit("four")).alias("text"))
    pieces = best_fit.pack(docs.repartition(7), queries.word_vocabulary(), width=9, ids=False)
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert pieces.count() == 3000 and by.agg(F.max("n")).first()[0] <= 9
    assert by.count() == fewest(Counter({4: 2000, 2: 1000}), 9)


def test_best_fit_empty(spark, empty):
    assert best_fit.pack(empty, queries.word_vocabulary()).count() == 0


# collocations


def phrases(rows, least, overlap, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= overlap * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in candidates.items()):
                continue
            cuts = [(1_000_000 * a * a // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(g).encode(), " ".join(g), a, count[g[:k]], count[g[k:]], n[lang], score))
        out += [(lang, i + 1, *row[3:]) for i, row in enumerate(sorted(kept)[:top])]
    return sorted(out)


def test_collocations_are_the_counted_ones(spark):
    draw = random.Random(11)
    words = ["the", "The", "New", "york", "city", "é", "École", "\x85", "a b", "x" * 50, "of"]
    texts = [" ".join(draw.choice(words) + draw.choice(["", "", "", ",", ".\n", "\t", " "]) for _ in range(draw.randrange(60))) for _ in range(120)]
    docs = documents(spark, texts + [None, "", " \t\n", "..", texts[0], texts[0]])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "fr")).withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")))
    docs = docs.select("*", *[F.lit(7).alias(c) for c in [*EXTRA, "block", "bucket", "pos", "word", "words", "n_x"]]).repartition(6)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    for least, overlap, top in ((2, 50, 2000), (5, 80, 40)):
        found = collocations.collocations(docs, least, overlap, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, found.collect())) == phrases(rows, least, overlap, top)


def test_overlaps_count(spark):
    found = collocations.collocations(documents(spark, ["a a a a a a a a a a a a"]), least=2).collect()
    assert [(r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found] == [("a a a", 10, 12, 11, 12, 757575)]


def test_slices_of_a_hot_prefix_are_whole(monkeypatch):
    draw = np.random.default_rng(2)
    prefix, after = draw.integers(0, 3, 5000), draw.integers(0, 400, 5000)
    ids, f, words = np.array([10, 20, 30]), np.bincount(prefix), draw.permutation(400) + 1000
    monkeypatch.setattr(collocations, "SLICE", 100)
    rows = collocations._stripes("en", 5, 7, prefix, after, ids, f, words)
    got, place = Counter(), {}
    for lang, block, bucket, data in rows:
        columns, _ = collocations._unpacked(pa.scalar(data, pa.binary()))
        for w1, total, w2, n in zip(*(c.tolist() for c in columns)):
            got[w1, w2] += n
            assert place.setdefault((w1, w2), bucket) == bucket and total == f[ids.tolist().index(w1)]
    assert got == Counter(zip(ids[prefix].tolist(), words[after].tolist()))
    assert len({b for (w, _), b in place.items() if w == 10}) > 3 and len(rows) <= 7  # one row a bucket


def test_counts_beyond_64_bits_in_scores(spark):
    big = spark.createDataFrame([(10**12, 2 * 10**12, 10**12 + 1)], "a long, l long, r long")
    assert big.select(collocations._score("a", "l", "r")).first()[0] == 10**6 * 10**24 // (2 * 10**12 * (10**12 + 1))


def test_collocations_empty_and_without_candidates(spark, empty, odd):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(documents(spark, ["a b c", None, ""])).count() == 0
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd, 3).collect())) == phrases(rows, 3, 50, 2000)


# lexical search


def ranking(docs, items, top=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    rows = [(d, Counter(terms(t))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    total, length = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i].update(terms(t))
    out = []
    for i, own in wanted.items():
        scored = []
        for d, c, n in rows:
            m = 100 - 90 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def test_search_ranks_like_brute_force(spark, odd):
    draw = random.Random(8)
    words = [f"w{int(draw.expovariate(0.03))}" for _ in range(3000)] + ["É", "é", "don't", "x-y", "ﬁ"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 90))) for _ in range(300)]
    docs = documents(spark, texts + texts[:20], start=1000).select("doc_id", "text", *[F.lit(1).alias(c) for c in ("item_id", "term", "df", "docs", "rank", "list")])
    docs = docs.unionByName(odd.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("item_id", "term", "df", "docs", "rank", "list")])).repartition(6)
    long = " ".join(f"w{i}" for i in range(150))  # masks of three words of bits
    items = [(1, "w1 w2 W3"), (2, long), (3, None), (4, "..."), (5, "nowhere"), (6, "É don't x-y word7 one"), (7, "w1"), (7, "w5 w1"), (None, "w9 w9"), (9, "password hunter2hunter2")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    found = lexical_search.search(docs, table)
    assert sorted(map(tuple, found.collect()), key=repr) == ranking([tuple(r) for r in docs.select("doc_id", "text").collect()], items)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 40)
    docs = documents(spark, ["a b c", "a a b", "c c c d", "e", "a b c"])
    items = [(i, t) for i, t in enumerate(["a b", "c", "d e", "a c e", "b"])]
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 2)
    assert sorted(map(tuple, found.collect()), key=repr) == ranking([tuple(r) for r in docs.select("doc_id", "text").collect()], items, 2)


def test_masks_stop_early_and_safely():
    draw = np.random.default_rng(4)
    for terms, size in ((3, 50), (60, 400), (120, 100)):
        present = draw.random((terms, size)) < draw.random((terms, 1))
        gains = draw.integers(0, 50, (terms, size)) * present
        docs, starts = [np.flatnonzero(p) for p in present], np.r_[0, np.cumsum(present.sum(1))]
        keep = present.any(1)
        docs, starts = [d for d, k in zip(docs, keep) if k], np.r_[0, np.cumsum(present[keep].sum(1))]
        flat = np.concatenate([gains[keep][i][d] for i, d in enumerate(docs)])
        ids, missing = draw.permutation(size), np.zeros(size, np.int64)
        masks, matched, group = lexical_search.masks_of(np.repeat(np.arange(len(docs)), np.diff(starts)), np.concatenate(docs), starts, size)
        assert (masks[group].T == present[keep][:, matched]).all() and len(np.unique(masks, axis=0)) == len(masks)
        found, scores = lexical_search.best_of(np.concatenate(docs), flat, starts, size, ids, missing, 10)
        total = gains.sum(0)
        want = [d for d in np.lexsort((ids, -total)) if total[d] > 0][:10]
        assert found.tolist() == want and scores.tolist() == total[want].tolist()


def test_search_empty(spark, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(documents(spark, ["a"]), items.limit(0)).count() == 0
    assert lexical_search.search(documents(spark, [None, "."]), items).count() == 0
