"""BPE, packing, exact dedup, sharding, substring dedup and the url filter against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panescan.llm import bpe, exact_dedup, packing, queries, sharding, substring_dedup, url_filter
from tests.llm.conftest import documents


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.byte_vocabulary())


def test_bpe_is_the_librarys(spark, odd, library):
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert by_id(bpe.round_trip(odd, queries.byte_vocabulary())) == sorted(want, key=repr)


def test_bpe_ids_and_text_round_trip(spark, odd):
    ids = bpe.encode(odd, queries.byte_vocabulary())
    back = bpe.decode(ids, queries.byte_vocabulary())
    assert by_id(back) == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=repr)


def test_random_words_are_merged_as_the_library_does(library):
    draw, words = random.Random(4), bpe.vocabulary(queries.byte_vocabulary())
    texts = ["".join(draw.choice("abcdehilnorst aé'1 \n") for _ in range(draw.randrange(40))) for _ in range(3000)]
    ours = list(bpe.Encoder(queries.byte_vocabulary())(texts))
    assert [o.tolist() for o in ours] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    # both the guess and exact merging are in use
    lone = [w for t in texts for w in bpe.split(t)]
    wrong = [w for w in lone if words.guess(w.encode()) != words.merge(w.encode())]
    assert 0 < len(wrong) < len(lone)


def test_compatible_agrees_with_merging():
    words, draw = bpe.vocabulary(queries.byte_vocabulary()), random.Random(5)
    tokens = [t for t in draw.sample(range(words.size - 1), 300) if words.reachable(t)]
    pairs = np.array([(a, b) for a in tokens[:120] for b in tokens[120:240]])
    ok = words.compatible(pairs[:, 0], pairs[:, 1])
    for (a, b), good in list(zip(pairs.tolist(), ok.tolist()))[::17]:
        assert (words.merge(words.bytes[a] + words.bytes[b]) == [a, b]) == good


def test_bpe_empty_table(spark, empty):
    assert bpe.round_trip(empty, queries.byte_vocabulary()).count() == 0


# packing


def test_packing_loses_nothing(spark, odd):
    library = Tokenizer.from_file(queries.word_vocabulary())
    pieces = packing.pack(odd, queries.word_vocabulary(), width=64).collect()
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in odd.select("doc_id", "text").collect())
    place, streams = {}, Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == place.get(p["sequence_id"], 0)
        place[p["sequence_id"]] = p["offset"] + p["length"]
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
        streams[p["doc_id"], p["start"], tuple(np.frombuffer(p["ids"], "<u4").tolist()), p["doc_tokens"]] += 1
    assert sorted(place) == list(range(len(place))) and set(list(place.values())[:-1]) == {64} and max(place.values()) <= 64
    found = Counter()
    for (doc, ids), n in want.items():
        cuts = sorted((start, part) for d, start, part, total in streams if d == doc and total == len(ids) and ids[start : start + len(part)] == part)
        found[doc, ids] = n if {i for s, part in cuts for i in range(s, s + len(part))} == set(range(len(ids))) else 0
    assert found == want
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


def test_sequences_are_padded(spark):
    docs = documents(spark, ["one two three"] * 5 + [None])
    pieces = packing.pack(docs, queries.word_vocabulary(), width=8)
    rows = packing.sequences(pieces, 8).orderBy("sequence_id").collect()
    assert [r["tokens"] for r in rows] == [8, 8, 5] and all(len(r["ids"]) == 8 for r in rows) and rows[-1]["ids"][5:] == [0, 0, 0]


def test_packing_empty_table(spark, empty):
    assert packing.pack(empty, queries.word_vocabulary()).count() == 0


# exact dedup


def brute_groups(rows):
    key = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for doc, text in rows:
        groups.setdefault(key(text), []).append(doc)
    out = []
    for doc, text in rows:
        ids = [i for i in groups[key(text)] if i is not None]
        keep = max(ids) if ids else None
        out.append((doc, keep, len(groups[key(text)]), doc == keep, hashlib.sha256(key(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert by_id(exact_dedup.exact_groups(odd)) == brute_groups(rows)


def test_exact_groups_with_history(spark):
    old = exact_dedup.fingerprints(documents(spark, ["Seen", "other"], 100)).selectExpr("digest", "doc_id as winner", "5L as size")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(documents(spark, ["seen", "new", "NEW", "lone"]), old).collect()}
    assert found == {0: (100, 5, False), 1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}


def test_copies_without_ids_spread_over_slices(spark, monkeypatch):
    """A hot text whose rows have null ids, or all the same id, doesn't meet in one task."""
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 200)
    for doc_id in (None, 7):
        rows = exact_dedup.fingerprints(spark.range(0, 4000, 1, 8).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("hot").alias("text")))
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))
        found = exact_dedup.look_up(rows, groups, 1)
        spread = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert sum(r["count"] for r in spread) == 4000 and max(r["count"] for r in spread) < 2400


def test_perfect_hash_is_minimal():
    words = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4), np.uint64)
    made = exact_dedup.PerfectHash.load(*exact_dedup.PerfectHash.build(words).dump())
    assert sorted(made.slots(words).tolist()) == list(range(5000))


def test_exact_empty_table(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_repeats(empty).count() == 0


def test_drop_repeats_keeps_columns(spark, odd):
    kept = exact_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns
    want = {r[0] for r in brute_groups([tuple(r) for r in odd.select("doc_id", "text").collect()]) if r[3]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_drop_repeats_judges_rows_not_ids(spark):
    """A losing copy takes no other text of its doc_id along, null or repeated."""
    rows = [(None, "unique"), (None, "Copy"), (1, "copy"), (None, "none has an id"), (None, "none has an id"), (2, "TWIN"), (2, "own"), (3, "twin"), (None, None), (4, "")]
    kept = exact_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, "unique"), (1, "copy"), (None, "none has an id"), (None, "none has an id"), (2, "own"), (3, "twin"), (4, "")]
    assert by_id(kept) == sorted(want, key=repr)


# sharding


def test_shards(spark, odd):
    rows = sharding.shard_documents(odd, 5).collect()
    assert len(rows) == odd.count() and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(5) for i in range(sizes[s])]
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_are_drawn_evenly(spark):
    """Rows of one partition meet every shard about equally often, and orders differ by seed."""
    rows = spark.range(4000).repartition(7, "id")
    found = sharding.shuffle_into_shards(rows, 4, 1).collect()
    low = Counter(r["shard"] for r in found if r["id"] < 2000)
    assert all(430 < n < 570 for n in low.values())
    other = {r["id"]: r["slot"] for r in sharding.shuffle_into_shards(rows, 4, 2).collect()}
    assert sum(other[r["id"]] == r["slot"] for r in found) < 50


def test_repeated_rows_are_spread_over_all_shards(spark):
    """200 equal rows among 1,000 in 40 shards: five in each on average, as chance has it."""
    rows = spark.range(1000).select(F.when(F.col("id") < 200, F.lit(None).cast("long")).otherwise(F.col("id")).alias("id"))
    found = sharding.shuffle_into_shards(rows.repartition(5), 40, 1).collect()
    equal = Counter(r["shard"] for r in found if r["id"] is None)
    assert sum(equal.values()) == 200 and len(equal) >= 35 and max(equal.values()) <= 14
    assert set(Counter(r["shard"] for r in found).values()) == {25}
    slots = [r["slot"] for r in found if r["id"] is None]
    assert 9 < np.mean(slots) < 15 and np.std(slots) > 5


def test_matrix_margins_over_two_levels(spark):
    draw = random.Random(3)
    counts = {p: draw.choice([0, 1, 10, 300]) for p in range(60)}
    counts = {p: n for p, n in counts.items() if n}
    total = sum(counts.values())
    sizes = [total // 7 + (s < total % 7) for s in range(7)]
    frame = spark.createDataFrame(list(counts.items()), "_part int, n long")
    made = {r["node"]: r["cells"] for r in sharding.communication_matrix(frame, 60, sizes, 3).collect()}
    assert {p: sum(row) for p, row in made.items()} == counts
    assert [sum(column) for column in zip(*made.values())] == sizes


def test_hypergeometric_draws(spark):
    drawn = lambda *facts: sharding.hypergeometric(F.xxhash64("id"), *[F.lit(f) for f in facts])
    rows = spark.range(4000).select(drawn(30, 70, 20).alias("a"), drawn(5, 0, 3).alias("b"), drawn(0, 9, 4).alias("c"), drawn(0, 0, 0).alias("d"), drawn(6, 4, 8).alias("e"), drawn(40000, 60000, 50000).alias("f"))
    a, b, c, d, e, f = zip(*rows.collect())
    assert abs(np.mean(a) - 6) < 0.15 and abs(np.var(a) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    assert (set(b), set(c), set(d), set(e)) == ({3}, {0}, {0}, {4, 5, 6})
    share = Counter(e)
    assert abs(share[4] / 4000 - 1 / 3) < 0.03 and abs(share[6] / 4000 - 2 / 15) < 0.03  # 15, 24 and 6 of 45
    assert abs(np.mean(f) - 20000) < 8 and abs(np.std(f) / 77.5 - 1) < 0.05


def test_shards_empty_table(spark, empty):
    assert sharding.shard_documents(empty).count() == 0


# substring dedup


def brute_strip(rows, width):
    words = [(doc, (text or "").encode().split()) for doc, text in rows]
    counts = Counter(tuple(w[i : i + width]) for _, w in words for i in range(len(w) - width + 1))
    out = []
    for doc, w in words:
        gone = {j for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, count=60):
    draw = random.Random(seed)
    shared = [" ".join(f"s{draw.randrange(50)}" for _ in range(draw.randrange(30, 60))) for _ in range(4)]
    texts = []
    for _ in range(count):
        parts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(40))) for _ in range(3)]
        texts.append("\n".join([parts[0], draw.choice(shared), parts[1], draw.choice(shared + [""]), parts[2]]))
    return texts + ["a b " * 40, "c " * 34, "d " * 35, "d " * 36]


@pytest.mark.parametrize("width", [35, 3])
def test_strip_repeats(spark, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE_WINDOWS", 500)
    docs = documents(spark, passages(1)).repartition(5)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert by_id(substring_dedup.repeat_digests(docs, width)) == brute_strip(rows, width)


def test_strip_repeats_odd(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert by_id(substring_dedup.repeat_digests(odd)) == brute_strip(rows, 35)


def test_strip_reference_by_automata(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    texts = passages(2)
    reference, docs = documents(spark, texts[:20]), documents(spark, texts[20:] + [None, ""])
    known = {tuple(w[i : i + 5]) for t in texts[:20] for w in [t.encode().split()] for i in range(len(w) - 4)}
    for r in substring_dedup.strip_reference(docs, reference, 5).collect():
        w = ((texts[20:] + [None, ""])[r["doc_id"]] or "").encode().split()
        gone = {j for i in range(len(w) - 4) if tuple(w[i : i + 5]) in known for j in range(i, i + 5)}
        assert bytes(r["kept"]) == b" ".join(x for j, x in enumerate(w) if j not in gone) and r["n_removed"] == len(gone)


def test_strip_empty_table(spark, empty):
    assert substring_dedup.repeat_digests(empty).count() == 0


# url filter

PAGES = "page_id long, url string, html string"


def brute_scores(edges, seeds, kind):
    out, total = {}, Counter()
    for s, d, w in edges:
        s, d = (s, d) if kind == 0 else (d, s)
        total[s] += w
    term = {h: m * (1 - url_filter.DAMPING) for h, k, m in seeds if k == kind}
    for _ in range(url_filter.ROUNDS + 1):
        for h, v in term.items():
            out[h] = out.get(h, 0) + v
        new = {}
        for s, d, w in edges:
            s, d = (s, d) if kind == 0 else (d, s)
            if s in term:
                new[d] = new.get(d, 0) + term[s] * url_filter.DAMPING * w / total[s]
        term = new
    return out


def test_propagation(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0), ("a", "d", 1.0)]
    seeds = [("a", 0, 1.0), ("d", 1, 0.5), ("b", 1, 0.5)]
    got = {(r["host"], r["kind"]): r["score"] for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, kind int, mass double")).collect()}
    want = {(h, k): v for k in (0, 1) for h, v in brute_scores(edges, seeds, k).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_judged_pages(spark):
    urls = [
        (0, "https://shop.example.com/en/1", None), (1, "http://WWW.example.com/en/", ""), (2, "http://x.org/de/9?q#f", '<a href="https://good.com/">'),
        (3, "http://bad.net/es/1", '<a href="//x.org/page"> <A HREF=\'http://y.org\'>'), (4, "http://y.org/", '<a href="http://bad.net/en/">'), (5, "http://good.com/a", '<a href="http://x.org/">'),
        (6, None, None), (7, "nothing", "x"), (8, "ftp://Good.com", "x"), (9, "http://bad.net/en/2", None), (9, "http://bad.net/en/2", None), (None, "http://evilnet/es/", None), (11, "x://h.com://z/en/?a", None),
    ]
    rows = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(urls, PAGES)).collect()}
    assert len(rows) == 12
    facts = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in rows.items()}
    assert facts[0] == ("shop.example.com", "/en/1", "example.com/en/", "block")
    assert facts[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert facts[2][:3] == ("x.org", "/de/9", None) and facts[3] == ("bad.net", "/es/1", "net/es/", "block")
    assert facts[4] == ("y.org", "/", None, "block")  # it links to a blocked host
    assert facts[2][3] == "allow"  # a trusted host links to it
    assert facts[5] == ("good.com", "/a", "com/", "allow") and facts[6] == ("", "", None, "allow") and facts[7] == ("", "", None, "allow")
    assert facts[8] == ("good.com", "", None, "allow") and facts[9] == ("bad.net", "/en/2", None, "block")
    assert facts[None] == ("evilnet", "/es/", None, "allow") and facts[11] == ("h.com:", "//z/en/", None, "allow")


def test_settled_scores_are_solved_pagerank(spark):
    """A chain longer than one block of steps and a two-way pair, against a linear system."""
    edges = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)] + [("h3", "p", 2.0), ("p", "q", 1.0), ("q", "p", 1.0)]
    seeds = [("h0", 0, 0.7), ("p", 0, 0.3), ("h30", 1, 1.0)]
    names = sorted({h for s, d, _ in edges for h in (s, d)})
    want = {}
    for kind in (0, 1):
        matrix, mass = np.zeros((len(names), len(names))), np.zeros(len(names))
        for s, d, w in edges:
            s, d = (s, d) if kind == 0 else (d, s)
            matrix[names.index(s), names.index(d)] += w
        matrix /= np.maximum(matrix.sum(1, keepdims=True), 1e-300)
        for h, k, m in seeds:
            mass[names.index(h)] += (1 - url_filter.DAMPING) * m * (k == kind)
        want |= {(h, kind): v for h, v in zip(names, np.linalg.solve(np.eye(len(names)) - url_filter.DAMPING * matrix.T, mass)) if v > 1e-15}
    got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, kind int, mass double"), rounds=None)
    got = {(r["host"], r["kind"]): r["score"] for r in got.collect()}
    assert got.keys() == want.keys() and ("h0", 1) in got and all(abs(got[k] / want[k] - 1) < 1e-7 for k in want)


def test_tiny_distrust_still_blocks(spark):
    """Three million blocked pages make the one seed of a link farm weigh little; two steps of fan-out 1,000 more."""
    many = spark.range(3_000_000).selectExpr("id as page_id", "'http://bad.net/es/1' as url", "cast(null as string) as html")
    farm = [(-1, "http://few.net/es/1", None)] + [(-2, f"http://a{i}.org/", '<a href="http://few.net/">') for i in range(1000)] + [(-3, f"http://b{i}.org/", '<a href="http://a0.org/">') for i in range(1000)]
    rows = url_filter.judge(many.unionByName(spark.createDataFrame(farm, PAGES))).where("page_id = -3").collect()
    assert len(rows) == 1000 and {r["verdict"] for r in rows} == {"block"} and all(0 < r["distrust"] < 1e-12 for r in rows)


def test_url_filter_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0
