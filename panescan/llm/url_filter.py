"""URL filters by propagation over the link graph (operator 7).

Rules judge what they fit. Other urls get their host's verdict: trust walks from hosts with allowed
pages along links, distrust from hosts with blocked pages against them, both as personalised PageRank
over host edges, and a host whose distrust exceeds its trust by the threshold is blocked. Edges are the
hosts' links, weighed by the number of linking pages, and, both ways, the step from a host to the domain
above it (down to two labels). A walk goes on with probability DAMPING and ends at hosts without edges;
walks are summed ROUNDS steps at a time. After k steps no score can still gain more than DAMPING^(k+1),
the mass that has not yet walked. Walks end when no new host is reached and either no host that waits for
a verdict could still get another one, or no score still grows by more than TOLERANCE of itself. Links are
merged to host edges before any exchange, only hosts that a walk has reached are carried, in partitions
sized by the edges they walk, and nothing but a row of counts is collected.
"""

from __future__ import annotations

import string
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import blocks, forget, keep

DAMPING, ROUNDS, RATIO = 0.85, 12, 1.0
TOLERANCE = 1e-8  # relative; scores that differ by less are equal
EDGES = 400_000  # whose steps one task takes

# Fixed values: (verdict, host, path) of the rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are a short list: one branch each."""
    rule = verdict = F.lit(None).cast("string")
    for judged, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, judged).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of pages (host, html): links to other hosts, and domain steps both ways."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    hosts = F.array_distinct(F.transform(found, lambda u: host_of(F.concat(F.lit("x:"), F.regexp_replace(u, r"^[^/]*:", "")))))
    links = pages.select(F.col("host").alias("src"), F.explode(hosts).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    links = keep(links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    known = pages.select("host").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    labels = known.where(~F.col("host").rlike(r"^[0-9.:]*$")).select(F.split("host", r"\.").alias("l")).where("size(l) >= 3")
    steps = labels.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    steps = steps.select(F.array_join(F.slice("l", F.col("i"), F.size("l")), ".").alias("src"), F.array_join(F.slice("l", F.col("i") + 1, F.size("l")), ".").alias("dst"), F.lit(1.0).alias("weight")).distinct()
    return links.unionByName(steps).unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def shares_of(edges: DataFrame, damping: float) -> DataFrame:
    """(src, kind, dst, share): what a step carries over. Kind 0 walks along edges, kind 1 against them."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(1).alias("kind"))
    both = edges.withColumn("kind", F.lit(0)).unionByName(back)
    total = both.groupBy("src", "kind").agg(F.sum("weight").alias("total"))
    return keep(both.join(total, ["src", "kind"]).select("src", "kind", "dst", (F.col("weight") / F.col("total") * damping).alias("share")))


def walk(shares: DataFrame, start: DataFrame, scores: DataFrame, rounds: int, parts: int) -> DataFrame:
    """``scores`` (host, kind, score) with ``rounds`` more steps; ``start`` has the scores of no step."""
    for _ in range(rounds):
        moved = shares.join(scores.withColumnRenamed("host", "src"), ["src", "kind"])
        moved = moved.select(F.col("dst").alias("host"), "kind", (F.col("score") * F.col("share")).alias("score"))
        scores = moved.unionByName(start).coalesce(parts).groupBy("host", "kind").agg(F.sum("score").alias("score")).coalesce(parts)
    return scores


def sides(scores: DataFrame) -> DataFrame:
    """(host, trust, distrust) of scores by kind."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def _excess(ratio: float) -> tuple[Column, Column]:
    """How far distrust exceeds ``ratio`` times trust, and the larger of the two."""
    trust = F.col("trust") * ratio
    return F.col("distrust") - trust, F.greatest(F.col("distrust"), trust)


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, waiting: DataFrame | None = None, ratio: float = RATIO) -> DataFrame:
    """(host, kind, score): personalised PageRank of ``seeds`` (host, kind, mass) over ``edges``.

    Without ``rounds`` the walk goes on until the scores have settled, or, given the hosts that wait for a
    verdict, until each of these has the one it would have then.
    """
    shares = shares_of(edges, damping)
    parts = blocks(shares.count(), EDGES)
    start = keep(seeds.select("host", "kind", (F.col("mass") * (1 - damping)).alias("score")).coalesce(parts))
    if rounds is not None:
        return keep(walk(shares, start, start, rounds, parts))
    scores, steps = start, 0
    while True:
        last, scores, steps = scores, keep(walk(shares, start, scores, ROUNDS, parts)), steps + ROUNDS
        was = last.withColumnRenamed("score", "last")
        grows = F.coalesce(F.col("score") - F.col("last") > F.col("score") * TOLERANCE, F.lit(True))  # a new host grows
        fresh, growing = scores.join(was, ["host", "kind"], "left").agg(F.count(F.when(F.col("last").isNull(), 1)), F.count(F.when(grows, 1))).first()
        if last is not start:
            forget(last)
        if fresh:
            continue
        if not growing:
            return scores
        if waiting is not None:
            more, larger = _excess(ratio)
            rest = damping ** (steps + 1) * max(1.0, ratio)  # seeds weigh 1 - damping of one
            either = F.abs(more) - rest <= TOLERANCE * (larger + rest)
            if sides(scores.join(waiting, "host", "left_semi").coalesce(parts)).where(either).isEmpty():
                return scores


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A null url or one without ``://`` has an empty host and path; an empty host takes no part in the
    graph, and hosts no walk reaches have no distrust: both are allowed unless a rule fits. Null html
    links nowhere. Repeated rows and null page_ids are judged each, and a page that is repeated links
    twice. Other columns play no part. An empty table gives no rows. Scores are shares of all seed pages
    and may be tiny: they are compared as they are, and count as equal only within TOLERANCE of the larger.
    ``trust`` and ``distrust`` are as settled as the verdicts need. A very long html or url is taken whole.
    """
    rules = RULES if rules is None else rules
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    kind = F.when(F.col("ruled") == "allow", 0).when(F.col("ruled") == "block", 1)
    counts = keep(rows.select("host", kind.alias("kind")).where("kind is not null and host <> ''").groupBy("host", "kind").agg(F.count("*").alias("n")))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = counts.join(F.broadcast(totals), "kind").select("host", "kind", (F.col("n") / F.col("all")).alias("mass"))  # two rows
    waiting = keep(rows.where("ruled is null and host <> ''").select("host").distinct())
    hosts = keep(sides(propagate(host_edges(rows), seeds, rounds=None, waiting=waiting, ratio=ratio)))
    met = rows.select("page_id", "host", "path", "rule", "ruled").join(hosts, "host", "left")
    met = met.withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    excess, larger = _excess(ratio)
    more = excess > TOLERANCE * larger
    judged = F.coalesce("ruled", F.when(more, "block").otherwise("allow"))
    return met.select("page_id", "host", "path", "rule", judged.alias("verdict"), "trust", "distrust")
