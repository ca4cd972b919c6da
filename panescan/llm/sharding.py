"""Uniform shuffle into shards of exact size (operator 8), DataFrame functions only.

A uniform permutation of all rows sends a hypergeometric number of rows of each input partition to
each shard. That matrix is drawn first, from row counts alone; the rows then need one exchange:

1. each input partition orders its rows by a seeded hash of their places (a local permutation) and
   numbers them;
2. the communication matrix, partitions x shards, is drawn exactly, with the partitions' counts and
   the shards' sizes as margins: first the share of large groups of partitions, then of the groups
   within them, down to single partitions, so that each task draws FAN rows of the matrix and none
   holds it whole; a row's number in its partition says which shard draws it;
3. rows are exchanged by (shard, second hash), so a shard may fill many tasks, and ordered there.

No shard is gathered in one task: the place of a row is its task's offset plus its local number. The
driver sees two numbers of the input and one count for each partition of the exchange.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import cut_lineage, lookup, partitions

LOCAL = (1 << 33) - 1  # monotonically_increasing_id(): partition above, row number in the lower 33 bits
FAN = 16  # groups that a group of partitions is split into
BROADCAST_CELLS = 1 << 20  # cells of 8 bytes up to which the matrix is sent to all executors


def _once(value: Column, then) -> Column:
    """``then`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), then)[0]


def _walk(start: Column, steps: Column, take) -> Column:
    """``start`` after ``take(state, i)`` for i from 1 to ``steps``."""
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), steps.cast("bigint")), start, take)).otherwise(start)


def hypergeometric(seed: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of ``draws`` from ``good + bad`` things are good: one exact draw by ``seed``, a bigint.

    Counts are gone through outward from the mode with their relative weights; each takes the place of the
    one chosen so far with its weight's share of the weights seen, which is a draw by weight in one pass.
    What lies more than 12 standard deviations away weighs less than a double tells from nothing.
    """
    g, b, n = good.cast("double"), bad.cast("double"), draws.cast("double")
    whole = F.greatest(g + b, F.lit(1.0))
    low, high = F.greatest(F.lit(0.0), n - b), F.least(n, g)
    peak = F.floor((n + 1) * (g + 1) / (g + b + 2)).cast("double")
    facts = F.struct(
        seed.alias("seed"), g.alias("g"), b.alias("b"), n.alias("n"), low.alias("low"), high.alias("high"),
        F.greatest(low, F.least(high, peak)).alias("mode"),
        F.floor(12 * F.sqrt(n * (g / whole) * (b / whole)) + 36).cast("double").alias("reach"),
    )

    def draw(x: Column) -> Column:
        def state(weight, total, pick):
            return F.struct(weight.alias("weight"), total.alias("total"), pick.alias("pick"))

        def outward(count, growth):
            def take(s, i):
                k = count(i)
                weight = s["weight"] * growth(k)
                chance = F.shiftrightunsigned(F.xxhash64(x["seed"], k.cast("bigint")), 11) * F.lit(2.0**-53)
                return state(weight, s["total"] + weight, F.when(chance * (s["total"] + weight) < weight, k).otherwise(s["pick"]))

            return take

        up = outward(lambda i: x["mode"] + i, lambda k: (x["g"] - k + 1) * (x["n"] - k + 1) / (k * (x["b"] - x["n"] + k)))
        down = outward(lambda i: x["mode"] - i, lambda k: (k + 1) * (x["b"] - x["n"] + k + 1) / ((x["g"] - k) * (x["n"] - k)))
        above = _walk(state(F.lit(1.0), F.lit(1.0), x["mode"]), F.least(x["high"] - x["mode"], x["reach"]), up)
        both = _once(above, lambda s: _walk(state(F.lit(1.0), s["total"], s["pick"]), F.least(x["mode"] - x["low"], x["reach"]), down))
        return both["pick"].cast("bigint")

    return _once(facts, draw)


def _rows_of(kids: Column, cells: Column, level: int, seed: int) -> Column:
    """``cells`` (things left for each shard) dealt to ``kids`` (node, n): an array of (node, cells)."""
    empty = F.array().cast("array<bigint>")

    def deal(kid: Column, left: Column) -> Column:
        def shard(s, i):
            size = left[i]
            rest = s["pool"] - size
            got = hypergeometric(F.xxhash64(F.lit(seed), F.lit(level), kid["node"], i), size, rest, s["todo"])
            return _once(got, lambda take: F.struct((s["todo"] - take).alias("todo"), rest.alias("pool"), F.concat(s["row"], F.array(take)).alias("row")))

        pool = F.aggregate(left, F.lit(0).cast("bigint"), lambda a, b: a + b)
        start = F.struct(kid["n"].alias("todo"), pool.alias("pool"), empty.alias("row"))
        return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), start, shard)["row"]

    def step(s, kid):
        return _once(
            deal(kid, s["left"]),
            lambda row: F.struct(
                F.zip_with(s["left"], row, lambda a, b: a - b).alias("left"),
                F.concat(s["made"], F.array(F.struct(kid["node"].alias("node"), row.alias("cells")))).alias("made"),
            ),
        )

    start = F.struct(cells.alias("left"), F.array().cast("array<struct<node: bigint, cells: array<bigint>>>").alias("made"))
    return F.aggregate(kids, start, step)["made"]


def communication_matrix(counts: DataFrame, parts: int, sizes: list[int], seed: int) -> DataFrame:
    """(node, cells): how many rows of partition ``node`` go to each shard.

    ``counts`` (_part, n) has the rows of partitions below ``parts``, ``sizes`` those of the shards; the sums
    are equal. Partitions without rows have no row.
    """
    depth, span = 1, FAN
    while span < parts:
        depth, span = depth + 1, span * FAN
    matrix = None
    for level in reversed(range(depth)):
        nodes = counts.groupBy(F.floor(F.col("_part") / FAN**level).alias("node")).agg(F.sum("n").alias("n"))
        kids = nodes.groupBy(F.floor(F.col("node") / FAN).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("kids"))
        if matrix is None:  # one row: the root
            given = kids.withColumn("cells", F.array(*[F.lit(s).cast("bigint") for s in sizes]))
        else:
            given = matrix.join(kids, matrix["node"] == kids["parent"])
        matrix = given.select(_rows_of(F.col("kids"), F.col("cells"), level, seed).alias("rows")).select(F.inline("rows"))
    return cut_lineage(matrix)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows ordered within their partition, with ``_part`` and ``_row``; cut, so that both stay."""
    made = df.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    made = made.select("*", F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND(LOCAL).alias("_row"))
    return cut_lineage(made.drop("_id"))


def part_counts(df: DataFrame) -> DataFrame:
    """Rows of each partition that has any: _part, n."""
    return df.groupBy("_part").agg(F.count("*").alias("n"))


def shuffle_into_shards(rows: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform random order, cut into shards at most one row apart.

    Rows are told apart by their places in the input alone, so nulls, ties and repeated rows are dealt like
    any others; their columns are carried, not read. The same input files give the same order. An empty
    table gives no rows. Columns of ``rows`` that start with an underscore are not allowed.
    """
    spark = rows.sparkSession
    base = rows.withColumn("_place", F.monotonically_increasing_id()).withColumn("_hash", F.xxhash64(F.lit(seed), "_place"))
    local = numbered(base, "_hash", "_place")
    counts = cut_lineage(part_counts(local))
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.coalesce(F.max("_part"), F.lit(-1)) + 1).alias("parts")).first()
    total, parts = facts["n"], facts["parts"]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    starts = [0, *accumulate(sizes)]
    matrix = communication_matrix(counts, parts, sizes, seed)
    matrix = matrix.select(F.col("node").cast("int").alias("_part"), F.transform("cells", lambda _, i: F.aggregate(F.slice("cells", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("_cuts"))
    dealt = local.join(F.broadcast(matrix) if parts * shards <= BROADCAST_CELLS else matrix, "_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_cuts", lambda cut: cut <= F.col("_row"))))
    dealt = dealt.drop("_part", "_row", "_cuts").withColumn("_hash", F.xxhash64(F.lit(seed + 1), "_place"))
    spread = dealt.repartitionByRange(partitions(spark), "shard", "_hash", "_place")
    final = numbered(spread, "shard", "_hash", "_place")
    sums = {r["_part"]: r["n"] for r in part_counts(final).orderBy("_part").collect()}  # one for each partition of the exchange
    offsets = [{"_part": p, "_before": b} for p, b in zip(sums, [0, *accumulate(sums.values())])]
    placed = final.join(lookup(spark, offsets, "_part int, _before bigint"), "_part")
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    return placed.withColumn("slot", F.col("_before") + F.col("_row") - start).drop("_part", "_row", "_before", "_hash", "_place")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """Every document's shard and slot; other columns of ``docs`` play no part.

    A null text has size 16 and the CRC of no bytes. Equal texts are dealt like any others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shuffle_into_shards(rows, shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
