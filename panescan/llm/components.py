"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panescan.llm.common import keep, partitions


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step. ``links`` has a > b. Every node points neighbours of it at the least node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    # dealt anew, so that the join below exchanges both sides and adaptive execution can split a hub
    least = least.repartition(partitions(links.sparkSession))
    met = both.join(least, both["a"] == least["n"])
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): component is the least id it reaches.

    Self-links and repeated links change nothing; null ends are left out. Rounds go on until nothing
    moves; each is stored, so a lost executor costs one round.
    """
    links = links.select("a", "b").where("a <> b")
    links = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        links = keep(_star(_star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
