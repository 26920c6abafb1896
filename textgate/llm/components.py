"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgate.llm._store import Store


SALT = 4


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node with an edge.

    Every round points each node at the smallest of its neighbours and then shortens the
    paths, so the rounds grow with the logarithm of a chain's length; a round that changes no
    edge is the last.  Only a count and a checksum reach the driver.  Null ends and loops are no
    edges; repeated edges change nothing.
    """
    store = Store(edges.sparkSession)
    links = store.put(_directed(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))).distinct(), "links")
    state = None
    while True:
        before, state = state, links.agg(F.bit_xor(F.xxhash64("u", "v")), F.count("*")).first()
        if state == before:
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        after = store.put(_star(_star(links, larger=True), larger=False).distinct(), "links")
        store.drop(links)
        links = after


def _directed(links: DataFrame) -> DataFrame:
    """Edges as (larger, smaller)."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Connects each node's larger (or smaller, with itself) neighbours to its smallest neighbour.

    The neighbours of a node are dealt to ``SALT`` tasks, and as the join's sides are shuffles of
    their own, Spark can split a node with very many neighbours further.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(least.hint("merge"), ["u", "salt"])
    if larger:
        return _directed(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _directed(joined.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")))
