"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: A node of more neighbours is a hub. The bound rises with the edges, so that there are never more than MOST_HUBS of them.
HUB, MOST_HUBS = 256, 50_000


def _led(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m) of ``edges`` (u, v) with m from ``least`` (u, m, n neighbours).

    The edges of a hub would meet in one task; hubs are at most ``MOST_HUBS``
    rows by count, so they are broadcast and their edges stay where they are.
    """
    bound = max(HUB, 2 * n_edges // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") > bound).select("u", "m"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").unionByName(others.select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (columns u, v; loops name lone nodes): root is the component's least node.

    Each round replaces edges by edges to the least neighbour, so that their
    number never exceeds that of the input; stars are reached after about the
    logarithm of the diameter in rounds. Minima are taken before the shuffle,
    and no task holds all edges of a hub. Repeated edges count once; an empty
    table gives no rows.
    """
    nodes = settle(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct())
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    while mark["n"]:
        before = (mark["n"], mark["x"])
        # Large star: every larger neighbour of u goes to the least one around u.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_v"), F.count("*").alias("n")).select("u", F.least("_v", "u").alias("m"), "n")
        large = settle(_led(both.where("v > u"), least, mark["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: u and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _led(large, least, mark["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = settle(small.where("u <> v").distinct())
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == (mark["n"], mark["x"]):
            break
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
