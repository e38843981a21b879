"""Connected components of an edge table, by alternating small-star and large-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join; the edges of each step are
written to the shared folder and nothing but counts and checksums comes to the driver. The small star comes
first: it leaves each node one edge but for those between its neighbours, so what the large star turns
around is hardly more than one edge a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop_staged, staged

HUB_SHARE = 1000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node with an edge; component is the smallest reachable node.

    Self-loops and null ends are ignored, repeated edges count once. Nodes without an edge are absent.
    """
    start = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    now = staged(start.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _checksum(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        hung = _with_minimum(now, seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = now.groupBy("u").agg(F.min("v").alias("v"))
        small = staged(hung.unionByName(root).distinct(), "small")
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _with_minimum(both, 2 * small.count()).where("v > u")
        large = staged(low.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        drop_staged(now)
        drop_staged(small)
        now, was = large, seen
        seen = _checksum(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_minimum(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the smallest v of their u. edges: staged, `total` of them.

    A hub would fill one task of the join. There are fewer than HUB_SHARE nodes that hold more than that
    share of the edges, so their minima are broadcast; the other edges are joined by shuffle.
    """
    lows = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    hubs = lows.where(F.col("_n") * HUB_SHARE > total).select("u", "m")
    rest = lows.where(F.col("_n") * HUB_SHARE <= total).select("u", "m")
    at_hubs = edges.join(F.broadcast(hubs), "u")
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(rest, "u")
    return at_hubs.unionByName(others)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
