"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import written_once


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest reachable node.

    Alternates two rounds until nothing changes: each node hands its larger
    neighbours to its smallest one, then its smaller neighbours likewise. Every
    round is a grouped minimum (partial on the map side) and an equi-join that
    adaptive execution splits where a node has very many edges; rounds are
    written to the shared scratch folder, which also cuts the lineage. The
    number of rounds grows with the logarithm of the longest chain. Edges with
    a null end and loops are ignored; no edges give an empty result.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = written_once(
        edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "components"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lower.select("u", "m"))
        ).distinct()
        now = written_once(small, "components")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return (
        now.groupBy("u").agg(F.min("v").alias("v"))
        .select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(now.select("v", "v").distinct())
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())
