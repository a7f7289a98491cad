"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import marked, materialise

HUB_EDGES = 1_000
MOST_HUBS = 50_000


def with_least(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """``edges`` (u, v) with m: the smallest v of its u.

    The smallest neighbours come by partial aggregation. Those of ``hubs`` are broadcast, so that a hub's edges stay
    where they are and no task gathers them."""
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m"))
    if not hubs:
        return edges.join(least(edges), "u")
    told_apart = marked(edges, "u", hubs, "of_hub")
    of_hubs, rest = told_apart.where("of_hub").drop("of_hub"), told_apart.where("not of_hub").drop("of_hub")
    return of_hubs.join(F.broadcast(least(of_hubs)), "u").unionByName(rest.join(least(rest), "u"))


def stars(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """One round over distinct (u, v), u > v: every node is tied to the smallest node it sees."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = with_least(both, hubs).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    linked = with_least(large, [])
    return linked.select("u", F.col("m").alias("v")).unionAll(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def told(edges: DataFrame, hub_edges: int) -> tuple[tuple, list[int]]:
    """Number and sum of the edges, to see whether a round changed them, and the hubs: nodes with more than ``hub_edges``
    edges to larger ones, or than the edges' number over ``MOST_HUBS``, so there are at most that many."""
    by = edges.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    many = F.slice(F.array_sort(F.collect_list(F.when(F.col("n") > hub_edges, F.struct((-F.col("n")).alias("n"), "v")))), 1, MOST_HUBS)
    row = by.agg(F.sum("n"), F.sum("s"), many["v"]).first()
    return (row[0], row[1]), list(row[2])


def connected_components(edges: DataFrame, name: str = "components", hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the smallest node of its component.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the
    logarithm of the longest path."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = materialise(e, name), None
    bound = max(hub_edges, e.count() // MOST_HUBS)
    while True:
        now, hubs = told(e, bound)
        if now == before:
            break
        e, before = materialise(stars(e, hubs), name), now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
