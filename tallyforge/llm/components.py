"""Connected components of an edge list by alternating large-star and small-star steps.

Both steps are joins and partial aggregates on node ids; a hub's edges are never gathered in one group or one task. Each round
is written to the shared folder, so lineage stays short and a lost executor costs one round at most. Ends when a
round changes nothing: on a path of n nodes that takes about log2(n) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

#: A node with more than this share of all edges is a hub (and no node with fewer than FEW edges).
HUB, FEW = 1 / 4096, 1000


def _least(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """For each node of directed edges (u, v): u, m, the smallest of u and its v; and the edges with their u's m.

    Nodes with more than `most` edges, of which there are len(edges) / most at the most, are looked up by broadcast, so
    that a hub's edges stay where they are; the others are joined."""
    all_least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = F.broadcast(all_least.where(F.col("n") > most).select("u", "m"))
    looked = edges.join(hubs, "u", "left")
    rest = looked.where("m is null").select("u", "v").join(all_least.where(F.col("n") <= most).select("u", "m"), "u")
    return all_least.select("u", "m"), looked.where("m is not null").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def large_star(edges: DataFrame, most: int) -> DataFrame:
    """Links each node's larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, most)[1].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, most: int) -> DataFrame:
    """Links each node's smaller neighbours, and the node, to the smallest of them. Edges go from larger to smaller."""
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least, held = _least(low, most)
    moved = held.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable. edges: (u, v), u <> v."""
    e = cut(edges.select("u", "v").where("u <> v").distinct(), "components")
    most = max(int(2 * HUB * e.count()), FEW)
    e = cut(small_star(e, most), "components")
    print_of = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(e)
    for _ in range(most_rounds):
        e = cut(small_star(large_star(e, most), most), "components")
        now = print_of(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components have not settled")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
