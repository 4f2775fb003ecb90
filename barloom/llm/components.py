"""Connected components of an edge list, by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import Workspace


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """edges(src, dst: long) -> (node, comp): comp is the smallest node that can be reached.

    Self-loops and repeated edges are harmless; an empty edge list gives an empty result. Each round writes its labels,
    so a lost executor repeats one round; every round halves the pointer distance, so long chains take few rounds.
    """
    both = ws.stash(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct())
    labels = ws.stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("comp")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        target = labels.select(F.col("node").alias("mid"), F.col("comp").alias("jump"))
        new = ws.stash(low.join(target, "mid").select("node", "was", F.least("mid", "jump").alias("comp")))
        changed = new.filter("comp < was").limit(1).count()
        ws.drop(labels)
        labels = new
        if not changed:
            ws.drop(both)
            return labels.select("node", "comp")


def merged(comps: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """comps(node, comp), as connected_components() returns them, with edges(src, dst: long) added to what they come from.

    Only edges between components are followed, as edges of their smallest nodes; a node that comps lacks is a component.
    """
    at = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    ends = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    between = ws.stash(ends.select(F.coalesce("src_comp", "src").alias("src"), F.coalesce("dst_comp", "dst").alias("dst")).filter("src <> dst"))
    if between.isEmpty():
        return comps
    low = ws.stash(connected_components(between, ws))
    moved = comps.join(low.select(F.col("node").alias("comp"), F.col("comp").alias("low")), "comp", "left").select("node", F.coalesce("low", "comp").alias("comp"))
    return moved.unionByName(low.join(comps, "node", "left_anti").select("node", "comp"))
