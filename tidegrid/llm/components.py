"""Distributed connected components by repeated star contraction.

Each round solves the edges of every partition by itself (bounded chunks), which leaves
stars; a node whose smallest root is a root everywhere is folded into it.  What is left is
the graph of the folded nodes, written to the shared folder, until no edge remains.  Nodes
are ordered by a hash, so chains shrink by a constant share per round whatever their ids.
Nothing is gathered by component, and hub nodes occur only in joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.staging import stage

CHUNK = 1_000_000
#: Nodes of rows without an id are this and above.
FREE = 1 << 62


def free_node(h: Column) -> Column:
    """Graph node of a row without an id, from the hash of its content."""
    return F.lit(FREE) + F.xxhash64(F.lit("no id"), h).bitwiseAND(F.lit(FREE - 1))


def led_by_ids(component: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component, idless)``: the smallest id leads; ``idless`` tells components without any.

    ``nodes`` has ``node`` and whether it is ``free``, the node of a row without an id.
    """
    if nodes.where((F.col("node") >= FREE) & ~F.col("free")).isEmpty():
        return component.withColumn("idless", F.col("component") >= FREE)
    # ids among the free nodes: the smallest node need not be the smallest id
    lead = component.join(nodes.where("free").select("node"), "node", "left_anti")
    lead = lead.groupBy("component").agg(F.min("node").alias("lead"))
    component = component.join(lead, "component", "left")
    return component.select("node", F.coalesce("lead", "component").alias("component"), F.col("lead").isNull().alias("idless"))


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over edges ``a[i] - b[i]``."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def solve(parts: list[pd.DataFrame]) -> pd.DataFrame:
        e = pd.concat(parts, ignore_index=True)
        nodes = pd.DataFrame(
            {"node": np.concatenate([e.a, e.b]), "rank": np.concatenate([e.ra, e.rb])}
        ).drop_duplicates()
        nodes = nodes.sort_values(["rank", "node"], ignore_index=True)
        index = pd.Index(nodes.node)
        root = local_roots(index.get_indexer(e.a), index.get_indexer(e.b), len(nodes))
        inner = root != np.arange(len(nodes))
        top = nodes.iloc[root[inner]]
        return pd.DataFrame({"v": nodes.node[inner].to_numpy(), "r": top.node.to_numpy(), "rank": top["rank"].to_numpy()})

    parts, held = [], 0
    for frame in frames:
        parts.append(frame)
        held += len(frame)
        if held >= CHUNK:
            yield solve(parts)
            parts, held = [], 0
    if held:
        yield solve(parts)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` to ``(node, component)``, the component being its smallest node.

    Nodes without an edge to another node do not appear.  Null ends are dropped; repeated
    and mirrored edges count once.  No edges give no rows.
    """
    folded: list[DataFrame] = []
    left = stage(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    while not left.isEmpty():
        ranked = left.select("a", "b", F.xxhash64("a").alias("ra"), F.xxhash64("b").alias("rb"))
        stars = stage(ranked.mapInPandas(_stars, "v long, r long, rank long"), "stars")
        best = stars.groupBy("v").agg(F.min(F.struct("rank", "r")).alias("m")).select("v", F.col("m.r").alias("p"))
        inner = stars.select(F.col("v").alias("p")).distinct()
        fold = stage(best.join(inner, "p", "left_anti").select("v", "p"), "fold")
        folded.append(fold)
        to = fold.select(F.col("v").alias("k"), F.col("p").alias("to"))
        moved = stars.select("v", "r").join(to, F.col("v") == F.col("k"), "left")
        moved = moved.select(F.coalesce("to", "v").alias("a"), "r").where("a <> r")
        moved = moved.join(to, F.col("r") == F.col("k"), "left").select("a", F.coalesce("to", "r").alias("b"))
        left = stage(moved.where("a <> b").distinct(), "edges")
    if not folded:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = folded.pop()
    for fold in reversed(folded):
        later = roots.select(F.col("v").alias("k"), F.col("p").alias("to"))
        lifted = fold.join(later, F.col("p") == F.col("k"), "left").select("v", F.coalesce("to", "p").alias("p"))
        roots = stage(lifted.unionByName(roots), "roots")
    least = roots.groupBy("p").agg(F.min("v").alias("m")).select("p", F.least("p", "m").alias("component"))
    least = stage(least, "components")
    nodes = roots.join(least, "p").select(F.col("v").alias("node"), "component")
    return nodes.unionByName(least.select(F.col("p").alias("node"), "component"))
