"""Connected components by hooking to the smallest neighbour and pointer jumping, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._base import table


def _changed(df: DataFrame) -> bool:
    return not df.where(F.col("changed")).limit(1).isEmpty()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (src, dst): root is the smallest node reachable.

    Every round each node hooks to its smallest neighbour if that is smaller, chains are flattened by pointer
    jumping, and the edges are relabelled by the roots, until none is left between different roots. Hooks
    always lead to smaller nodes, so there are no cycles and a component ends at its smallest node. Rounds are
    logarithmic in practice. Aggregations are minima with map-side combining; joins read files on both
    sides, so that a root with many children can be split. Loops and null ends are ignored. ``rows`` is a bound of the
    edges, if one is known.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    usable = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    left = table(usable.select(lo.alias("lo"), hi.alias("hi")).where(F.col("lo") != F.col("hi")).distinct(), "edges", rows=rows)
    labels, n_nodes = None, 0
    while n := left.count():
        parent = table(left.groupBy("hi").agg(F.min("lo").alias("lo")), "parents", rows=n)
        while True:
            up = parent.select(F.col("hi").alias("mid"), F.col("lo").alias("top"))
            jumped = parent.join(up, parent["lo"] == up["mid"], "left").select("hi", F.coalesce("top", "lo").alias("lo"), F.col("top").isNotNull().alias("changed"))
            jumped = table(jumped, "jumped", rows=n)
            parent = jumped.select("hi", "lo")
            if not _changed(jumped):
                break
        nodes = parent.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        n_nodes += n
        if labels is None:
            labels = nodes
        else:
            up = parent.select(F.col("hi").alias("mid"), F.col("lo").alias("top"))
            old = labels.join(up, labels["root"] == up["mid"], "left").select("node", F.coalesce("top", "root").alias("root"))
            labels = table(old.unionByName(nodes.join(labels.select("node"), "node", "left_anti")), "labels", rows=n_nodes)
        left = table(_relabel(left, parent, n), "edges", rows=n)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    # Roots are nodes too.
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())


def _relabel(edges: DataFrame, parent: DataFrame, rows: int) -> DataFrame:
    a = parent.select(F.col("hi").alias("a"), F.col("lo").alias("a_root"))
    b = parent.select(F.col("hi").alias("b"), F.col("lo").alias("b_root"))
    half = table(edges.join(a, F.col("lo") == F.col("a"), "left").select(F.coalesce("a_root", "lo").alias("lo"), "hi"), "half", rows=rows)
    full = half.join(b, F.col("hi") == F.col("b"), "left").select("lo", F.coalesce("b_root", "hi").alias("hi"))
    return full.where(F.col("lo") != F.col("hi")).select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
