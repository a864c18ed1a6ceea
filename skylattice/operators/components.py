"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Every node hooks to the smallest node around it and then to that node's own hook; the edges
    between different hooks are the next, smaller graph. Each round at least halves the nodes
    that still have edges, so it runs until none is left. Hooks come from a map-side minimum, so
    a node with very many edges costs one row per task. Every round is written to the shared
    folder, which keeps the plan short and survives lost executors.
    """
    rest = materialize(
        edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct(), "edges"
    )
    hooks: list[DataFrame] = []
    while not rest.isEmpty():
        ends = rest.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a"), F.struct(F.col("b").alias("node"), "a"))).alias("e"))
        first = materialize(ends.groupBy("e.node").agg(F.min("e.a").alias("hook")), "hooks")
        second = first.select(F.col("node").alias("hook"), F.col("hook").alias("far"))
        hook = materialize(first.join(second, "hook").select("node", F.col("far").alias("hook")), "hooks")
        hooks.append(hook)
        left = rest.join(hook.select(F.col("node").alias("a"), F.col("hook").alias("p")), "a")
        both = left.join(hook.select(F.col("node").alias("b"), F.col("hook").alias("q")), "b").where("p <> q")
        rest = materialize(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    if not hooks:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = hooks[0].withColumnRenamed("hook", "component")
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("component"), F.col("hook").alias("next"))
        labels = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialize(labels, "components")
