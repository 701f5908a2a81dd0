"""Components of graphs: connected, strongly connected, and kept up to date as edges come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discarded, written


def least_labels(pulls: DataFrame) -> DataFrame:
    """node, label for the nodes of pulls (a, b): the least node from which labels come, where a takes those of b.

    Every round, a node takes the least label of its neighbours and then that label's own label, so that labels
    travel at least twice as far each round. Labels are written to shared storage, which
    cuts the lineage, and those of the round before are deleted; a hub's rows meet only in partial minima and in joins that adaptive execution can split.
    Both sides of all joins grow with the nodes, so that they meet by sort and merge: labels that are small enough for a broadcast would pass the driver in each join of each round.
    """
    ends = pulls.select(F.col("a").alias("node"), "b").union(pulls.select(F.col("b").alias("node"), F.col("b")))
    labels = held = written(ends.groupBy("node").agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = pulls.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near.hint("merge"), "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = written(lower.join(jump.hint("merge"), "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        discarded(held)
        held, labels = moved, moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: for each node of an edge, the least node that edges lead to, in either direction.

    Edges with a null end are ignored; loops make a node a component; repeated edges do no harm.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = written(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = least_labels(both)
    discarded(both)
    return labels.select("node", F.col("label").alias("component"))


def grown_components(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component, moved) after new edges come to a graph whose components are labels (node, component), by work that follows the new edges.

    New edges are taken as edges between old components, nodes not known yet being their own, and only those components are labelled anew; all other nodes
    keep their label. moved tells which nodes have another label than before, or are new. The result is that of
    connected_components() over all edges, old and new. Edges with a null end are ignored; without new edges nothing moves.
    """
    own = lambda c: F.coalesce(c, F.col("end"))
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()
    named = labels.select(F.col("node").alias("end"), "component")
    at = lambda df, c, name: df.withColumnRenamed(c, "end").join(named, "end", "left").withColumn(name, own(F.col("component"))).drop("component")
    between = at(at(ends, "a", "x").withColumnRenamed("end", "a_node"), "b", "y").withColumnRenamed("end", "b_node")
    between = written(between, "component-edges")
    merged = connected_components(between, "x", "y").withColumnRenamed("node", "old").withColumnRenamed("component", "new")
    fresh = between.select(F.col("a_node").alias("node"), F.col("x").alias("old")).union(between.select(F.col("b_node"), F.col("y"))).distinct()
    fresh = fresh.join(labels.select("node"), "node", "left_anti").join(merged, "old").select("node", F.col("new").alias("component"), F.lit(True).alias("moved"))
    kept = labels.join(merged, labels["component"] == merged["old"], "left")
    kept = kept.select("node", F.coalesce("new", "component").alias("component"), F.coalesce(F.col("new") != F.col("component"), F.lit(False)).alias("moved"))
    return kept.unionByName(fresh)


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst", trims: int = 3) -> DataFrame:
    """node, component: for each node of an edge, the least node that it reaches and that reaches it, along edges' direction; itself where it is on no cycle.

    Forward and backward colouring. Edges that can't be on a cycle, their start having no edge into it or their end none out of it, are trimmed a few
    times. A node's colour is then the least node that reaches it; only edges within a colour stay. Where the least node that a node reaches along these
    is its colour, both are on a cycle: that is a component. The rest goes on to the next round.

    Edges with a null end are ignored; loops and repeated edges do no harm.
    """
    every = written(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct(), "edges")
    nodes, found, live = every.select(F.col("s").alias("node")).union(every.select("d")).distinct(), None, every.where("s <> d")
    while True:
        for _ in range(trims):
            into, out = live.select(F.col("d").alias("s")).distinct(), live.select(F.col("s").alias("d")).distinct()
            live = live.join(into.hint("merge"), "s", "left_semi").join(out.hint("merge"), "d", "left_semi").select("s", "d")
        live = written(live, "live-edges")
        if live.isEmpty():
            break
        colours = least_labels(live.select(F.col("d").alias("a"), F.col("s").alias("b")))
        of = lambda end, name: colours.select(F.col("node").alias(end), F.col("label").alias(name)).hint("merge")  # noqa: E731, B023
        same = written(live.join(of("s", "x"), "s").join(of("d", "y"), "d").where("x = y").select("s", "d", "x"), "coloured-edges")
        back = least_labels(same.select(F.col("s").alias("a"), F.col("d").alias("b")))
        component = written(back.join(colours.withColumnRenamed("label", "colour").hint("merge"), "node").where("label = colour").select("node", F.col("colour").alias("component")), "components")
        found = component if found is None else found.unionByName(component)
        gone = component.select("node").hint("merge")
        live = same.select("s", "d").join(gone.withColumnRenamed("node", "s"), "s", "left_anti").join(gone.withColumnRenamed("node", "d"), "d", "left_anti")
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
