"""Import graphs: impact, cycles and pass-through chains, by bounded rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written


def impact_layers(edges: DataFrame, seeds: DataFrame, layers: int = 12, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, layer: nodes that reach a seed against the edges' direction, by the fewest edges, seeds (layer 0) not among them.

    The number of layers is part of the operator. Each round joins the frontier alone with the edges; every round's result
    is written to the shared folder.
    """
    back = edges.select(F.col(dst).alias("node"), F.col(src).alias("next")).distinct()
    seen = seeds.select("node").distinct().withColumn("layer", F.lit(0))
    frontier, found = seen, []
    for k in range(1, layers + 1):
        step = frontier.select("node").join(back, "node").select(F.col("next").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("layer", F.lit(k))
        frontier = written(frontier, "impact")
        if frontier.isEmpty():
            break
        found.append(frontier)
        seen = seen.unionByName(frontier)
    return seen.where("layer > 0")


def simple_cycles(edges: DataFrame, longest: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """size, path: all simple cycles of 2 to `longest` nodes, once each, as an array that begins with its least node.

    Paths grow from their least node on by joins, a column for each node, and close back on it; the length bound is part of the operator.
    """
    e = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct(), "edges")
    paths = e.where("b > a").select(F.col("a").alias("n0"), F.col("b").alias("n1"))
    out = None
    for size in range(2, longest + 1):
        nodes = [f"n{k}" for k in range(size)]
        closing = paths.join(e, (F.col(nodes[-1]) == F.col("a")) & (F.col("n0") == F.col("b")))
        found = closing.select(F.lit(size).alias("size"), F.array(*nodes).alias("path"))
        out = found if out is None else out.unionByName(found)
        if size < longest:
            grown = paths.join(e, F.col(nodes[-1]) == F.col("a")).where((F.col("b") > F.col("n0")) & ~F.col("b").isin(*[F.col(n) for n in nodes[1:]]))
            grown = grown.select(*nodes, F.col("b").alias(f"n{size}"))
            # The longest ones, by far the most, are read once, to close them.
            paths = written(grown, "paths") if size + 1 < longest else grown
    return out


def pass_chains(edges: DataFrame, longest: int = 12, shortest: int = 2) -> DataFrame:
    """depth, path: maximal simple forward paths along edges (src, dst), at least `shortest` edges, that start at any edge.

    A path ends where no edge leads on to a node that it doesn't hold, or at `longest` edges.
    """
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
    paths = e.select(F.array("a", "b").alias("path"), F.col("b").alias("last"))
    done = None
    for size in range(1, longest + 1):
        if size == longest:
            ended = paths
        else:
            grown = paths.join(e, F.col("last") == F.col("a")).where(~F.array_contains("path", F.col("b")))
            grown = written(grown.select("path", F.concat("path", F.array("b")).alias("longer"), F.col("b").alias("last")), "chains")
            ended = paths.join(grown.select("path").distinct(), "path", "left_anti")
        if size >= shortest:
            rows = ended.select(F.lit(size + 1).alias("depth"), "path")
            done = rows if done is None else done.unionByName(rows)
        if size < longest:
            paths = grown.select(F.col("longer").alias("path"), "last")
            if grown.isEmpty():
                break
    return done if done is not None else paths.select(F.lit(0).alias("depth"), "path").limit(0)
