"""Walks over edge tables: components, closure, shortest paths, ordered splices.

Every walk is a loop of joins over DataFrames. Each round is materialised in the shared
checkpoint folder, so the plan stays small and a lost executor costs one round. The number
of rounds is logarithmic for components and the length of the longest shortest path else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` with the least node of each component.

    ``nodes``: column node; ``edges``: columns a, b (any direction, repeats and loops
    allowed). Stars are rewired to their least node, in turns to larger and to smaller
    neighbours; a node with very many neighbours is a join key, never one group in memory.
    """
    links = cut(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        # larger neighbours of a node go to the least of its neighbourhood
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        # smaller neighbours of a node, and the node, go to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        links = cut(joined.unionAll(small.select("u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state.n, state.h):
            break
        before = (state.n, state.h)
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def bfs(edges: DataFrame, sources: DataFrame, stop: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """``source, node, dist, path`` of everything reachable from each source.

    ``edges``: src, dst, pos; ``sources``: column node; ``stop``: nodes that are recorded
    but not walked through (a source always is). A source is not its own result unless a
    cycle leads back to it, and then is not listed either. Of several shortest paths the
    one found first is kept: its edges come first by ``pos``. Cycles end at visited nodes.
    The walk goes on until nothing new is met, or as far as ``max_rounds`` asks.
    """
    start = sources.select(F.col("node").alias("source")).distinct()
    seen = start.select("source", F.col("source").alias("node"), F.lit(0).alias("dist"), F.array("source").alias("path"), F.array().cast("array<bigint>").alias("at"))
    seen = frontier = cut(seen)
    links = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("pos").cast("bigint").alias("pos"))
    blocked = stop.select(F.col("node").alias("from")).distinct() if stop is not None else None
    turn = 0
    while max_rounds is None or turn < max_rounds:
        turn += 1
        front = frontier.withColumn("from", F.col("node"))
        if blocked is not None and turn > 1:
            front = front.join(blocked, "from", "left_anti")
        step = front.join(links, "from").select("source", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"), F.concat("at", F.array("pos")).alias("at"))
        step = step.groupBy("source", "node").agg(F.min_by(F.struct("path", "at"), "at").alias("best"))
        fresh = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        frontier = cut(fresh.select("source", "node", F.lit(turn).alias("dist"), "best.path", "best.at"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("dist > 0").select("source", "node", "dist", "path")


def closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node`` reachable by one edge or more; a source is listed only if a cycle leads back to it."""
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    seen = frontier = cut(sources.select(F.col("node").alias("source")).distinct().join(links.withColumnRenamed("node", "source"), "source").select("source", F.col("next").alias("node")).distinct())
    while not frontier.isEmpty():
        step = frontier.join(links, "node").select("source", F.col("next").alias("node")).distinct()
        frontier = cut(step.join(seen, ["source", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def first_parents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, parent, dist``: the closure of the roots, each node with the parent that reaches it first.

    Roots come in the order of ``pos``, edges in the order of theirs.
    """
    order = Window.partitionBy("node").orderBy("pos")
    seen = roots.select("node", F.col("pos").cast("bigint").alias("pos")).withColumn("k", F.row_number().over(order)).filter("k = 1")
    seen = frontier = cut(seen.select("node", F.lit(None).cast(roots.schema["node"].dataType).alias("parent"), F.lit(0).alias("dist"), F.array("pos").alias("at")))
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("pos").cast("bigint").alias("pos"))
    turn = 0
    while not frontier.isEmpty():
        turn += 1
        step = frontier.join(links, "node").select(F.col("next").alias("node"), F.col("node").alias("parent"), F.concat("at", F.array("pos")).alias("at"))
        step = step.groupBy("node").agg(F.min_by(F.struct("parent", "at"), "at").alias("best")).join(seen.select("node"), "node", "left_anti")
        frontier = cut(step.select("node", "best.parent", F.lit(turn).alias("dist"), "best.at"))
        seen = seen.unionByName(frontier)
    return seen.select("node", "parent", "dist")


def splice(pieces: DataFrame, roots: DataFrame) -> DataFrame:
    """Document order of nested includes: ``root, node, place`` with the path of positions to sort by.

    ``pieces``: src, dst, pos. A node that already is on its own path is not entered again.
    """
    out = frontier = cut(roots.select(F.col("node").alias("root"), "node", F.array().cast("array<bigint>").alias("place"), F.array("node").alias("trail")))
    links = pieces.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("pos").cast("bigint").alias("pos"))
    while True:  # ends, as no trail holds a node twice
        step = frontier.join(links, "node").filter(~F.array_contains("trail", F.col("next")))
        frontier = cut(step.select("root", F.col("next").alias("node"), F.concat("place", F.array("pos")).alias("place"), F.concat("trail", F.array("next")).alias("trail")))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out.select("root", "node", "place")
