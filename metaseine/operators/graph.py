"""Graph operators over node and edge tables (graph, node), (graph, src, dst), for graphs of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The types that count as outputs, and those that only pass a link on.
OUTPUT_PATTERN = r"(?i)save|preview|show|display|video_?combine|compar|websocket|writer"
RELAY_NAMES = ("SetNode", "GetNode")
#: Nodes of a name and side in one block, about; edges that one task makes, about.
BLOCK = 2048
TASK_EDGES = 1 << 23


def is_output(kind: Column) -> Column:
    return F.coalesce(kind.rlike(OUTPUT_PATTERN), F.lit(False))


def is_relay(kind: Column) -> Column:
    return F.coalesce(F.contains(F.lower(kind), F.lit("reroute")) | kind.isin(*RELAY_NAMES), F.lit(False))


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different nodes that both exist."""
    keys = nodes.select("graph", "node")
    some = edges.where("src <> dst")
    return some.join(keys.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi").join(keys.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi")


def named_edges(nodes: DataFrame) -> DataFrame:
    """(graph, src, dst) from each node that sets a name to those of its graph that get it; of nodes (graph, node, type, name).

    The edges are counted first, name by name. Each side of a name is split into blocks by a hash of the node, and every block of one side meets every
    block of the other in a cell of its own; cells are dealt to as many tasks as the edges need, so a few names that very many nodes share are work for all.
    """
    from ..sources.state import written

    setter, getter = RELAY_NAMES
    told = nodes.where(F.col("graph").isNotNull() & F.col("name").isNotNull() & F.col("type").isin(*RELAY_NAMES))
    counts = told.groupBy("graph", "name").agg(F.count_if(F.col("type") == setter).alias("sets"), F.count_if(F.col("type") == getter).alias("gets"))
    names = written(counts.where("sets > 0 and gets > 0"))
    edges = names.agg(F.sum(F.col("sets").cast("double") * F.col("gets"))).first()[0] or 0
    tasks = int(-(-edges // TASK_EDGES))

    def dealt(kind: str, end: str, own: str, other: str) -> DataFrame:
        """The nodes of a type, each in its block and once for each block of the other side."""
        rows = names.join(told.where(F.col("type") == kind), ["graph", "name"])
        block, others = F.pmod(F.xxhash64("node"), F.ceil(F.col(own) / BLOCK)), F.sequence(F.lit(1).cast("long"), F.ceil(F.col(other) / BLOCK))
        cells = rows.select("graph", "name", (block + 1).alias(own), F.explode(others).alias(other), F.col("node").alias(end))
        return cells.repartition(tasks, "graph", "name", "sets", "gets") if tasks > 1 else cells

    sets, gets = dealt(setter, "src", "sets", "gets"), dealt(getter, "dst", "gets", "sets")
    return sets.join(gets, ["graph", "name", "sets", "gets"]).select("graph", "src", "dst")


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes with a live edge."""
    ends = live_edges(edges, nodes).select("graph", F.explode(F.array("src", "dst")).alias("node"))
    return nodes.join(ends, ["graph", "node"], "left_semi")


def contract(edges: DataFrame, via: DataFrame, rounds: int = 60) -> DataFrame:
    """(graph, src, dst) of edges, and of paths all of whose inner nodes are in ``via`` (graph, node); no end is in ``via``, no edge a loop.

    Paths are extended from their ends: a round takes those that end in ``via`` two steps on by the paths that start there, whose lengths double, so
    chains of n nodes take log n rounds. Each round is written and read back.
    """
    from ..sources.state import new_folder, remove, written

    spark = edges.sparkSession
    base = new_folder(spark)

    keys = via.select("graph", "node").distinct()
    start, end = keys.withColumnRenamed("node", "src"), keys.withColumnRenamed("node", "dst")
    plain = edges.select("graph", "src", "dst").distinct()
    outer = plain.join(start, ["graph", "src"], "left_anti")
    direct = outer.join(end, ["graph", "dst"], "left_anti")
    into = outer.join(end, ["graph", "dst"], "left_semi").select("graph", "src", "dst")
    # hops (src in via, dst anywhere): the nodes that a path inside via leads to
    hops = written(plain.join(start, ["graph", "src"], "left_semi").where("src <> dst").select("graph", "src", "dst"), f"{base}/0")
    size = hops.count()
    for k in range(1, rounds + 1):
        further = hops.select("graph", "src", F.col("dst").alias("m")).join(hops.select("graph", F.col("src").alias("m"), "dst"), ["graph", "m"]).select("graph", "src", "dst")
        hops = written(hops.union(further).where("src <> dst").distinct(), f"{base}/{k}")
        remove(spark, f"{base}/{k - 1}")
        before, size = size, hops.count()
        if size == before:
            break
    else:
        raise RuntimeError(f"no fixed point of the contraction after {rounds} rounds")
    ends = hops.join(end, ["graph", "dst"], "left_anti").select("graph", F.col("src").alias("v"), F.col("dst").alias("d"))
    led = into.select("graph", "src", F.col("dst").alias("v")).join(ends, ["graph", "v"]).select("graph", "src", F.col("d").alias("dst"))
    return direct.select("graph", "src", "dst").union(led).where("src <> dst").distinct()


def reaching(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """(graph, node): the seeds that have an incoming edge, and all that reach them. Each round writes what is new in it."""
    from ..sources.state import written

    front = written(edges.select("graph", F.col("dst").alias("node")).distinct().join(seeds.select("graph", "node"), ["graph", "node"], "left_semi"))
    seen = front  # a union of written tables, one a round
    for k in range(rounds):
        if front.isEmpty():
            return seen
        up = edges.join(front.withColumnRenamed("node", "dst"), ["graph", "dst"]).select("graph", F.col("src").alias("node")).distinct()
        front = written(up.join(seen, ["graph", "node"], "left_anti"))
        seen = seen.union(front)
        if k % 16 == 15:  # few enough tables
            seen = written(seen)
    raise RuntimeError(f"paths of more than {rounds} edges")


def connected(nodes: DataFrame, edges: DataFrame, mode: str = "linked") -> DataFrame:
    """``linked``: nodes with an edge; ``output``: nodes that reach an output (column is_output), or as linked where a graph has none wired."""
    if mode == "linked":
        return linked(nodes, edges)
    live = live_edges(edges, nodes)
    kept = reaching(live, nodes.where("is_output"))
    rest = nodes.join(kept.select("graph").distinct(), "graph", "left_anti")
    return nodes.join(kept, ["graph", "node"], "left_semi").unionByName(linked(rest, live))
