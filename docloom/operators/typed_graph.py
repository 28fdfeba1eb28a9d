"""Graphs whose edges have a type and may hold both ways, and their import from nested JSON.

Edges are rows (source, target, relation, bidirectional). An index has one row for each way an edge can be followed, so
questions of one node are a filter of it and a search over several steps a join with it at each step, in which only the
allowed relations take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.graph import kept

GRAPH = (
    "name string, nodes array<struct<node_id:string,name:string,parent_id:string,aliases:array<string>>>, "
    "relations array<struct<source_id:string,target_id:string,relation_type:string,bidirectional:boolean>>"
)


def adjacency(edges: DataFrame) -> DataFrame:
    """node, other, relation, direction: every edge from its source (out) and from its target (in); edges that hold both ways
    are out and in at both ends. Repeated edges count once; edges with a null end are left out."""
    both_ways = F.coalesce("bidirectional", F.lit(False))
    there = F.struct(F.col("source").alias("node"), F.col("target").alias("other"))
    back = F.struct(F.col("target").alias("node"), F.col("source").alias("other"))
    way = lambda ends, direction: F.struct(ends["node"].alias("node"), ends["other"].alias("other"), F.lit(direction).alias("direction"))
    ways = F.array(way(there, "out"), way(back, "in"))
    every = F.when(both_ways, F.concat(ways, F.array(way(back, "out"), way(there, "in")))).otherwise(ways)
    given = edges.where("source is not null and target is not null")
    return given.select(F.explode(every).alias("w"), "relation").select("w.node", "w.other", "relation", "w.direction").distinct()


def relations(edges: DataFrame, node: str, *, direction: str | None = None, types: list[str] | None = None) -> DataFrame:
    """direction, relation, other: what one node is related to, one way or both, by all relations or some."""
    found = adjacency(edges).where(F.col("node") == node)
    if direction is not None:
        found = found.where(F.col("direction") == direction)
    if types is not None:
        found = found.where(F.col("relation").isin(types))
    return found.select("direction", "relation", "other")


def related(edges: DataFrame, start: str, *, hops: int = 2, types: list[str] | None = None, until: str | None = None) -> DataFrame:
    """node, hops, path, relations: the nodes within so many steps of `start` by the allowed relations, either way.

    `path` and `relations` are the nodes and the relations on the shortest way, the least of equal ones. The search ends early
    when nothing new is met, or `until` is. Each step joins only the nodes met in the last one.
    """
    index = adjacency(edges) if types is None else adjacency(edges.where(F.col("relation").isin(types)))
    ways = kept(index.select("node", "other", "relation").distinct())
    met = edges.sparkSession.createDataFrame([(start, 0, [start], [])], "node string, hops int, path array<string>, relations array<string>")
    frontier = met
    for hop in range(1, hops + 1):
        longer = ways.join(frontier.select("node", "path", "relations"), "node")
        way = F.struct("path", F.concat("relations", F.array("relation")).alias("relations"))
        step = longer.groupBy(F.col("other").alias("node")).agg(F.min(way).alias("way"))
        new = step.join(met.select("node"), "node", "left_anti")
        frontier = kept(new.select("node", F.lit(hop).alias("hops"), F.concat("way.path", F.array("node")).alias("path"), F.col("way.relations").alias("relations")))
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)
        if until is not None and not frontier.where(F.col("node") == until).isEmpty():
            break
    return met


def imported(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, parent, aliases) and edges (source, target, relation, bidirectional) of graphs in JSON, one to each of
    `lines` (line); lines that are none have neither.

    A node or edge that several graphs hold counts once; of a node's unlike copies the one with the greatest name stands. An
    edge holds both ways if any copy says so.
    """
    graphs = lines.select(F.from_json("line", GRAPH).alias("g")).select("g.*")
    nodes = graphs.select(F.explode("nodes").alias("n")).where("n.node_id is not null")
    best = nodes.groupBy(F.col("n.node_id").alias("id")).agg(F.max(F.struct("n.name", "n.parent_id", "n.aliases")).alias("n"))
    edges = graphs.select(F.explode("relations").alias("r")).select("r.source_id", "r.target_id", "r.relation_type", F.coalesce("r.bidirectional", F.lit(False)).alias("both"))
    joined = edges.groupBy(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("relation")).agg(F.bool_or("both").alias("bidirectional"))
    return best.select("id", "n.name", F.col("n.parent_id").alias("parent"), F.coalesce("n.aliases", F.array().cast("array<string>")).alias("aliases")), joined
