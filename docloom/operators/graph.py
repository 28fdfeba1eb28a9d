"""Graph and clustering operators: trees, neighbourhoods, shortest paths and k-means, one join or pass for each level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kept(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint where the session has a folder for them, else kept by the executors."""
    context = frame.sparkSession.sparkContext
    folder = context.getCheckpointDir() or frame.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return frame.checkpoint() if folder else frame.persist()


def tree_depths(nodes: DataFrame, *, deepest: int = 10) -> DataFrame:
    """node, root, depth (roots have 1) of `nodes` (node, parent; parent null for a root), down to `deepest` levels."""
    level = nodes.where("parent is null").select("node", F.col("node").alias("root"), F.lit(1).alias("depth"))
    levels = [level]
    while len(levels) < deepest:
        up = level.select(F.col("node").alias("parent"), "root", (F.col("depth") + 1).alias("depth"))
        level = kept(nodes.join(up, "parent").select("node", "root", "depth"))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def reachable(edges: DataFrame, start: str, *, hops: int = 2, until: str | None = None) -> DataFrame:
    """node, hops, path: all nodes within so many undirected `edges` (source, target) of `start`, with the shortest path there,
    the least of equal ones. A frontier is joined at each hop; nodes met before are left out. The search ends early when
    the frontier is empty or holds `until`."""
    both = kept(undirected(edges))
    known = edges.sparkSession.createDataFrame([(start, 0, [start])], "node string, hops int, path array<string>")
    frontier = known
    for hop in range(1, hops + 1):
        step = both.join(frontier.select(F.col("node").alias("source"), "path"), "source").groupBy(F.col("target").alias("node")).agg(F.min("path").alias("path"))
        frontier = kept(step.join(known.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), F.concat("path", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if until is not None and not frontier.where(F.col("node") == until).isEmpty():
            break
    return known


def shortest(edges: DataFrame, start: str, end: str, *, most: int = 10) -> DataFrame:
    """hops, path: the shortest way between two nodes over undirected `edges`, the least of equal ones; no row if it needs
    more than `most` steps."""
    return reachable(edges, start, hops=most, until=end).where(F.col("node") == end).select("hops", "path")


def lookup(nodes: DataFrame) -> DataFrame:
    """name, node: the node that each name or alias of `nodes` (id, name, aliases) stands for, in lower case; the last wins."""
    names = nodes.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return names.groupBy(F.lower("name").alias("name")).agg(F.max("id").alias("id"))


def contexts(nodes: DataFrame, edges: DataFrame, *, most: int = 10) -> DataFrame:
    """name, context: for each of `nodes` (name, description, properties) a text of its properties and up to `most` neighbours
    by undirected `edges` (source, target, relation), by name, with the relations that lead to them or "related"."""
    out = edges.groupBy("source", "target").agg(F.array_join(F.sort_array(F.collect_set("relation")), ", ").alias("relation"))
    near = undirected(edges).join(out, ["source", "target"], "left").withColumn("relation", F.coalesce("relation", F.lit("related")))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    top = near.withColumn("rank", rank).where(F.col("rank") <= most)
    told = top.join(nodes.select(F.col("name").alias("target"), "description"), "target")
    line = F.concat(F.lit("  - "), "target", F.lit(" ("), "relation", F.lit("): "), F.left("description", F.lit(100)))
    listed = told.groupBy(F.col("source").alias("name")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))["line"], "\n").alias("lines"))
    own = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"]))
    head = F.array_join(F.concat(F.array(F.concat("name", F.lit(": "), "description")), own), "\n")
    return nodes.join(listed, "name", "left").select("name", F.concat_ws("\n", head, F.when(F.col("lines").isNotNull(), F.concat(F.lit("\nRelated concepts:\n"), "lines"))).alias("context"))


# The seed concepts and the concepts under them.
CORE = {
    "document": ["pdf", "image", "text", "spreadsheet"],
    "entity": ["person", "organization", "location", "date", "money"],
    "action": ["extract", "analyze", "summarize", "translate", "classify"],
}


def core(spark: SparkSession) -> DataFrame:
    """node, parent: the seed graph, one edge for each concept under another."""
    rows = [(parent, None) for parent in CORE] + [(child, parent) for parent, children in CORE.items() for child in children]
    return spark.createDataFrame(rows, "node string, parent string")


def distances(centroids: Sequence[Sequence[float]]) -> Column:
    """array<struct<d, cluster>>: the squared distances of `embedding` to centroids, which are literals of the plan."""
    at = lambda c: F.array(*map(F.lit, map(float, c)))
    squared = lambda c: F.aggregate(F.zip_with("embedding", at(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return F.array(*(F.struct(squared(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)))


def nearest(centroids: Sequence[Sequence[float]]) -> Column:
    """The number of the centroid nearest to `embedding`, the least of equal ones."""
    return F.array_min(distances(centroids))["cluster"]


def kmeans_step(vectors: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """cluster, n, centroid: one Lloyd step of `vectors` (embedding) from given centroids; clusters left empty are not returned.

    Every coordinate is one partial sum, so that only k rows for each partition are shuffled.
    """
    assigned = vectors.select(nearest(centroids).alias("cluster"), "embedding")
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(len(centroids[0]))]
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*means).alias("centroid"))


def kmeans(vectors: DataFrame, centroids: Sequence[Sequence[float]], *, most: int = 100, tolerance: float = 1e-9) -> list[list[float]]:
    """Centroids when they no longer move, or after `most` steps; a cluster left empty keeps its centroid."""
    now = [list(map(float, c)) for c in centroids]
    for _ in range(most):
        moved = {r.cluster: r.centroid for r in kmeans_step(vectors, now).toLocalIterator()}
        after = [moved.get(i, c) for i, c in enumerate(now)]
        if max(abs(x - y) for a, b in zip(now, after, strict=True) for x, y in zip(a, b, strict=True)) <= tolerance:
            return after
        now = after
    return now


def clusters(vectors: DataFrame, topics: DataFrame, start: Sequence[Sequence[float]], *, keywords: int = 5) -> DataFrame:
    """cluster, n, keyword, n_keyword, rank: k-means clusters of `vectors` (doc_id, embedding) from given centroids, and the
    most frequent of `topics` (doc_id, topic) in each; a cluster without topics has one row with keyword null."""
    assigned = vectors.select("doc_id", nearest(kmeans(vectors, start)).alias("cluster"))
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    counts = assigned.join(topics, "doc_id").groupBy("cluster", "topic").agg(F.count("*").alias("n_keyword"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n_keyword").desc(), "topic"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= keywords).withColumnRenamed("topic", "keyword")
    return sizes.join(top, "cluster", "left").select("cluster", "n", "keyword", "n_keyword", "rank")


def neighbours(nodes: DataFrame, node: str) -> DataFrame:
    """direction, node: the parent (out) and the children (in) of one node of a tree (node, parent)."""
    out = nodes.where((F.col("node") == node) & F.col("parent").isNotNull()).select(F.lit("out").alias("direction"), F.col("parent").alias("node"))
    return out.unionByName(nodes.where(F.col("parent") == node).select(F.lit("in").alias("direction"), "node"))
