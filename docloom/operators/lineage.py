"""Relationships between catalogued sources, and what each source descends from.

A relationship is an edge (source, target, type): `source` was made from, or belongs to, `target`. The lineage of all
sources is the transitive closure of these edges. A twig, a source that nothing descends from and that has one target, has
the ancestors of this target, one edge farther; so twigs are set aside, and again those of what is left, while they are
half of the edges or more. The rest is closed by path doubling: a round joins the paths known so far to themselves, so paths
of twice the length are known after it and a chain of n edges needs about log2(n) rounds. A source that reaches itself lies
on a cycle.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import folders


class Closure:
    """All pairs of sources with a path between them, and how many rounds it took to find them: `core` has the paths between
    sources that are no twigs, `layers` the edges of the twigs, the outermost first."""

    def __init__(self, core: DataFrame, rounds: int, layers: list[DataFrame]):
        self.core, self.rounds, self.layers = core, rounds, layers

    @cached_property
    def paths(self) -> DataFrame:
        """source, target, hops: the least number of edges. Only the paths that others go on from are written."""
        paths = self.core
        for i, twigs in reversed(list(enumerate(self.layers))):
            # A target on a cycle reaches itself, but is one edge away from its twig.
            beyond = paths.where("source <> target").select(F.col("source").alias("middle"), F.col("target").alias("end"), "hops")
            farther = twigs.join(beyond, F.col("target") == F.col("middle")).select("source", F.col("end").alias("target"), F.col("hops") + 1)
            own = twigs.select("source", "target", F.lit(1).alias("hops")).union(farther)
            paths = paths.union(folders.written(own, "paths") if i else own)
        return paths

    def ancestors(self) -> DataFrame:
        """source, target, hops: what each source descends from, itself left out, with the least number of edges."""
        return self.paths.where("source <> target")

    def cycles(self) -> DataFrame:
        """source, hops: sources that descend from themselves, with the length of the shortest cycle through each."""
        return self.core.where("source = target").select("source", "hops")


def shortest(paths: DataFrame) -> DataFrame:
    return paths.groupBy("source", "target").agg(F.min("hops").alias("hops"))


def closure(edges: DataFrame, *, types: list[str] | None = None, most_rounds: int = 64) -> Closure:
    """The closure of `edges` (source, target, type), or of those of some `types`.

    Edges with a null end lead nowhere and are left out; repeated edges count once. What a round finds is written as a
    compressed table, so a lost executor repeats one round, and tables that no later round reads are deleted. The search
    ends with a round that finds no path and shortens none; so cycles do not keep it going.
    """
    wanted = edges if types is None else edges.where(F.col("type").isin(types))
    rest = wanted.where("source is not null and target is not null").select("source", "target")
    layers: list[DataFrame] = []
    while True:
        told = folders.written(_told(rest), "edges")
        n = {r.twig: r["count"] for r in told.groupBy("twig").count().collect()}
        if n.get(True, 0) < max(1, n.get(False, 0)):
            break
        layers.append(told.where("twig").select("source", "target"))
        rest = told.where("not twig").select("source", "target")
    paths, rounds = _doubled(told.select("source", "target", F.lit(1).alias("hops")), most_rounds)
    return Closure(paths, len(layers) + rounds, layers)


def _told(edges: DataFrame) -> DataFrame:
    """source, target, twig: each edge once, and whether its source is a twig."""
    own = edges.repartition("source").distinct().withColumn("n", F.count("*").over(Window.partitionBy("source")))
    targets = edges.select(F.col("target").alias("node"), F.lit(True).alias("met")).distinct()
    return own.join(targets, F.col("source") == F.col("node"), "left").select("source", "target", ((F.col("n") == 1) & F.col("met").isNull()).alias("twig"))


def _doubled(paths: DataFrame, most_rounds: int) -> tuple[DataFrame, int]:
    """The shortest paths made of `paths` of one edge each, and the rounds it took."""
    for done in range(most_rounds + 1):
        # After k rounds all paths of up to 2 ** k edges are there. A shortest path with more edges begins with one of just
        # 2 ** k, and what follows is in `paths` too if it has up to as many; so only those need be prolonged.
        longest = paths.where(F.col("hops") == 2**done)
        if longest.isEmpty():
            return paths, done
        first = longest.select("source", F.col("target").alias("middle"), F.col("hops").alias("to_middle"))
        second = paths.select(F.col("source").alias("middle"), "target", "hops")
        longer = folders.written(first.join(second, "middle").select("source", "target", (F.col("to_middle") + F.col("hops")).alias("hops")), "longer")
        if longer.isEmpty():
            return paths, done + 1
        before, paths = paths, folders.written(shortest(paths.unionByName(longer)), "paths")
        for table in (longer, before) if done else (longer,):
            folders.deleted(table)
    raise RuntimeError(f"paths still grow after {most_rounds} rounds")


def summary(found: Closure) -> DataFrame:
    """target, n_sources, deepest: how many sources descend from each, and over how many edges at most.

    The paths of twigs are not made: twigs are counted where they hang, with all that hangs on them.
    """
    parts: list[DataFrame] = []

    def told(ways: DataFrame) -> DataFrame:
        """target, n_sources, deepest of `ways` (source, target, hops), with what hangs on their sources."""
        if parts:
            hung = _summed(reduce(DataFrame.union, parts)).withColumnRenamed("target", "node")
            ways = ways.join(hung, F.col("source") == F.col("node"), "left")
            n, deep = F.coalesce("n_sources", F.lit(0)), F.coalesce("deepest", F.lit(0))
        else:
            n, deep = F.lit(0), F.lit(0)
        return _summed(ways.select("target", (n + 1).cast("long").alias("n_sources"), (F.col("hops") + deep).alias("deepest")))

    for twigs in found.layers:
        parts.append(folders.written(told(twigs.withColumn("hops", F.lit(1))), "hung"))
    if not parts or not found.core.isEmpty():
        parts.append(told(found.core.where("source <> target")))
    return _summed(reduce(DataFrame.union, parts))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("target").agg(F.sum("n_sources").alias("n_sources"), F.max("deepest").alias("deepest"))


def relationships(edges: DataFrame) -> DataFrame:
    """type, n, n_sources, n_targets of the relationships (source, target, type)."""
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))
