"""Entities by patterns, their relations within sentences, and links between documents that share entities or topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import spans
from docloom.operators.graph import kept

# Fixed patterns of the entity kinds, in the order in which they are tried, all in either case.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "URL": r'https?://[^\s<>"{}|\\^`\[\]]+',
    "DATE": r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b",
    "MONEY": r"[\$€£¥]\s*\d+(?:,\d{3})*(?:\.\d{2})?|\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:USD|EUR|GBP|dollars?|euros?)",
    "PERCENT": r"\b\d+(?:\.\d+)?%\b",
}
# Fixed patterns of relations, in the order in which they are tried on a sentence in lower case.
RELATIONS = {
    "is_X_of": r"(\w+)\s+(?:is|was|are|were)\s+(?:a|an|the)?\s*(\w+)\s+(?:of|for|at)\s+(\w+)",
    "works_at": r"(\w+)\s+(?:works?|worked)\s+(?:at|for)\s+(\w+)",
    "founded": r"(\w+)\s+(?:founded|started|created|established)\s+(\w+)",
    "acquired": r"(\w+)\s+(?:acquired|bought|purchased)\s+(\w+)",
    "merged_with": r"(\w+)\s+(?:merged|combined)\s+with\s+(\w+)",
    "located_in": r"(\w+)\s+(?:is|was)\s+(?:located|based|headquartered)\s+(?:in|at)\s+(\w+)",
}
HOT = 1000  #: an entity of more than 1 / HOT of all rows is frequent; fewer than HOT of them exist


def normal(hit: Column, kind: str) -> Column:
    if kind in ("EMAIL", "URL"):
        return F.lower(hit)
    return F.regexp_replace(hit, r"[^\d+]", "") if kind == "PHONE" else hit


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, type, entity, start_pos, end_pos of `docs` (doc_id, text): the first of each kind and normal form in a text."""

    def of(place: int, kind: str) -> Column:
        found = spans.find(F.col("text"), f"(?i){PATTERNS[kind]}")
        return F.transform(found, lambda x: F.struct(F.lit(place).alias("place"), x["start"].alias("start_pos"), x["stop"].alias("end_pos"), F.lit(kind).alias("type"), normal(x["hit"], kind).alias("entity"), x["hit"].alias("hit")))

    every = reduce(lambda a, b: F.concat(a, b), [of(i, k) for i, k in enumerate(PATTERNS)])
    rows = docs.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.*")
    first = rows.groupBy("doc_id", "type", F.lower("entity").alias("alike")).agg(F.min(F.struct("place", "start_pos", "end_pos", "entity", "hit")).alias("e"))
    return first.select("doc_id", "type", "e.entity", "e.start_pos", "e.end_pos", "e.place", "e.hit")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, type, n and the entities of each kind in order of position."""
    inorder = F.sort_array(F.collect_list(F.struct("start_pos", "entity")))
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.array_join(inorder["entity"], " | ").alias("entities"))


def relations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, sentence, subject, object, relation: pairs of a text's entities whose words stand in one sentence, as listed
    by kind and position, by the first verb pattern that the sentence matches. Sentences without one give no relation."""
    lines = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", r"[.!?]+")).alias("sentence", "words"))
    low = F.lower("words")
    label = F.coalesce(*(F.when(low.rlike(p), F.lit(name)) for name, p in RELATIONS.items()))
    telling = lines.select("doc_id", "sentence", low.alias("low"), label.alias("relation")).where("relation is not null")
    at = telling.join(found, "doc_id").where(F.col("low").contains(F.lower("hit")))
    order = F.struct("place", "start_pos", "entity")
    listed = at.groupBy("doc_id", "sentence", "relation").agg(F.sort_array(F.collect_list(order)).alias("e"))
    pairs = F.expr("flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> struct(x.entity as subject, y.entity as object))))")
    return listed.select("doc_id", "sentence", "relation", F.explode(pairs).alias("p")).select("doc_id", "sentence", "p.subject", "p.object", "relation")


def graph(found: DataFrame, related: DataFrame) -> DataFrame:
    """kind ('node' or 'edge'), doc_id, source, target, label: entities as nodes, numbered by kind and position in their
    document, and relations as edges between their numbers."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "start_pos")) - 1
    nodes = found.select("doc_id", "entity", "type", F.concat(F.lit("entity_"), number).alias("id"))
    ids = nodes.groupBy("doc_id", "entity").agg(F.min("id").alias("id"))
    a, b = (ids.select("doc_id", F.col("entity").alias(x), F.col("id").alias(y)) for x, y in (("subject", "source"), ("object", "target")))
    edges = related.join(a, ["doc_id", "subject"]).join(b, ["doc_id", "object"])
    return nodes.select(F.lit("node").alias("kind"), "doc_id", F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.col("type").alias("label")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "doc_id", "source", "target", F.col("relation").alias("label"))
    )


def sets(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, members: the documents of `rows` (doc_id, entity) with at least `least` different ones, rare before frequent."""
    each = kept(rows.select("doc_id", "entity").distinct())  # read twice
    counts = each.groupBy("entity").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.join(F.broadcast(total), F.col("n") * HOT > F.col("total")).select("entity", "n")  # fewer than HOT
    ranked = each.join(F.broadcast(hot), "entity", "left").select("doc_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "entity").alias("e"))
    grouped = ranked.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return grouped.select("doc_id", F.col("e.entity").alias("members")).where(F.size("members") >= least)


def paired(long: DataFrame, most: int | None = None) -> DataFrame:
    """a, m_a, b, m_b: pairs of rows of `long` (doc_id, members, entity) with the same entity and doc_ids a < b.

    The rows of an entity with more than `most` (a thousandth of all, 1,000 at least) are dealt to cells by doc_id, and each
    pair of cells is a key of its own: a row goes to as many tasks as there are cells, and no task has all rows of an entity.
    """
    long = kept(long)
    counts = long.groupBy("entity").agg(F.count("*").alias("n"))
    most = most or max(HOT, (long.count() + HOT - 1) // HOT)
    hot = F.broadcast(counts.where(F.col("n") > most).select("entity", F.ceil(F.col("n") / most).cast("int").alias("cells")))  # fewer than HOT
    dealt = long.join(hot, "entity", "left").withColumn("cells", F.coalesce("cells", F.lit(1))).withColumn("cell", F.pmod(F.xxhash64("doc_id"), "cells").cast("int"))
    left = dealt.select("entity", F.col("cell").alias("low"), F.explode(F.sequence("cell", F.col("cells") - 1)).alias("high"), F.col("doc_id").alias("x"), F.col("members").alias("m_x"))
    right = dealt.select("entity", F.explode(F.sequence(F.lit(0), "cell")).alias("low"), F.col("cell").alias("high"), F.col("doc_id").alias("y"), F.col("members").alias("m_y"))
    met = left.join(right, ["entity", "low", "high"]).where((F.col("x") < F.col("y")) | (F.col("low") < F.col("high")) & (F.col("x") > F.col("y")))
    first = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return met.select(pick("x", "y").alias("a"), pick("m_x", "m_y").alias("m_a"), pick("y", "x").alias("b"), pick("m_y", "m_x").alias("m_b"))


def links(rows: DataFrame, least: int, *, classes: bool = True, most: int | None = None) -> DataFrame:
    """a, b (a < b), shared, confidence: documents with at least `least` entities in common; shared / smaller set.

    Documents alike in their whole set are one class, told of by its least doc_id, and `members` says whom it stands for;
    without `classes` every document stands for itself. Two
    sets with `least` in common have one in common even without the `least` - 1 most frequent of each, so frequent entities
    seed pairs only where nothing rarer can. `most` is of `paired`.
    """
    return _linked(sets(rows, least), least, classes, most)


def _linked(each: DataFrame, least: int, classes: bool = True, most: int | None = None) -> DataFrame:
    """`links` of sets (doc_id, members)."""
    if classes:
        each = each.groupBy("members").agg(F.min("doc_id").alias("doc_id"))
    seeds = F.slice("members", 1, F.size("members") - (least - 1))
    long = each.select("doc_id", "members", F.explode(seeds).alias("entity"))
    both = F.array_intersect("m_a", "m_b")
    pairs = paired(long, most).select("a", "b", F.size(both).cast("long").alias("shared"), F.least(F.size("m_a"), F.size("m_b")).alias("smaller"))
    near = pairs.where(F.col("shared") >= least).dropDuplicates(["a", "b"])
    return near.select("a", "b", "shared", F.round(F.col("shared") / F.col("smaller"), 6).alias("confidence"))


def members(rows: DataFrame, least: int, salts: int = 16) -> DataFrame:
    """doc_id, representative, links: for each document with at least `least` entities, its class's least doc_id and the
    number of documents that share `least` entities with it, those of its own class (confidence 1) included.

    Two documents are linked if their representatives are equal or linked in `links`, with that confidence. The members
    of a large class are dealt over `salts` tasks. The sets are kept, so that the texts are searched once.
    """
    each = kept(sets(rows, least))
    classes = each.groupBy("members").agg(F.min("doc_id").alias("representative"), F.count("*").alias("size"))
    pairs = _linked(each, least).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    sizes = classes.select(F.col("representative").alias("other"), "size")
    reached = pairs.select(F.col("p.a").alias("representative"), F.col("p.b").alias("other")).join(sizes, "other").groupBy("representative").agg(F.sum("size").alias("others"))
    counted = classes.join(reached, "representative", "left").select("members", "representative", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    spread = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return dealt.join(spread, ["members", "salt"]).select("doc_id", "representative", "links")


def expanded(pairs: DataFrame, kind: str) -> DataFrame:
    """source, target, type, place, confidence, shared: links (a, b, shared, confidence) in both directions."""
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))
    return pairs.select(F.explode(both).alias("p"), "confidence", "shared").select("p.*", F.lit(kind).alias("type"), "confidence", "shared")


def merged(*kinds: DataFrame) -> DataFrame:
    """source, target, types, confidence, shared: links of several kinds to one target as one; kinds joined by '+' in the
    given order, the greatest confidence, and all that is shared."""
    listed = [k.withColumn("place", F.lit(i)) for i, k in enumerate(kinds)]
    every = reduce(DataFrame.unionByName, listed)
    types = F.sort_array(F.collect_list(F.struct("place", "type")))
    return every.groupBy("source", "target").agg(F.array_join(types["type"], "+").alias("types"), F.max("confidence").alias("confidence"), F.sum("shared").alias("shared"))


def undirected(links: DataFrame) -> DataFrame:
    """source, target, types, confidence: each pair once, in the direction of the lesser source that has it."""
    first = F.min(F.struct("source", "target", "types", "confidence"))
    return links.groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(first.alias("e")).select("e.*")
