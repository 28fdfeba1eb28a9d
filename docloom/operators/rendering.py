"""Graphs and tables as lines of text: DOT, Mermaid and Markdown.

A drawing is rows (section, place, line): sorted by these it is the text, which `written` writes as one file. No line is
put together with others in a task, so a graph of any size can be rendered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How edges of a relation are drawn in Mermaid; others are plain arrows.
ARROWS = {"is_a": "-->", "part_of": "-.->", "relates_to": "---", "contains": "==>"}
#: Formats that are drawn as boxes.
STRUCTURED = ("csv", "xlsx")


def _lines(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, f"{i:04d}", line) for i, line in enumerate(lines)], "section int, place string, line string")


def _each(rows: DataFrame, section: int, place: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), place.cast("string").alias("place"), line.alias("line"))


def _quoted(text: Column) -> Column:
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit('"'), F.lit('\\"'))


def dot(nodes: DataFrame, edges: DataFrame, *, name: str = "DataLineage") -> DataFrame:
    """The lines of a DOT graph from `nodes` (id, name, format) and `edges` (source, target, type): nodes by id, edges by their
    ends and type."""
    spark = nodes.sparkSession
    shape = F.when(F.col("format").isin(*STRUCTURED), "box").otherwise("ellipse")
    node = F.concat(F.lit('    "'), _quoted(F.col("id")), F.lit('" [label="'), _quoted(F.col("name")), F.lit("\\n("), F.coalesce("format", F.lit("")), F.lit(')" shape='), shape, F.lit("];"))
    edge = F.concat(F.lit('    "'), _quoted(F.col("source")), F.lit('" -> "'), _quoted(F.col("target")), F.lit('" [label="'), _quoted(F.col("type")), F.lit('"];'))
    parts = [_lines(spark, 0, [f"digraph {name} {{", "    rankdir=LR;"]), _each(nodes, 1, F.col("id"), node), _each(edges, 2, F.concat_ws("\t", "source", "target", "type"), edge), _lines(spark, 3, ["}"])]
    return reduce(DataFrame.unionByName, parts)


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a Mermaid graph from `nodes` (id, name, kind: category, concept or other) and `edges` (source, target, type)."""
    spark = nodes.sparkSession
    safe = lambda c: F.replace(F.col(c).cast("string"), F.lit("-"), F.lit("_"))
    box = lambda a, b: F.concat(F.lit(f'{a}"'), _quoted(F.col("name")), F.lit(f'"{b}'))
    drawn = F.when(F.col("kind") == "category", box("[", "]")).when(F.col("kind") == "concept", box("(", ")")).otherwise(box("{", "}"))
    arrow = F.coalesce(*(F.when(F.col("type") == t, F.lit(a)) for t, a in ARROWS.items()), F.lit("-->"))
    edge = F.concat(F.lit("    "), safe("source"), F.lit(" "), arrow, F.lit("|"), F.col("type"), F.lit("| "), safe("target"))
    parts = [_lines(spark, 0, ["```mermaid", "graph TD"]), _each(nodes, 1, F.col("id"), F.concat(F.lit("    "), safe("id"), drawn)), _each(edges, 2, F.concat_ws("\t", "source", "target", "type"), edge), _lines(spark, 3, ["```"])]
    return reduce(DataFrame.unionByName, parts)


def pie(counts: DataFrame, title: str) -> DataFrame:
    """The lines of a Mermaid pie chart of `counts` (name, n)."""
    row = F.concat(F.lit('    "'), _quoted(F.col("name")), F.lit('": '), F.col("n").cast("string"))
    head = ["```mermaid", "pie showData", f'    title "{title}"']
    return reduce(DataFrame.unionByName, [_lines(counts.sparkSession, 0, head), _each(counts, 1, F.col("name"), row), _lines(counts.sparkSession, 2, ["```"])])


def markdown(table: DataFrame, key: str) -> DataFrame:
    """The lines of a Markdown table of `table`, by `key`; bars in values are escaped, nulls are empty."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, table.columns)), F.lit(" |"))
    head = [line(table.columns), line(["---"] * len(table.columns))]
    return _lines(table.sparkSession, 0, head).unionByName(_each(table, 1, F.col(f"`{key}`"), row))


def written(lines: DataFrame, path: str) -> None:
    """The drawing as text files below `path` that are the text in the order of their names."""
    lines.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("line").write.text(path)
