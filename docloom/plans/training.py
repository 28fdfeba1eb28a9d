"""Queries of prompts, training examples, summaries by length, and drawings of graphs and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, entities, rendering, templates, typed_graph
from docloom.plans.links import _found_sql
from docloom.plans.operations import _typed, _typed_sql
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query

_registry = templates.Registry()


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sql_text(text: str) -> str:
    """A text with line breaks as an SQL expression."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def _filled(name: str, **given: str) -> str:
    """A template as an SQL expression, with expressions in the places of its variables."""
    parts, at, text = [], 0, templates.TEMPLATES[name]
    for m in templates.VARIABLE.finditer(text):
        parts += [_sql_text(text[at : m.start()]), f"coalesce(CAST({given[m[1]]} AS VARCHAR), '')"]
        at = m.end()
    return " || ".join([*parts, _sql_text(text[at:])])


_query("prompt_templates", "documents", f"""
    SELECT doc_id, md5({_filled('rag_qa', context='left(text, 500)', question='source')}) AS qa_md5, md5({_filled('rag_summarize', context='text')}) AS summarize_md5,
        md5({_filled('document_analysis', filename="doc_id || '.txt'", context='text')}) AS analysis_md5 FROM documents""")(
    lambda d: d.select(
        "doc_id",
        F.md5(_registry.build("rag_qa", context=F.left("text", F.lit(500)), question=F.col("source"))).alias("qa_md5"),
        F.md5(_registry.build("rag_summarize", context=F.col("text"))).alias("summarize_md5"),
        F.md5(_registry.build("document_analysis", filename=F.concat("doc_id", F.lit(".txt")), context=F.col("text"))).alias("analysis_md5"),
    )
)
# What the props of an event would lack as the variables of a template.
_query("prompt_missing", "events", "SELECT event_id, array_to_string(list_filter(['filename', 'context'], lambda v: NOT list_contains(json_keys(props), v)), ',') AS missing FROM events")(
    lambda e: e.select("event_id", F.array_join(_registry.missing("document_analysis", F.from_json("props", "map<string,string>")), ",").alias("missing"))
)

_query("train_summaries", "documents", "SELECT doc_id, md5('Summarize the following document:' || chr(10) || chr(10) || left(text, 4096)) AS input_md5, md5(left(text, 200)) AS output_md5 FROM documents")(
    lambda d: templates.summarization_examples(d, F.left("text", F.lit(200))).select("doc_id", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))
)
_query("train_extraction", "documents", f"""
    WITH e AS (SELECT doc_id, type, '{{' || chr(10) || '  "' || type || '": [' || chr(10) || '    ' || string_agg(CAST(to_json(h) AS VARCHAR), ',' || chr(10) || '    ' ORDER BY start_pos, h) || chr(10) || '  ]' || chr(10) || '}}' AS output
        FROM ({_found_sql()}) GROUP BY doc_id, type),
    x AS (SELECT doc_id, type, 'Extract all ' || type || ' from the following document:' || chr(10) || chr(10) || left(text, 4096) AS input, output FROM e JOIN documents USING (doc_id))
    SELECT doc_id, type, md5(input) AS input_md5, md5(output) AS output_md5 FROM x WHERE length(input) BETWEEN 10 AND 4096 AND length(output) BETWEEN 5 AND 2048""")(
    lambda d: templates.extraction_examples(d, entities.entities(d)).select("doc_id", "type", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))
)
# Extractive summaries are tested on worked cases: SQL has no such thing. Every level has all its sentences here: with the
# operator's own limit, that of the reference's default configuration, the longer levels would repeat the medium one.
QUERIES["summary_levels"] = lambda spark, sf_dir: chunking.summary_levels(_read(spark, sf_dir, "documents"), most=max(chunking.LENGTHS.values()))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations and regions as the nodes and edges of a graph."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nodes = region.select(key("r-", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("xml").alias("format"), F.lit("category").alias("kind")).union(
        nation.select(key("n-", "n_nationkey"), F.col("n_name"), F.lit("csv"), F.lit("concept"))
    )
    return nodes, nation.select(key("n-", "n_nationkey").alias("source"), key("r-", "n_regionkey").alias("target"), F.lit("part_of").alias("type"))


def _head_sql(section: int, lines: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {section} AS section, '{i:04d}' AS place, '{line}' AS line" for i, line in enumerate(lines))


QUERIES["render_dot"] = lambda spark, sf_dir: rendering.dot(*_places(spark, sf_dir))
ORACLE_SQL["render_dot"] = f"""{_head_sql(0, ['digraph DataLineage {', '    rankdir=LR;'])}
    UNION ALL SELECT 1, 'r-' || r_regionkey, '    "r-' || r_regionkey || '" [label="' || r_name || '\\n(xml)" shape=ellipse];' FROM region
    UNION ALL SELECT 1, 'n-' || n_nationkey, '    "n-' || n_nationkey || '" [label="' || n_name || '\\n(csv)" shape=box];' FROM nation
    UNION ALL SELECT 2, 'n-' || n_nationkey || chr(9) || 'r-' || n_regionkey || chr(9) || 'part_of', '    "n-' || n_nationkey || '" -> "r-' || n_regionkey || '" [label="part_of"];' FROM nation
    UNION ALL {_head_sql(3, ['}'])}"""
QUERIES["render_mermaid"] = lambda spark, sf_dir: rendering.mermaid(*_places(spark, sf_dir))
ORACLE_SQL["render_mermaid"] = f"""{_head_sql(0, ['```mermaid', 'graph TD'])}
    UNION ALL SELECT 1, 'r-' || r_regionkey, '    r_' || r_regionkey || '["' || r_name || '"]' FROM region UNION ALL SELECT 1, 'n-' || n_nationkey, '    n_' || n_nationkey || '("' || n_name || '")' FROM nation
    UNION ALL SELECT 2, 'n-' || n_nationkey || chr(9) || 'r-' || n_regionkey || chr(9) || 'part_of', '    n_' || n_nationkey || ' -.->|part_of| r_' || n_regionkey FROM nation
    UNION ALL {_head_sql(3, ['```'])}"""
_query("render_pie", "documents", f"""{_head_sql(0, ['```mermaid', 'pie showData', '    title "Documents by Language"'])}
    UNION ALL SELECT 1, lang, '    "' || lang || '": ' || count(*) FROM documents GROUP BY lang UNION ALL {_head_sql(2, ['```'])}""")(
    lambda d: rendering.pie(d.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n")), "Documents by Language")
)
_query("render_markdown", "nation", f"{_head_sql(0, ['| n_name | n_regionkey |', '| --- | --- |'])} UNION ALL SELECT 1, n_name, '| ' || n_name || ' | ' || n_regionkey || ' |' FROM nation")(
    lambda n: rendering.markdown(n.select("n_name", "n_regionkey"), "n_name")
)


def _graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what ('node' or 'relation'), type, n: a graph's nodes by where they stand and its relations by type."""
    edges = _typed(spark, sf_dir)
    ways = typed_graph.adjacency(edges).groupBy("node").agg(F.bool_or(F.col("direction") == "in").alias("has_in"), F.bool_or(F.col("direction") == "out").alias("has_out"))
    kind = F.when(F.col("has_in") & F.col("has_out"), "inner").when(F.col("has_in"), "root").otherwise("leaf")
    nodes = ways.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))
    relations = edges.groupBy(F.col("relation").alias("type")).agg(F.count("*").alias("n"))
    return nodes.select(F.lit("node").alias("what"), "type", "n").unionByName(relations.select(F.lit("relation").alias("what"), "type", "n"))


QUERIES["onto_stats_types"] = _graph_counts
ORACLE_SQL["onto_stats_types"] = f"""
    WITH e AS ({_typed_sql}), i AS (SELECT target AS node FROM e UNION SELECT source FROM e WHERE bidirectional), o AS (SELECT source AS node FROM e UNION SELECT target FROM e WHERE bidirectional),
    k AS (SELECT coalesce(i.node, o.node) AS node, CASE WHEN i.node IS NOT NULL AND o.node IS NOT NULL THEN 'inner' WHEN i.node IS NOT NULL THEN 'root' ELSE 'leaf' END AS type FROM i FULL JOIN o ON i.node = o.node)
    SELECT 'node' AS what, type, count(*) AS n FROM k GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY relation"""
