"""Queries of whole evaluations, concepts, workflows and metrics, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import agents, chunking, evaluation, graph, search, stats, typed_graph
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query, _query2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, events = _read(spark, sf_dir, "embeddings"), _read(spark, sf_dir, "events")
    retrieval = evaluation.retrieval_by_label(search.top_k(e, e.where("vec_id % 100 = 0"), 10), e)
    latency = stats.indexed_quantiles(events.withColumn("all", F.lit("all")).withColumn("value", F.col("value") / 100), "value", "all").select("p50", "p95")
    return evaluation.overall(retrieval, QUERIES["eval_generation"](spark, sf_dir), latency)


QUERIES["eval_overall"] = eval_overall
ORACLE_SQL["eval_overall"] = f"""
    WITH r AS (SELECT avg(reciprocal_rank) AS mrr, avg(ndcg) AS ndcg, avg(context_precision) AS cp, avg(p1) AS p1 FROM ({ORACLE_SQL['eval_retrieval']})), g AS (SELECT avg(faithfulness) AS f, avg(relevancy) AS a FROM ({ORACLE_SQL['eval_generation']})),
    v AS (SELECT value / 100 AS v, row_number() OVER (ORDER BY value / 100) - 1 AS i, count(*) OVER () AS n FROM events WHERE value > 0), l AS (SELECT max(v) FILTER (i = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50, max(v) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95 FROM v),
    s AS (SELECT *, 0.25::DOUBLE * (mrr + ndcg) / 2 + 0.35::DOUBLE * (f + a) / 2 + 0.25::DOUBLE * cp + 0.15::DOUBLE * (1 - least(1.0::DOUBLE, p50 / 5)) AS score FROM r, g, l)
    SELECT round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade,
        concat_ws(' | ', CASE WHEN mrr < 0.5 THEN 'Low MRR indicates relevant documents not ranked highly' END, CASE WHEN f < 0.6 THEN 'Low faithfulness - answers may not be grounded in context' END, CASE WHEN p95 > 3.0 THEN 'High P95 latency may impact user experience' END, CASE WHEN a < 0.5 THEN 'Answers may not be relevant to user queries' END) AS issues,
        concat_ws(' | ', CASE WHEN score > 0.8 THEN 'Overall system performance is excellent' WHEN score > 0.6 THEN 'System performs adequately with room for improvement' ELSE 'System needs significant improvements' END, CASE WHEN p1 > 0.8 THEN 'Top-1 retrieval is highly accurate' END, CASE WHEN f > a THEN 'Consider improving query understanding for better relevancy' END) AS insights FROM s"""

QUERIES["onto_core"] = lambda spark, sf_dir: graph.core(spark)
ORACLE_SQL["onto_core"] = "SELECT * FROM (VALUES " + ", ".join([*(f"('{p}', NULL)" for p in graph.CORE), *(f"('{c}', '{p}')" for p, children in graph.CORE.items() for c in children)]) + ") AS t(node, parent)"
_query("onto_lookup", "nation", "SELECT name, max(id) AS id FROM (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation UNION ALL SELECT n_nationkey, lower(left(n_name, 2)) FROM nation) GROUP BY name")(
    lambda n: graph.lookup(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.left("n_name", F.lit(2))).alias("aliases")))
)


def _concepts(n: DataFrame, r: DataFrame) -> DataFrame:
    nations = n.select(F.col("n_name").alias("name"), F.concat(F.lit("nation "), "n_nationkey").alias("description"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")).alias("properties"))
    return nations.unionByName(r.select(F.col("r_name").alias("name"), F.concat(F.lit("region "), "r_regionkey").alias("description"), F.create_map(F.lit("key"), F.col("r_regionkey").cast("string")).alias("properties")))


def _is_a(n: DataFrame, r: DataFrame) -> DataFrame:
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("IS_A").alias("relation"))


_query2("onto_context", "nation", "region", """
    WITH c AS (SELECT n_name AS name, 'nation ' || n_nationkey AS d, n_nationkey AS k FROM nation UNION ALL SELECT r_name, 'region ' || r_regionkey, r_regionkey FROM region),
    e AS (SELECT n_name AS a, r_name AS b, 'IS_A' AS rel FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name, 'related' FROM nation JOIN region ON n_regionkey = r_regionkey),
    t AS (SELECT a, b, rel, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM e), l AS (SELECT a, string_agg('  - ' || b || ' (' || rel || '): ' || left(d, 100), chr(10) ORDER BY r) AS lines FROM t JOIN c ON b = name WHERE r <= 10 GROUP BY a)
    SELECT name, name || ': ' || d || chr(10) || '  - key: ' || k || coalesce(chr(10) || chr(10) || 'Related concepts:' || chr(10) || lines, '') AS context FROM c LEFT JOIN l ON a = name""")(lambda n, r: graph.contexts(_concepts(n, r), _is_a(n, r)))

_bounds = [*stats.LATENCY, None]
_buckets = ", ".join(f"({b}::DOUBLE)" if b is not None else "(NULL)" for b in _bounds)
_query("metric_quantile", "events", f"""
    WITH b AS (SELECT event_type, CAST(ts AS DATE) AS day, le, count(*) FILTER (le IS NULL OR value <= le) AS n FROM events, (VALUES {_buckets}) t(le) GROUP BY 1, 2, 3),
    k AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, 0.95::DOUBLE * max(n) OVER (PARTITION BY event_type, day) AS rank FROM b WINDOW w AS (PARTITION BY event_type, day ORDER BY le ASC NULLS LAST))
    SELECT event_type, day, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS value FROM k WHERE n >= rank AND before < rank""")(lambda e: stats.bucket_quantile(_bucketed(e), ["event_type", "day"], 0.95))


def _bucketed(e: DataFrame) -> DataFrame:
    """event_type, day, le, n: values up to each bound, and in all under a null bound."""
    counts = [F.struct(F.lit(b).cast("double").alias("le"), (F.count_if(F.col("value") <= b) if b is not None else F.count("*")).alias("n")) for b in _bounds]
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.array(*counts).alias("b")).select("event_type", "day", F.explode("b").alias("b")).select("event_type", "day", "b.le", "b.n")


_query("doc_result", "events", "SELECT event_id, coalesce(json_extract_string(props, '$.content'), '') AS raw_text, coalesce(json_extract_string(props, '$.summary'), '') AS summary, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, 0.0) AS extraction_confidence, coalesce(CAST(json_extract_string(props, '$.confidence') AS DOUBLE), 0.0) AS analysis_confidence FROM events")(
    lambda e: e.select("event_id", agents.result(F.col("props")).alias("r")).select("event_id", "r.extraction.raw_text", "r.analysis.summary", "r.confidence_scores.extraction_confidence", "r.confidence_scores.analysis_confidence")
)
_route = ORACLE_SQL["route_query"]
_query("workflow", "conversations", f"""
    WITH r AS ({_route}), m AS (SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    u AS (SELECT conv_id, turn, kind, n_steps, CASE WHEN next_role = 'assistant' THEN response END AS response, text FROM m JOIN r USING (conv_id, turn) WHERE role = 'user'),
    s AS (SELECT *, ((length(response) > 10)::INT + (length(response) > 50)::INT + (length(response) < 5000)::INT + contains(response, left(text, 20))::INT) / 4 AS checks FROM u),
    c AS (SELECT *, CASE WHEN response IS NULL THEN 0.0 WHEN kind <> 'analytical' THEN 0.85 WHEN checks = 1 THEN 0.95 ELSE 0.65 END AS confidence FROM s)
    SELECT conv_id, turn, kind, n_steps, response IS NOT NULL AS answered, round(confidence::DOUBLE, 6) AS confidence, kind = 'analytical' AND response IS NOT NULL AND confidence < 0.7 AS iterate FROM c""")(lambda c: agents.workflow(c))
_query("key_phrases", "documents", r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{3,}$')) AS w FROM documents), p AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS phrase, i FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
    n AS (SELECT doc_id, phrase, count(*) AS n, min(i) AS first FROM p GROUP BY 1, 2 HAVING count(*) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM n),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS rank FROM r WHERE r <= 20 AND split_part(phrase, ' ', 1) NOT IN ('the', 'of', 'in', 'to', 'and', 'for'))
    SELECT doc_id, rank, phrase, n FROM f WHERE rank <= 5""")(chunking.key_phrases)


def _typed(spark, sf_dir: str) -> DataFrame:
    """Nations are part of regions, customers live in nations, and suppliers trade with nations, which holds both ways."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    region, nation, customer, supplier = map(read, ("region", "nation", "customer", "supplier"))
    names = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("target"))
    part = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("part_of").alias("relation"), F.lit(False).alias("bidirectional"))
    lives = customer.join(names, F.col("c_nationkey") == F.col("key")).select(F.col("c_name").alias("source"), "target", F.lit("lives_in").alias("relation"), F.lit(False).alias("bidirectional"))
    trades = supplier.join(names, F.col("s_nationkey") == F.col("key")).select(F.col("s_name").alias("source"), "target", F.lit("trades_with").alias("relation"), F.lit(True).alias("bidirectional"))
    return part.unionByName(lives).unionByName(trades)


_typed_sql = """
    SELECT n_name AS source, r_name AS target, 'part_of' AS relation, false AS bidirectional FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT c_name, n_name, 'lives_in', false FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT s_name, n_name, 'trades_with', true FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
_TYPES = ["part_of", "trades_with"]
QUERIES["onto_related_typed"] = lambda spark, sf_dir: typed_graph.related(_typed(spark, sf_dir), "AFRICA", hops=2, types=_TYPES).select(
    "node", "hops", F.array_join("path", " > ").alias("path"), F.array_join("relations", " > ").alias("relations")
)
ORACLE_SQL["onto_related_typed"] = f"""
    WITH RECURSIVE e AS (SELECT * FROM ({_typed_sql}) WHERE relation IN ('part_of', 'trades_with')),
    w AS (SELECT source AS a, target AS b, relation FROM e UNION SELECT target, source, relation FROM e),
    p AS (SELECT 'AFRICA' AS node, 0 AS hops, ['AFRICA'] AS path, CAST([] AS VARCHAR[]) AS relations
        UNION ALL SELECT b, hops + 1, list_append(path, b), list_append(relations, relation) FROM p JOIN w ON a = p.node WHERE hops < 2 AND NOT list_contains(path, b))
    SELECT node, min(hops) AS hops, array_to_string(arg_min(path, (hops, path, relations)), ' > ') AS path, array_to_string(arg_min(relations, (hops, path, relations)), ' > ') AS relations FROM p GROUP BY node"""
QUERIES["onto_relations"] = lambda spark, sf_dir: typed_graph.adjacency(_typed(spark, sf_dir)).groupBy("node", "relation", "direction").agg(F.count("*").alias("n"), F.min("other").alias("first"))
ORACLE_SQL["onto_relations"] = f"""
    WITH e AS ({_typed_sql}), w AS (SELECT source AS node, target AS other, relation, 'out' AS direction FROM e UNION SELECT target, source, relation, 'in' FROM e
        UNION SELECT target, source, relation, 'out' FROM e WHERE bidirectional UNION SELECT source, target, relation, 'in' FROM e WHERE bidirectional)
    SELECT node, relation, direction, count(*) AS n, min(other) AS first FROM w GROUP BY node, relation, direction"""


def _imported(spark, sf_dir: str) -> DataFrame:
    """The names and aliases of nations and regions, and their ids, from one graph in JSON for each nation."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    key = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    node = lambda i, name, parent, aliases: F.struct(i.alias("node_id"), name.alias("name"), parent.alias("parent_id"), aliases.alias("aliases"))
    none = F.lit(None).cast("string")
    nodes = F.array(node(key("n", "n_nationkey"), F.col("n_name"), key("r", "r_regionkey"), F.array(F.left("n_name", F.lit(3)))), node(key("r", "r_regionkey"), F.col("r_name"), none, F.array().cast("array<string>")))
    edge = F.array(F.struct(key("n", "n_nationkey").alias("source_id"), key("r", "r_regionkey").alias("target_id"), F.lit("part_of").alias("relation_type"), F.lit(False).alias("bidirectional")))
    lines = both.select(F.to_json(F.struct(F.col("n_name").alias("name"), nodes.alias("nodes"), edge.alias("relations"))).alias("line"))
    return graph.lookup(typed_graph.imported(lines)[0])


QUERIES["onto_import"] = _imported
ORACLE_SQL["onto_import"] = """
    WITH n AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'n' || n_nationkey, left(n_name, 3) FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region JOIN nation ON n_regionkey = r_regionkey)
    SELECT lower(name) AS name, max(id) AS id FROM n GROUP BY lower(name)"""
