"""Queries of retrieval, evaluation reports, agents, ontology triples and counters, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import agents, chunking, evaluation, graph, search, text, windows
from docloom.plans.documents import _nodes, _paired, _pairs, _read, _tokens
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query, _query2

_asked = lambda e: e.where("vec_id % 100 = 0")
_top = ORACLE_SQL["vector_topk"]

# Longest common subsequences have no SQL: tests hold these against a table-filling version.
QUERIES["eval_rouge_l"] = lambda spark, sf_dir: _paired(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents")).select("item_id", F.round(evaluation.rouge_l(F.col("b"), F.col("d")), 6).alias("rouge_l"))


def _judge(spark, sf_dir: str) -> DataFrame:
    pairs = _paired(_read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents"))
    scores = pairs.select(*evaluation.judged(F.col("b"), F.col("b"), F.col("d")))
    return scores.agg(*(F.round(F.avg(c), 6).alias(c) for c in scores.columns))


QUERIES["eval_judge"] = _judge


def _index(spark, sf_dir: str) -> DataFrame:
    pieces = chunking.chunks(_read(spark, sf_dir, "documents"))
    return pieces.select(F.format_string("%d_chunk_%d", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "content", text.mock_embedding(F.col("content")).alias("embedding"))


QUERIES["index_documents"] = _index

_query("eval_cost", "documents", f"SELECT lang, count(*) AS n, round(avg(1.3::DOUBLE * len({_tokens.format('text')})), 6) AS mean_tokens, round(avg(1.3::DOUBLE * len({_tokens.format('text')})) / 1000 * 0.002::DOUBLE, 9) AS mean_cost FROM documents GROUP BY lang")(
    lambda d: evaluation.cost(d, "lang")
)
_query("eval_compare", "events", """
    WITH m AS (SELECT event_type AS metric, round(avg(value) FILTER (ts < '2024-01-16'), 6) AS baseline, round(avg(value) FILTER (ts >= '2024-01-16'), 6) AS enhanced FROM events GROUP BY 1),
    c AS (SELECT *, CASE WHEN baseline > 0 THEN round((enhanced - baseline) / baseline * 100, 6) END AS change FROM m)
    SELECT *, CASE WHEN change > 5 THEN 'better' WHEN change < -5 THEN 'worse' ELSE 'same' END AS verdict FROM c WHERE baseline IS NOT NULL AND enhanced IS NOT NULL""")(
    lambda e: evaluation.compared(*(e.where(f"ts {op} '2024-01-16'").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value")) for op in ("<", ">=")))
)
_query("dataset_quality", "documents", f"""
    WITH s AS (SELECT split, source, left(text, 40) AS q, text FROM ({ORACLE_SQL['split_stratified']}) JOIN documents USING (doc_id)),
    w AS (SELECT split, unnest({_tokens.format('text')}) AS w FROM s), d AS (SELECT split, least(1, 2 * count(DISTINCT w) / count(*)) AS diversity FROM w GROUP BY split),
    c AS (SELECT split, source, count(*) AS k FROM s GROUP BY ALL), b AS (SELECT split, CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(0, 1 - stddev_pop(k) / avg(k)) END AS balance FROM c GROUP BY split),
    q AS (SELECT split, count(*) AS n, count(*) FILTER (trim(text) <> '') / count(*) AS completeness, count(DISTINCT q) / count(*) AS unique_ratio FROM s GROUP BY split)
    SELECT split, n, round(completeness, 6) AS completeness, round(diversity, 6) AS diversity, round(balance, 6) AS balance, round(unique_ratio, 6) AS unique_ratio,
        round(0.3::DOUBLE * completeness + 0.25::DOUBLE * diversity + 0.25::DOUBLE * balance + 0.2::DOUBLE * unique_ratio, 6) AS overall FROM q JOIN d USING (split) JOIN b USING (split)""")(
    lambda d: evaluation.dataset_quality(windows.stratified_split(d, "lang", "doc_id").select("doc_id", "split").join(d.select("doc_id", "source", "text"), "doc_id"), split="split", category="source", question=F.left("text", F.lit(40)), text=F.col("text"))
)
_query("reflect", "conversations", """
    WITH b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    g AS (SELECT conv_id, turn, text, coalesce(contains(text, left(before, 20)), false) AS grounded FROM b WHERE role = 'assistant'),
    l AS (SELECT *, NOT (grounded AND length(text) > 50 AND length(text) < 5000) AS again FROM g)
    SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT grounded THEN 'ungrounded' END, CASE WHEN length(text) < 100 THEN 'brief' END, CASE WHEN again THEN 'low_confidence' END) AS remarks, again FROM l""")(agents.reviewed)
_query("chat_prompt", "conversations", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
    SELECT conv_id, md5(string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn)) AS prompt_md5 FROM r WHERE r BETWEEN 2 AND 11 GROUP BY conv_id""")(
    lambda c: agents.prompt(c).select("conv_id", F.md5("prompt").alias("prompt_md5"))
)
_query("memory_recent", "conversations", "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 10")(
    lambda c: c.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.col("last_turn").desc(), "conv_id").limit(10)
)
_query("llm_json", "events", "SELECT event_id, json_valid(props) AS parsed, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k, CASE WHEN NOT json_valid(props) THEN left(props, 200) END AS fallback FROM events")(
    lambda e: e.select("event_id", *agents.parsed_reply(F.col("props"), ["k"]))
)
_query("topics", "documents", r"""
    WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: trim(x, '.,!?;:()"''')), lambda x: length(x) > 2 AND regexp_matches(x, '^\p{Lu}')) AS w, regexp_extract_all(text, '"([^"]+)"', 1) AS q FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(w, q)))[1:20], '|') AS topics FROM w""")(lambda d: d.select("doc_id", F.array_join(agents.topics(F.col("text")), "|").alias("topics")))
_query("embed_dedupe", "documents", "SELECT left(sha256('m:' || text), 16) AS cache_key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")(
    lambda d: d.groupBy(F.left(F.sha2(F.concat(F.lit("m:"), "text").cast("binary"), 256), F.lit(16)).alias("cache_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
)
_query("vector_topk_filtered", "embeddings", _top.replace("WHERE q.vec_id", "WHERE v.label = 1 AND q.vec_id"))(lambda e: search.top_k(e.where("label = 1"), _asked(e)))
_query("xref_semantic_links", "embeddings", f"SELECT query_id, vec_id, score FROM ({_top}) WHERE score >= 0.25")(lambda e: search.top_k(e, _asked(e)).where("score >= 0.25").select("query_id", "vec_id", "score"))
_query("retrieve_min_score", "embeddings", f"SELECT query_id, count(*) AS n, round(avg(score), 5) AS mean_score FROM ({_top}) WHERE score >= 0.3 GROUP BY query_id")(
    lambda e: search.top_k(e, _asked(e)).where("score >= 0.3").groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))
)
_query2("vector_delete", "embeddings", "labels", "SELECT vec_id, label FROM embeddings ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) ON vec_id = doc_id")(
    lambda e, t: e.join(t.where("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id", "label")
)
_query("processing_stats", "events", "SELECT count(*) AS n, round(100 * avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS success_rate FROM events")(
    lambda e: e.agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("event_type") != "error").cast("int")), 6).alias("success_rate"))
)
_query("cache_stats", "events", "SELECT count(*) AS n, count(*) - count(DISTINCT (user_id, event_type)) AS hits, round(100 * (count(*) - count(DISTINCT (user_id, event_type))) / count(*), 6) AS hit_rate FROM events")(
    lambda e: e.groupBy("user_id", "event_type").count().agg(F.sum("count").alias("n"), (F.sum("count") - F.count("*")).alias("hits"), F.round(100 * (F.sum("count") - F.count("*")) / F.sum("count"), 6).alias("hit_rate"))
)
_query("dashboard_metrics", "labels", "SELECT count(*) AS n, round(100 * coalesce(avg(quality), 0.985::DOUBLE), 6) AS confidence FROM labels")(
    lambda t: t.agg(F.count("*").alias("n"), F.round(100 * F.coalesce(F.avg("quality"), F.lit(0.985)), 6).alias("confidence"))
)
_query2("onto_rdf", "nation", "region", "SELECT '<' || replace(n_name, ' ', '_') || '> <IS_A> <' || replace(r_name, ' ', '_') || '> .' AS line FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda n, r: n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("<"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("> <IS_A> <"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("> .")).alias("line"))
)
QUERIES["onto_neighbors"] = lambda spark, sf_dir: graph.neighbours(_nodes(spark, sf_dir), "AFRICA")
_tree = ORACLE_SQL["onto_hierarchy"]
ORACLE_SQL["onto_neighbors"] = "SELECT 'in' AS direction, n_name AS node FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'"
QUERIES["onto_stats"] = lambda spark, sf_dir: graph.tree_depths(_nodes(spark, sf_dir)).agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.round(2 * F.count_if(F.col("depth") > 1) / F.count("*"), 6).alias("mean_degree"))
ORACLE_SQL["onto_stats"] = f"SELECT count(*) AS n_nodes, max(depth) AS max_depth, round(2 * count(*) FILTER (depth > 1) / count(*), 6) AS mean_degree FROM ({_tree})"
