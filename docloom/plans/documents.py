"""Queries of chunking, evaluation, routing, graphs, redaction and streams, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import agents, chunking, evaluation, graph, redaction, search
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query, _query2
from docloom.streaming import events

_read = lambda spark, sf_dir, table: spark.read.parquet(f"{sf_dir}/{table}.parquet")

# Queries that SQL cannot express: tests hold them against worked cases.
QUERIES["chunk_recursive"] = lambda spark, sf_dir: chunking.chunks(_read(spark, sf_dir, "documents"))
QUERIES["chunk_sentence"] = lambda spark, sf_dir: chunking.chunks(_read(spark, sf_dir, "documents"), by_sentence=True)
QUERIES["chunk_by_words"] = lambda spark, sf_dir: chunking.chunks_by(_read(spark, sf_dir, "documents"), chunking.word_count, size=200, overlap=0)
QUERIES["summarize"] = lambda spark, sf_dir: chunking.summaries(_read(spark, sf_dir, "documents"))
QUERIES["pii_detect"] = lambda spark, sf_dir: redaction.detect(_read(spark, sf_dir, "documents"))
QUERIES["pii_redact"] = lambda spark, sf_dir: redaction.redact(_read(spark, sf_dir, "documents"))
QUERIES["pii_report"] = lambda spark, sf_dir: redaction.report(redaction.detect(_read(spark, sf_dir, "documents")))

_tokens = r"list_filter(regexp_split_to_array(lower({}), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
_pairs = "(SELECT item_id, b.text AS b, d.text AS d FROM benchmark b JOIN documents d ON item_id = doc_id)"


def _paired(b: DataFrame, d: DataFrame) -> DataFrame:
    return b.select("item_id", F.col("text").alias("b")).join(d.select(F.col("doc_id").alias("item_id"), F.col("text").alias("d")), "item_id")


_query2("eval_bleu", "benchmark", "documents", f"""
    WITH t AS (SELECT item_id, unnest({_tokens.format('b')}) AS w, 1 AS r, 0 AS h FROM {_pairs} UNION ALL SELECT item_id, unnest({_tokens.format('d')}), 0, 1 FROM {_pairs}),
    c AS (SELECT item_id, w, sum(r) AS r, sum(h) AS h FROM t GROUP BY ALL), s AS (SELECT item_id, sum(r) AS r, sum(h) AS h, sum(least(r, h)) AS shared FROM c GROUP BY item_id)
    SELECT item_id, round(CASE WHEN h = 0 THEN 0 WHEN h >= r THEN shared / h ELSE exp(1 - r / h) * shared / h END, 6) AS bleu FROM s""")(lambda b, d: evaluation.bleu(_paired(b, d), "item_id", "b", "d"))
_stop = ", ".join(f"'{w}'" for w in evaluation.QUESTION_WORDS)
_query2("eval_generation", "benchmark", "documents", f"""
    WITH t AS (SELECT item_id, list_distinct({_tokens.format('d')}) AS a, list_distinct({_tokens.format('b')}) AS c FROM {_pairs}), q AS (SELECT *, list_filter(c, lambda x: x NOT IN ({_stop})) AS q FROM t)
    SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, c)) / len(a) END, 6) AS faithfulness, round(CASE WHEN len(q) = 0 THEN 0.5 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS relevancy FROM q""")(
    lambda b, d: _paired(b, d).select("item_id", F.round(evaluation.faithfulness(F.col("d"), F.col("b")), 6).alias("faithfulness"), F.round(evaluation.relevancy(F.col("b"), F.col("d")), 6).alias("relevancy"))
)
_ks = (1, 3, 5, 10)
_query("eval_retrieval", "embeddings", f"""
    WITH h AS ({ORACLE_SQL['vector_topk'].replace('rank <= 5', 'rank <= 10')}), j AS (SELECT query_id, rank, score, q.label AS label, q.label = v.label AS hit FROM h JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = h.vec_id),
    n AS (SELECT label, count(*) - 1 AS others FROM embeddings GROUP BY label HAVING count(*) > 1)
    SELECT query_id, {', '.join(f'round(count(*) FILTER (hit AND rank <= {k}) / {k}, 6) AS p{k}, round(count(*) FILTER (hit AND rank <= {k}) / any_value(others), 6) AS r{k}' for k in _ks)},
        round(coalesce(1 / min(rank) FILTER (hit), 0), 6) AS reciprocal_rank, round(sum(score / log2(rank + 1)) / any_value((SELECT sum(1 / log2(i + 1)) FROM range(1, others + 1) t(i))), 6) AS ndcg, round(avg(hit::INT), 6) AS context_precision
    FROM j JOIN n USING (label) GROUP BY query_id""")(lambda e: evaluation.retrieval_by_label(search.top_k(e, e.where("vec_id % 100 = 0"), 10), e))
_query("eval_context_precision", "embeddings", f"SELECT count(*) AS n, round(avg(context_precision), 6) AS context_precision FROM ({ORACLE_SQL['eval_retrieval']})")(
    lambda e: evaluation.retrieval_by_label(search.top_k(e, e.where("vec_id % 100 = 0"), 10), e).agg(F.count("*").alias("n"), F.round(F.avg("context_precision"), 6).alias("context_precision"))
)
_cases = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in phrases) + f" THEN '{kind}'" for kind, phrases in agents.ROUTES.items())
_query("route_query", "conversations", f"SELECT conv_id, turn, kind, CASE kind WHEN 'analytical' THEN 5 WHEN 'summarization' THEN 2 ELSE 3 END AS n_steps FROM (SELECT *, CASE {_cases} ELSE 'general' END AS kind FROM conversations)")(
    lambda c: c.select("conv_id", "turn", agents.route(F.col("text")).alias("kind")).withColumn("n_steps", F.size(agents.steps(F.col("kind"))))
)
_query("validate_response", "conversations", """
    WITH b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    s AS (SELECT conv_id, turn, ((length(text) > 10)::INT + (length(text) > 50)::INT + (length(text) < 5000)::INT + coalesce(contains(text, left(before, 20)), false)::INT) / 4 AS score FROM b WHERE role = 'assistant')
    SELECT conv_id, turn, score, CASE WHEN score = 1 THEN 0.95::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM s""")(agents.checked_responses)
_query("query_expand", "benchmark", """
    WITH q AS (SELECT item_id, 'Find a summary: ' || left(text, 20) AS q FROM benchmark)
    SELECT item_id, q AS query FROM q UNION ALL SELECT item_id, replace(lower(q), 'find', unnest(['search', 'locate', 'get'])) FROM q""")(
    lambda b: b.select("item_id", F.explode(agents.expanded(F.concat(F.lit("Find a summary: "), F.left("text", F.lit(20))))).alias("query"))
)
_query("train_format", "documents", r"""SELECT doc_id, md5('### Instruction:' || chr(10) || source || chr(10) || chr(10) || '### Response:' || chr(10) || text) AS instruction_md5, md5(source || chr(10) || chr(10) || text) AS completion_md5,
    md5('system:Be brief.|user:' || source || '|assistant:' || text) AS chat_md5 FROM documents""")(
    lambda d: d.select(
        "doc_id", F.md5(agents.instruction(F.col("source"), F.col("text"))).alias("instruction_md5"), F.md5(agents.completion(F.col("source"), F.col("text"))).alias("completion_md5"),
        F.md5(F.array_join(F.transform(agents.chat(F.col("source"), F.col("text"), "Be brief."), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("chat_md5"),
    )
)
_query("kmeans_step", "embeddings", """
    WITH p AS (SELECT v.vec_id, v.embedding AS e, c.vec_id AS cluster, list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) ** 2)) AS d FROM embeddings v JOIN embeddings c ON c.vec_id < 4),
    a AS (SELECT vec_id, e, arg_min(cluster, (d, cluster)) AS cluster FROM p GROUP BY vec_id, e)
    SELECT cluster, count(*) AS n, round(avg(e[1]::DOUBLE), 6) AS c0, round(avg(e[64]::DOUBLE), 6) AS c63 FROM a GROUP BY cluster""")(
    lambda e: graph.kmeans_step(e, [r.embedding for r in e.where("vec_id < 4").orderBy("vec_id").collect()]).select("cluster", "n", F.round(F.col("centroid")[0], 6).alias("c0"), F.round(F.col("centroid")[63], 6).alias("c63"))
)
_query("stream_metric_rate", "events", "SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")(events.rates)
_query("stream_sessions", "events", """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s.s""")(events.sessions)
_query("stream_dedupe", "events", "SELECT DISTINCT user_id, event_type FROM events")(lambda e: events.deduplicated(e, ["user_id", "event_type"]).select("user_id", "event_type"))

_tree = """SELECT r_name AS node, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _nodes(spark, sf_dir: str) -> DataFrame:
    region, nation, customer = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    inner = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))
    leaves = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_name").alias("node"), F.col("n_name").alias("parent"))
    return region.select(F.col("r_name").alias("node"), F.lit(None).cast("string").alias("parent")).unionByName(inner).unionByName(leaves)


QUERIES["onto_hierarchy"] = lambda spark, sf_dir: graph.tree_depths(_nodes(spark, sf_dir))
ORACLE_SQL["onto_hierarchy"] = f"WITH RECURSIVE t AS ({_tree}), h AS (SELECT node, node AS root, 1 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, root, depth + 1 FROM t JOIN h ON t.parent = h.node) SELECT * FROM h"
_up = lambda spark, sf_dir: _nodes(spark, sf_dir).where("parent is not null").select(F.col("node").alias("source"), F.col("parent").alias("target"))
QUERIES["onto_related"] = lambda spark, sf_dir: graph.reachable(_up(spark, sf_dir), "AFRICA").select("node", "hops", F.array_join("path", " > ").alias("path"))
ORACLE_SQL["onto_related"] = f"""WITH RECURSIVE t AS ({_tree}), e AS (SELECT node AS a, parent AS b FROM t WHERE parent IS NOT NULL UNION SELECT parent, node FROM t WHERE parent IS NOT NULL),
    w AS (SELECT 'AFRICA' AS node, 0 AS hops, ['AFRICA'] AS path UNION ALL SELECT b, hops + 1, list_append(path, b) FROM w JOIN e ON a = w.node WHERE hops < 2 AND NOT list_contains(path, b))
    SELECT node, min(hops) AS hops, array_to_string(arg_min(path, (hops, path)), ' > ') AS path FROM w GROUP BY node"""
# From one customer to another by way of nations and regions, where there is a way of at most six steps.
QUERIES["onto_path"] = lambda spark, sf_dir: graph.shortest(_up(spark, sf_dir), "Customer#000000000", "Customer#000000007", most=6).select("hops", F.array_join("path", " > ").alias("path"))
ORACLE_SQL["onto_path"] = f"""WITH RECURSIVE t AS ({_tree}), e AS (SELECT node AS a, parent AS b FROM t WHERE parent IS NOT NULL UNION SELECT parent, node FROM t WHERE parent IS NOT NULL),
    w AS (SELECT 'Customer#000000000' AS node, 0 AS hops, ['Customer#000000000'] AS path UNION ALL SELECT b, hops + 1, list_append(path, b) FROM w JOIN e ON a = w.node WHERE hops < 6 AND NOT list_contains(path, b) AND (b NOT LIKE 'Customer%' OR b = 'Customer#000000007'))
    SELECT hops, array_to_string(path, ' > ') AS path FROM w WHERE node = 'Customer#000000007' ORDER BY hops, path LIMIT 1"""
