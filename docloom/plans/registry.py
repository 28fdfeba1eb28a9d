"""Queries by name over the tables of a data folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import agents, search, stats, text, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, table: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a function of one table under a name, with its SQL."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        ORACLE_SQL[name] = sql
        return f

    return add


def _query2(name: str, first: str, second: str, sql: str) -> Callable:
    def add(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{first}.parquet"), spark.read.parquet(f"{sf_dir}/{second}.parquet"))
        ORACLE_SQL[name] = sql
        return f

    return add



_query("chunk_stats", "documents", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total_chars, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY lang")(
    lambda d: d.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total_chars"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"))
)
_query("docs_page", "documents", "SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")(
    lambda d: d.where("lang = 'en'").orderBy(F.col("n_chars").desc(), "doc_id").offset(20).limit(20).select("doc_id", "source", "n_chars").crossJoin(d.where("lang = 'en'").agg(F.count("*").alias("total")))  # a page by one row
)
_sizes = "count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total_chars, round(avg(quality), 6) AS mean_quality FROM documents LEFT JOIN labels USING (doc_id)"
_query2("catalog_stats", "documents", "labels", f"SELECT 'lang' AS field, lang AS value, {_sizes} GROUP BY lang UNION ALL SELECT 'source', source, {_sizes} GROUP BY source UNION ALL SELECT 'all', 'all', {_sizes}")(
    lambda d, t: stats.sizes_by(d.select("doc_id", "lang", "source", "n_chars").join(t.select("doc_id", "quality"), "doc_id", "left"), "n_chars", "quality", "lang", "source")
)
_query("catalog_search", "documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND n_chars BETWEEN 100 AND 5000")(
    lambda d: d.where(F.lower("text").contains("license") & F.col("n_chars").between(100, 5000)).select("doc_id")
)
_query("memory_context", "conversations", "SELECT conv_id, turn, role, CAST(chars AS BIGINT) AS chars FROM (SELECT *, row_number() OVER w AS r, sum(length(text)) OVER w AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE r <= 4 AND chars <= 1200")(
    lambda c: windows.recent_messages(c, last=4, tokens=300)
)
_query("memory_summary", "conversations", "SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id")(windows.session_summary)
_query("combine_context", "conversations", """
    WITH s AS (SELECT conv_id AS group_id, turn AS rank, length(text) AS n, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
    u AS (SELECT *, upto - n - 2 AS before, CASE WHEN upto <= 500 THEN n WHEN upto - n - 2 <= 500 AND 500 - (upto - n - 2) > 100 THEN 500 - (upto - n - 2) ELSE 0 END AS used FROM s),
    f AS (SELECT *, sum(CASE WHEN upto > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY rank) AS spilt FROM u)
    SELECT group_id, rank, CAST(used AS BIGINT) AS used FROM f WHERE used > 0 AND spilt <= 1""")(lambda c: windows.combine_context(c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("rank"), "text"), most=500))
_query("split_stratified", "documents", """
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")(lambda d: windows.stratified_split(d, "lang", "doc_id"))
_query("dataset_distribution", "documents", """
    WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split, lang, count(*) AS n FROM r GROUP BY 1, 2""")(
    lambda d: windows.stratified_split(d, "lang", "doc_id").groupBy("split", "lang").agg(F.count("*").alias("n"))
)
_query("cache_ttl", "events", """
    WITH g AS (SELECT user_id, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events)
    SELECT user_id, round(avg(gap), 6) AS mean_gap, CASE WHEN avg(gap) < 60 THEN 'hot' WHEN avg(gap) < 300 THEN 'warm' WHEN avg(gap) < 3600 THEN 'cool' ELSE 'cold' END AS pattern FROM g WHERE gap IS NOT NULL AND age <= 10 GROUP BY user_id""")(windows.access_intervals)
_query("train_dedupe", "documents", "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")(
    lambda d: windows.first_of_each(d.select("doc_id", "text", "n_chars"), F.col("text"), "doc_id").select("doc_id", "n_chars")
)
_query("train_valid", "documents", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 10 AND 4096 AND trim(text) <> ''")(lambda d: d.where(F.length("text").between(10, 4096) & (F.trim("text") != "")).select("doc_id"))
_query("hashes", "documents", "SELECT doc_id, left(md5(text), 12) AS short_id, left(sha256('m:' || text), 16) AS cache_key, md5(lower(trim(text))) AS leak_key FROM documents")(
    lambda d: d.select("doc_id", F.left(F.md5("text"), F.lit(12)).alias("short_id"), F.left(F.sha2(F.concat(F.lit("m:"), "text").cast("binary"), 256), F.lit(16)).alias("cache_key"), F.md5(F.lower(F.trim("text"))).alias("leak_key"))
)
_query("truncate", "documents", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary FROM documents")(lambda d: d.select("doc_id", text.truncated(F.col("text"), 200).alias("summary")))
_query("text_normalize", "documents", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS text_md5 FROM documents")(
    lambda d: d.select("doc_id", F.md5(text.normalised(F.col("text"))).alias("text_md5"))
)
_query("sentences", "documents", r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS BIGINT) AS n_sentences,
    CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) AS BIGINT) AS n_ended, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, ' ')) > 20)) AS BIGINT) AS n_long FROM documents""")(
    lambda d: d.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.size(text.ended_sentences(F.col("text"))).cast("long").alias("n_ended"), F.size(text.ended_sentences(F.col("text"), 20)).cast("long").alias("n_long"))
)
_query("embed_mock", "documents", "SELECT doc_id, " + ", ".join(f"round((CAST('0x' || substr(sha256(text), {2 * (i % 32) + 1}, 2) AS INT) - 128) / 128.0::DOUBLE, 6) AS e{i}" for i in range(40)) + " FROM documents")(
    lambda d: d.select("doc_id", text.mock_embedding(F.col("text"), 40).alias("e")).select("doc_id", *(F.round(F.col("e")[i], 6).alias(f"e{i}") for i in range(40)))
)
_query("guardrail_injection", "conversations", "SELECT conv_id, turn, " + "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN {i}" for i, p in enumerate(text.INJECTION, 1)) + " END AS pattern FROM conversations")(
    lambda c: c.select("conv_id", "turn", text.first_injection(F.col("text")).alias("pattern"))
)
_query("pii_luhn", "documents", r"""
    WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS c FROM documents),
    s AS (SELECT doc_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(c[i] AS INT) * 2) % 10 + (CAST(c[i] AS INT) * 2) // 10 ELSE CAST(c[i] AS INT) END)) AS s FROM c)
    SELECT doc_id, count(*) AS n_cards, count(*) FILTER (s % 10 = 0) AS n_valid FROM s GROUP BY doc_id""")(text.luhn_cards)
_query("vector_topk", "embeddings", """
    WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-10), 6) AS score
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")(lambda e: search.top_k(e, e.where("vec_id % 100 = 0")))
_query("confusion_matrix", "labels", """
    WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels)
    SELECT tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")(lambda t: stats.confusion(t, F.col("quality"), F.col("toxic")))
_profile = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count(*) FILTER ({c} IS NULL OR {c}::VARCHAR IN ('', 'null')) AS nulls, count(DISTINCT CASE WHEN {c}::VARCHAR NOT IN ('', 'null') THEN {c} END) AS different FROM part"
    for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
)
_query("profile_columns", "part", f"SELECT *, round(CASE WHEN total > 0 THEN (total - nulls) / total ELSE 0 END, 6) AS completeness, round(CASE WHEN total > nulls THEN different / (total - nulls) ELSE 0 END, 6) AS uniqueness FROM ({_profile})")(stats.profile_columns)
_query("profile_numeric", "orders", "SELECT 'o_totalprice' AS column_name, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS deviation FROM orders")(lambda t: stats.numeric_profile(t, ["o_totalprice"]))
_query("metric_histogram", "events", " UNION ALL ".join([*(f"SELECT event_type, '{b:g}' AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" for b in stats.LATENCY), "SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type"]))(
    lambda e: stats.histogram(e, "value", "event_type", stats.LATENCY)
)
_query("eval_latency", "events", """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0)
    SELECT event_type, max(value) FILTER (i = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(value) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99, round(1 / avg(value), 6) AS throughput FROM r GROUP BY event_type""")(
    lambda e: stats.indexed_quantiles(e, "value", "event_type")
)
_query("rate_limit", "events", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2")(lambda e: stats.over_limit(e, 2, "1 day"))
_query("daily_counts", "events", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")(lambda e: e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")))
_query("latest_status", "events", "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")(
    lambda e: e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
)
_runs = "count(*) AS executions, count(*) FILTER (value > 10) AS successes, round(100.0::DOUBLE * count(*) FILTER (value > 10) / count(*), 6) AS success_rate, round(avg(value), 6) AS mean_time FROM events"
_query("agent_stats", "events", f"SELECT event_type AS agent, {_runs} GROUP BY event_type UNION ALL SELECT 'all', {_runs}")(
    lambda e: e.groupingSets([[F.col("event_type")], []], "event_type")
    .agg(F.count("*").alias("executions"), F.count_if(F.col("value") > 10).alias("successes"), F.round(100.0 * F.count_if(F.col("value") > 10) / F.count("*"), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean_time"))
    .select(F.coalesce("event_type", F.lit("all")).alias("agent"), "executions", "successes", "success_rate", "mean_time")
)
_query("feedback_accuracy", "labels", "SELECT CASE WHEN count(*) = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*), 6) END AS accuracy FROM labels")(
    lambda t: t.agg(F.when(F.count("*") == 0, F.lit(100.0)).otherwise(F.round(100.0 * F.count_if(F.col("quality") == 1) / F.greatest(F.count("*"), F.lit(1)), 6)).alias("accuracy"))
)
_query("sse_frames", "conversations", r"""
    WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM conversations), c AS (SELECT conv_id, turn, list_transform(range(1, len(w) + 1, 5), lambda i: array_to_string(w[i:i + 4], ' ')) AS c FROM w)
    SELECT conv_id, turn, 0 AS place, 'start' AS event, '' AS data FROM c UNION ALL SELECT conv_id, turn, CAST(unnest(range(1, len(c) + 1)) AS INT), 'chunk', unnest(c) FROM c
    UNION ALL SELECT conv_id, turn, CAST(len(c) + 1 AS INT), 'end', len(c) || ' chunks, ' || length(array_to_string(c, ' ')) || ' characters' FROM c""")(agents.frames)
_query("grade", "events", "SELECT CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM (SELECT value / 100 AS s FROM events) GROUP BY 1")(
    lambda e: e.groupBy(stats.grade(F.col("value") / 100).alias("grade")).agg(F.count("*").alias("n"))
)
_query2("onto_triples", "nation", "region", "SELECT n_name AS subject, 'IS_A' AS relation, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda n, r: n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.lit("IS_A").alias("relation"), F.col("r_name").alias("object"))
)
