"""Queries of the retrieval chain and of leakage, with SQL. Vectors and documents of equal numbers are one chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chat, retrieval, search, text, vector_index
from docloom.plans import guards
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query, _query2

_cos = "round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + {eps}), 6)"


def _found_sql(k: int, where: str = "true") -> str:
    return f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id, {_cos.format(eps='1e-10')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


def _context_sql(found: str, most: int) -> str:
    """Contexts of at most five chunks, by a running sum: each chunk whole, cut or left out."""
    return f"""
        WITH f AS (SELECT query_id, rank, score, text AS content, length(text) AS n FROM ({found}) JOIN documents ON vec_id = doc_id),
        o AS (SELECT *, row_number() OVER w AS pos, coalesce(sum(n + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
        s AS (SELECT *, sum(CASE WHEN before + n > {most} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS spilt FROM o),
        p AS (SELECT *, CASE WHEN spilt = 0 THEN content WHEN spilt = 1 AND before + n > {most} AND {most} - before > 100 THEN left(content, CAST({most} - before AS INT)) || '...' END AS piece FROM s)
        SELECT query_id, count(*) AS total_chunks, round(avg(score), 6) AS avg_score, md5(coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY rank), '')) AS context_md5 FROM p GROUP BY query_id"""


def _content(found: DataFrame, d: DataFrame) -> DataFrame:
    return found.join(d.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id")


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 100 = 0")


def _hashed(c: DataFrame) -> DataFrame:
    return c.select("query_id", "total_chunks", "avg_score", F.md5("context").alias("context_md5"))


_query2("retrieve", "embeddings", "documents", _context_sql(f"SELECT * FROM ({_found_sql(5)}) WHERE score >= 0.2", 1500))(lambda e, d: _hashed(retrieval.context(_content(search.top_k(e, _asked(e)).where("score >= 0.2"), d), most=1500)))
_query2("retrieve_for_document", "embeddings", "documents", _context_sql(_found_sql(5, "q.label = v.label"), 1500))(lambda e, d: _hashed(retrieval.context(_content(search.top_k(e, _asked(e), same="label"), d), most=1500)))
_query("cosine_pairs", "embeddings", f"SELECT q.vec_id, {_cos.format(eps='1e-8')} AS score FROM embeddings q JOIN embeddings v ON v.vec_id = q.vec_id + 1")(
    lambda e: e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("other"), 1e-8), 6).alias("score"))
)
# Approximate: a test measures how much of the exact result it finds.
def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_index.search(vectors, _asked(vectors), vector_index.build(vectors, vector_index.fit(vectors)))


QUERIES["vector_ann"] = _near
_query("rerank", "events", "SELECT user_id AS query_id, event_id AS vec_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value / 100, 6) DESC, event_id) AS rank FROM events")(
    lambda e: retrieval.reranked(e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("vec_id"), F.round(F.col("value") / 100, 6).alias("score"))).select("query_id", "vec_id", "rank")
)
_query("rerank_threshold", "events", "SELECT user_id AS query_id, event_id AS vec_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM (SELECT *, round(value / 100, 6) AS score FROM events) WHERE score >= 0.5")(
    lambda e: retrieval.reranked(e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("vec_id"), F.round(F.col("value") / 100, 6).alias("score")).where("score >= 0.5"))
)
# The forms of a query are its own vector and the next two.
_forms = f"""SELECT (query_id // 100) * 100 AS query_id, query_id % 100 AS form, vec_id, score, rank FROM ({_found_sql(20).replace('q.vec_id % 100 = 0', 'q.vec_id % 100 < 3')})"""
_query("multi_query", "embeddings", f"""
    WITH o AS (SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY form, rank) AS r FROM ({_forms})) WHERE r = 1)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM o) WHERE rank <= 5""")(
    lambda e: retrieval.first_seen(search.top_k(e, e.where("vec_id % 100 < 3"), 20).selectExpr("query_id div 100 * 100 as query_id", "query_id % 100 as form", "vec_id", "score", "rank"))
)
_query2("context_string", "embeddings", "documents", f"SELECT query_id, md5(string_agg('[Source ' || rank || '] (score: ' || printf('%.3f', score) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM (SELECT query_id, score, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_found_sql(5)}) JOIN documents ON doc_id = vec_id) GROUP BY query_id")(
    lambda e, d: retrieval.source_list(_content(search.top_k(e, _asked(e)), d).drop("rank")).select("query_id", F.md5("context").alias("context_md5"))
)
_words = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \t\n\r\f\v]+'), lambda x: x <> ''))"
# Each text of the benchmark asks the two documents of its number.
_query2("compress_extractive", "benchmark", "documents", rf"""
    WITH c AS (SELECT item_id AS query_id, b.text AS query, doc_id AS rank, (doc_id % 10) / 10 AS score, d.text AS content FROM benchmark b JOIN documents d ON doc_id // 2 = item_id),
    s AS (SELECT query_id, rank, score, query, unnest(w) AS sentence, unnest(range(0, len(w))) AS place FROM (SELECT *, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS w FROM c)),
    v AS (SELECT *, round(len(list_intersect({_words.format('query')}, {_words.format('sentence')})) / greatest(len({_words.format('query')}), 1) + 0.5::DOUBLE * score, 9) AS value FROM s WHERE trim(sentence) <> ''),
    u AS (SELECT *, row_number() OVER w AS pos, sum(length(sentence) + 1) OVER w - 1 AS upto FROM v WINDOW w AS (PARTITION BY query_id ORDER BY value DESC, rank, place))
    SELECT query_id, count(*) AS n_sentences, md5(string_agg(sentence, ' ' ORDER BY pos)) AS context_md5 FROM u WHERE upto <= 600 GROUP BY query_id""")(
    lambda b, d: retrieval.compressed(
        b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(d.selectExpr("doc_id div 2 as query_id", "doc_id as rank", "(doc_id % 10) / 10 as score", "text as content"), "query_id"), most=600
    ).select("query_id", "n_sentences", F.md5("context").alias("context_md5"))
)
# Held out are the documents of one source, whose copies under other sources are in the training set; a question is a text's first line.
_side = "SELECT doc_id, source, split_part(text, chr(10), 1) AS question, text AS context FROM documents"
_leaks = f"""
    WITH d AS ({_side}), k AS (SELECT doc_id, source, 'question' AS side, md5(lower(trim(question))) AS h FROM d UNION ALL SELECT doc_id, source, 'context', md5(lower(trim(context))) FROM d),
    l AS (SELECT a.doc_id AS item_id, a.side, max(b.doc_id) AS doc_id FROM k a JOIN k b ON a.side = b.side AND a.h = b.h WHERE a.doc_id % 5 = 0 AND b.doc_id % 5 <> 0 GROUP BY 1, 2)"""


def _leaking(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    sided = d.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"), F.col("text").alias("context"))
    held_out = sided.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "item_id")
    return search.leakage(held_out, sided.where("doc_id % 5 <> 0")), held_out


_query("leakage_check", "documents", _leaks + " SELECT * FROM l")(lambda d: _leaking(d)[0])
_query("leakage_score", "documents", _leaks + ", n AS (SELECT (SELECT count(*) FROM l) AS n_hits, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS n) SELECT n_hits, round(CASE WHEN n > 0 THEN least(1.0::DOUBLE, n_hits / n) ELSE 0 END, 6) AS score, CASE WHEN n > 0 THEN n_hits / n > 0.3 ELSE false END AS severe FROM n")(
    lambda d: search.leakage_score(*_leaking(d))
)


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest question of each conversation, asked of all documents by their mock vectors."""
    messages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("conversations", "documents"))
    chunks = docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), text.mock_embedding(F.col("text")).alias("embedding"))
    found = chat.chat_context(messages, chunks, text.mock_embedding, most=1500, last=4)
    return found.select("conv_id", "turn", "category", F.md5("question").alias("question_md5"), "n_sources", F.md5("context").alias("context_md5"), "n_history", F.md5("history").alias("history_md5"), "refusal")


QUERIES["chat_context"] = _chat
_mock = lambda c: "[" + ", ".join(f"(CAST('0x' || substr(sha256({c}), {2 * i + 1}, 2) AS INT) - 128) / 128.0::DOUBLE" for i in range(16)) + "]"
_chat_found = f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.doc_id AS query_id, v.doc_id AS vec_id, round(list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v)) + 1e-10), 6) AS score
    FROM (SELECT doc_id, {_mock('question')} AS v FROM checked WHERE question IS NOT NULL) q, (SELECT doc_id, {_mock('text')} AS v FROM documents) v)) WHERE rank <= 5"""
_refusals = " ".join(f"WHEN '{c}' THEN '{told}'" for c, told in chat.REFUSALS.items())
ORACLE_SQL["chat_context"] = f"""
    WITH asked AS (SELECT conv_id AS doc_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
    checked AS ({guards.checked_sql('asked')}),
    r AS ({_context_sql(_chat_found, 1500)}),
    h AS (SELECT conv_id, count(*) AS n, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) AS history FROM (
        SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS r FROM conversations c JOIN asked a ON a.doc_id = c.conv_id WHERE c.turn < a.turn) WHERE r <= 4 GROUP BY conv_id)
    SELECT a.doc_id AS conv_id, a.turn, category, md5(question) AS question_md5, coalesce(total_chunks, 0) AS n_sources, CASE WHEN question IS NOT NULL THEN coalesce(context_md5, md5('')) END AS context_md5,
        coalesce(h.n, 0) AS n_history, md5(coalesce(history, '')) AS history_md5, CASE WHEN question IS NULL THEN CASE category {_refusals} END END AS refusal
    FROM asked a JOIN checked k ON a.doc_id = k.doc_id LEFT JOIN r ON r.query_id = a.doc_id LEFT JOIN h ON h.conv_id = a.doc_id"""
