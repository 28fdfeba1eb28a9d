"""Queries of the catalogue: relationships and lineage of sources, the status of documents, the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import lineage
from docloom.plans.registry import ORACLE_SQL, QUERIES
from docloom.sources import folders, vector_store
from docloom.streaming import status

#: What belongs to what in the given tables: a name for the kind of source, and the table and columns of each edge.
BELONGS = [
    ("lineitem", "l_orderkey", "order", "l_linenumber"),
    ("orders", "o_custkey", "customer", "o_orderkey"),
    ("customer", "c_nationkey", "nation", "c_custkey"),
    ("nation", "n_regionkey", "region", "n_nationkey"),
]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, type: line items belong to orders, these to customers, nations and regions."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    name = lambda kind, *columns: F.concat_ws(":", F.lit(kind), *(F.col(c).cast("string") for c in columns))
    lines = read("lineitem").select(name("line", "l_orderkey", "l_linenumber").alias("source"), name("order", "l_orderkey").alias("target"), F.lit("line_of").alias("type"))
    orders = read("orders").select(name("order", "o_orderkey"), name("customer", "o_custkey"), F.lit("order_of"))
    customers = read("customer").select(name("customer", "c_custkey"), name("nation", "c_nationkey"), F.lit("lives_in"))
    nations = read("nation").select(name("nation", "n_nationkey"), name("region", "n_regionkey"), F.lit("part_of"))
    return lines.union(orders).union(customers).union(nations)


_edges_sql = """
    SELECT 'line:' || l_orderkey || ':' || l_linenumber AS source, 'order:' || l_orderkey AS target, 'line_of' AS type FROM lineitem
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'order_of' FROM orders
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in' FROM customer
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of' FROM nation"""
_closed = f"""
    WITH RECURSIVE edges AS ({_edges_sql}),
    walk AS (SELECT DISTINCT source, target, 1 AS hops FROM edges UNION ALL SELECT w.source, e.target, w.hops + 1 FROM walk w JOIN (SELECT DISTINCT source, target FROM edges) e ON w.target = e.source WHERE w.hops < 20),
    paths AS (SELECT source, target, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY source, target)"""

QUERIES["catalog_lineage"] = lambda spark, sf_dir: lineage.closure(_edges(spark, sf_dir)).ancestors()
ORACLE_SQL["catalog_lineage"] = f"{_closed} SELECT source, target, hops FROM paths WHERE source <> target"
QUERIES["catalog_descendants"] = lambda spark, sf_dir: lineage.summary(lineage.closure(_edges(spark, sf_dir)))
ORACLE_SQL["catalog_descendants"] = f"{_closed} SELECT target, count(*) AS n_sources, max(hops) AS deepest FROM paths WHERE source <> target GROUP BY target"
QUERIES["catalog_relationships"] = lambda spark, sf_dir: lineage.relationships(_edges(spark, sf_dir))
ORACLE_SQL["catalog_relationships"] = f"SELECT type, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM ({_edges_sql}) GROUP BY type"

#: Which step of a document's processing an event stands for; a document is a user. Money says how far a view has come.
_STEP = (
    "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' "
    "WHEN 'click' THEN IF(value < 10, 'extracting', 'analyzing') WHEN 'view' THEN IF(value < 10, 'indexing', 'finalizing') END"
)
TIMEOUT = "12 hours"


def _documents(events: DataFrame) -> DataFrame:
    return events.withColumn("document_id", F.col("user_id"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return status.transitions(_documents(events), _STEP, timeout=TIMEOUT, until=events.agg(F.max("ts")).first()[0])


def _status_sql() -> str:
    """The events of each document one after the other, by a recursive query."""
    names = ", ".join("NULL" if n is None else f"'{n}'" for n in status.NAMES)
    table = ", ".join(str(row) for row in status.NEXT)
    texts = [status.STEPS[n] if n else (None, None, None) for n in status.NAMES]
    listed = lambda i: ", ".join("NULL" if t[i] is None else repr(t[i]) for t in texts)
    is_open = f"state BETWEEN 1 AND {status.COMPLETED - 1}"
    gap = f"INTERVAL {TIMEOUT.upper()}"
    return f"""
    WITH RECURSIVE coded AS (
        SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN {status.FAILED} WHEN 'purchase' THEN {status.COMPLETED}
            WHEN 'click' THEN CASE WHEN value < 10 THEN 2 ELSE 3 END WHEN 'view' THEN CASE WHEN value < 10 THEN 4 ELSE 5 END END AS code FROM events
    ), placed AS (
        SELECT *, row_number() OVER w AS r, lag(ts) OVER w AS last FROM coded WHERE code IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), run AS (
        SELECT user_id, ts, event_id, r, 0 AS before, 0 AS state0, [{table}][1][code + 1] AS state FROM placed WHERE r = 1
        UNION ALL SELECT p.user_id, p.ts, p.event_id, p.r, state, s.b, [{table}][s.b + 1][code + 1]
        FROM run JOIN placed p ON p.user_id = run.user_id AND p.r = run.r + 1, LATERAL (SELECT CASE WHEN {is_open} AND p.ts - p.last >= {gap} THEN {status.FAILED} ELSE state END AS b) s
    ), found AS (
        SELECT user_id, ts, event_id, state0 AS before, state, 'event' AS reason FROM run WHERE state <> state0
        UNION ALL SELECT p.user_id, p.last + {gap}, NULL, run.before, {status.FAILED}, 'timeout' FROM run JOIN placed p USING (user_id, r) WHERE state0 <> run.before
        UNION ALL SELECT user_id, ts + {gap}, NULL, state, {status.FAILED}, 'timeout' FROM (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1)
        WHERE {is_open} AND ts + {gap} <= (SELECT max(ts) FROM events)
    )
    SELECT user_id AS document_id, ts, event_id, [{names}][before + 1] AS step_before, [{names}][state + 1] AS step, [{listed(0)}][state + 1] AS status, CAST([{listed(1)}][state + 1] AS INT) AS progress,
        CASE WHEN reason = 'timeout' THEN 'Timed out' WHEN state = {status.FAILED} THEN 'Failed' ELSE [{listed(2)}][state + 1] END AS message, reason FROM found"""


QUERIES["status_transitions"] = _status
ORACLE_SQL["status_transitions"] = _status_sql()
QUERIES["status_current"] = lambda spark, sf_dir: status.current(_status(spark, sf_dir))
ORACLE_SQL["status_current"] = f"""
    SELECT document_id, status, progress, message, n_transitions, updated FROM (
        SELECT *, count(*) OVER (PARTITION BY document_id) AS n_transitions, max(ts) OVER (PARTITION BY document_id) AS updated FROM ({_status_sql()})
        QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id IS NOT NULL DESC, event_id DESC) = 1)"""


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in one batch; a batch that is newer for some and comes late for others, twice; the first batch as an older
    one; then what one document had in the first version is deleted."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    document = F.concat(F.lit("doc_"), F.coalesce(F.col("label").cast("string"), F.lit("none")))
    rows = vectors.select(F.concat(F.lit("chunk_"), "vec_id").alias("chunk_id"), F.lit(1).alias("version"), document.alias("document_id"), "embedding")
    turned = rows.withColumn("embedding", F.reverse("embedding")).withColumn("version", F.length("chunk_id") % 2 * 2)
    store = vector_store.VectorStore(spark, folders.new_folder(spark, "vectors"))
    for batch in (rows, turned, turned, rows.withColumn("version", F.lit(0))):
        store.upsert(batch)
    store.delete_document("doc_3", 1)
    first = lambda i: F.round(F.col("embedding")[i].cast("double"), 6)
    return store.read().select("chunk_id", "version", "document_id", first(0).alias("first"), first(63).alias("last"))


QUERIES["vector_upsert"] = _upserted
ORACLE_SQL["vector_upsert"] = """
    WITH v AS (SELECT 'chunk_' || vec_id AS chunk_id, 'doc_' || coalesce(CAST(label AS VARCHAR), 'none') AS document_id, embedding AS e FROM embeddings),
    d AS (SELECT *, length(chunk_id) % 2 = 1 AS turned FROM v)
    SELECT chunk_id, CAST(CASE WHEN turned THEN 2 ELSE 1 END AS BIGINT) AS version, document_id, round(CAST(CASE WHEN turned THEN e[64] ELSE e[1] END AS DOUBLE), 6) AS first,
        round(CAST(CASE WHEN turned THEN e[1] ELSE e[64] END AS DOUBLE), 6) AS last FROM d WHERE turned OR document_id <> 'doc_3'"""


def _by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by status, their mean progress, and how long the last change lies before the last event, in hours at most."""
    now = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").alias("now"))  # one row
    age = (F.unix_timestamp("now") - F.unix_timestamp("updated")) / 3600
    return status.current(_status(spark, sf_dir)).crossJoin(now).groupBy("status").agg(
        F.count("*").alias("n"), F.round(F.avg("progress"), 6).alias("mean_progress"), F.sum("n_transitions").alias("n_transitions"), F.round(F.max(age), 4).alias("oldest_hours")
    )


QUERIES["dashboard_status"] = _by_status
ORACLE_SQL["dashboard_status"] = f"""
    SELECT status, count(*) AS n, round(avg(progress), 6) AS mean_progress, CAST(sum(n_transitions) AS BIGINT) AS n_transitions,
        round(max((epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', updated))) / 3600), 4) AS oldest_hours
    FROM ({ORACLE_SQL['status_current']}) GROUP BY status"""


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each agent (the kind of an event): how sure it was (value out of 100) and how many documents it ended."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ended = _status(spark, sf_dir).where("reason = 'event' and status in ('completed', 'failed')").select("event_id", "status")
    joined = events.join(ended, "event_id", "left")
    return joined.groupBy(F.col("event_type").alias("agent")).agg(
        F.count("*").alias("executions"), F.round(F.avg(F.col("value") / 100), 6).alias("confidence"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")
    )


QUERIES["agent_confidence"] = _agents
ORACLE_SQL["agent_confidence"] = f"""
    WITH s AS (SELECT event_id, status FROM ({_status_sql()}) WHERE reason = 'event' AND status IN ('completed', 'failed'))
    SELECT event_type AS agent, count(*) AS executions, round(avg(value / 100), 6) AS confidence, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed
    FROM events LEFT JOIN s USING (event_id) GROUP BY event_type"""
