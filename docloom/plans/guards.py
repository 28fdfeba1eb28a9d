"""Queries of guardrails, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import guardrails, text, windows
from docloom.plans.registry import _query

_P = guardrails.PATTERNS


def _masked(value: str) -> str:
    for pattern, mask in guardrails.MASKS.values():
        value = f"regexp_replace({value}, '{pattern}', '{mask.replace('$', chr(92))}', 'g')"
    return value


_stars = f"(SELECT array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || repeat('*', coalesce(length(h[i]), 0))), '') FROM (SELECT regexp_split_to_array(m, '{_P['ip_address']}') AS g, regexp_extract_all(m, '{_P['ip_address']}') AS h))"
_any = " OR ".join(f"regexp_matches(text, '{p}')" for p in _P.values())
_base = f"""
    WITH w AS (SELECT doc_id, text, {_masked('text')} AS m, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM w) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT w.*, {_stars} AS masked, CASE WHEN len(w) > 10 AND most > 0.5 * len(w) THEN '{guardrails.REPETITION}'
        WHEN length(text) > 20 AND length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) > 0.7::DOUBLE * length(text) THEN '{guardrails.CAPITALS}' END AS spam FROM w LEFT JOIN c USING (doc_id))
"""
_injected = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in text.INJECTION)
_category = f"CASE WHEN length(text) > 10000 THEN 'long' WHEN trim(text) = '' THEN 'blank' WHEN {_injected} THEN 'injection' WHEN spam IS NOT NULL THEN 'spam' WHEN {_any} THEN 'pii' ELSE 'safe' END"


def checked_sql(table: str) -> str:
    """doc_id, category, question: the rows of a table (doc_id, text) by what the guardrail of input makes of them."""
    base = _base.replace("FROM documents", f"FROM {table}")
    return f"{base} SELECT doc_id, category, CASE category WHEN 'pii' THEN masked WHEN 'safe' THEN text END AS question FROM (SELECT *, {_category} AS category FROM s)"


_query("guardrail_input", "documents", f"""{_base}, d AS (SELECT *, CASE WHEN length(text) > 10000 THEN 'long' WHEN trim(text) = '' THEN 'blank' WHEN {_injected} THEN 'injection' WHEN spam IS NOT NULL THEN 'spam' WHEN {_any} THEN 'pii' ELSE 'safe' END AS category FROM s)
    SELECT doc_id, category, category IN ('pii', 'safe', 'spam') AS valid, md5(CASE category WHEN 'pii' THEN masked WHEN 'safe' THEN text END) AS filtered_md5 FROM d""")(
    lambda d: guardrails.check_input(d).select("doc_id", "category", "valid", F.md5("filtered").alias("filtered_md5"))
)
_query("guardrail_spam", "documents", f"{_base} SELECT doc_id, spam AS reason FROM s")(lambda d: d.select("doc_id", guardrails.spam(F.col("text")).alias("reason")))
_query("guardrail_output", "documents", f"""{_base} SELECT doc_id, CASE WHEN length(text) <= 3000 AND ({_any}) THEN 'pii' ELSE 'safe' END AS category, md5(CASE WHEN length(text) > 3000 THEN left(text, 3000) || '... [truncated]' ELSE masked END) AS filtered_md5 FROM s""")(
    lambda d: guardrails.check_output(d, longest=3000).select("doc_id", "category", F.md5("filtered").alias("filtered_md5"))
)
_value = "CASE type " + " ".join(f"WHEN '{k}' THEN regexp_replace(value, '{p}', '{m.replace('$', chr(92))}', 'g')" for k, (p, m) in guardrails.MASKS.items()) + " ELSE repeat('*', length(value)) END"
_findings = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in _P.items())
_query("guardrail_pii", "documents", f"SELECT doc_id, type, value, {_value} AS masked FROM ({_findings})")(guardrails.findings)
# Chunks of a context: the texts of each source, by doc_id, in its order and with its size and digest.
_query("guardrail_context", "documents", f"""
    WITH w AS (SELECT source AS group_id, doc_id AS rank, {_masked('text')} AS m FROM documents), x AS (SELECT group_id, rank, md5({_stars}) AS chunk_md5 FROM w),
    p AS (SELECT group_id, floor(rank / 1000) AS part, md5(string_agg(coalesce(chunk_md5, ''), chr(10) ORDER BY rank NULLS FIRST, chunk_md5 NULLS FIRST)) AS part_md5 FROM x GROUP BY 1, 2),
    c AS (SELECT group_id, md5(string_agg(part_md5, chr(10) ORDER BY part NULLS FIRST)) AS context_md5 FROM p GROUP BY 1)
    SELECT x.group_id, rank, row_number() OVER (PARTITION BY x.group_id ORDER BY rank NULLS FIRST, chunk_md5 NULLS FIRST) AS place, count(*) OVER (PARTITION BY x.group_id) AS n, chunk_md5, context_md5
    FROM x JOIN c ON x.group_id IS NOT DISTINCT FROM c.group_id""")(
    lambda d: windows.contexts(guardrails.check_context(d.select(F.col("source").alias("group_id"), F.col("doc_id").alias("rank"), "text")).select("group_id", "rank", F.md5("text").alias("chunk_md5")))
)
