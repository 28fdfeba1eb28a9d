"""The queries of the training-data operators, over the whole tables of a data folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, common, debruijn, filter_audit, html_text, multiset, packing, pii, quality, secrets, simhash, token_counts as counting, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of the texts, by the vocabulary of op1. The table is written, as packing reads it twice."""
    return common.materialise(bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), "tokens")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprints(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(_documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(token_counts(_documents(spark, sf_dir)), F.col("n_tokens"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_html_extraction, op3_quality_classifier, op4_secret_scan, op5_quality_rules, op6_pii, op7_fingerprints,
        op8_substring_dedup, op9_simhash, op10_packing, op11_filter_audit, op12_token_counts, op13_vector_codes,
    )
}


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain Lloyd, round by round, over one row for each part of a vector."""
    ctes = [
        "kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "wide AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept)",
        f"x AS (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM wide, (SELECT unnest(range({parts})) AS p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM x QUALIFY e < {entries})",
    ]
    gap = "list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(rounds + 1):
        ctes.append(f"near{n} AS (SELECT vec_id, label, p, v, min(struct_pack(d := d, e := e)) AS m FROM (SELECT x.*, b.e, CAST({gap} AS BIGINT) AS d FROM x JOIN book{n} b USING (p)) GROUP BY vec_id, label, p, v)")
        if n < rounds:
            ctes.append(f"sums{n} AS (SELECT p, m.e AS e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS c FROM near{n}, (SELECT unnest(range(1, (SELECT max(len(c)) FROM book0) + 1)) AS i) GROUP BY p, m.e, i)")
            ctes.append(f"new{n} AS (SELECT p, e, list(c ORDER BY i) AS c FROM sums{n} GROUP BY p, e)")
            ctes.append(f"book{n + 1} AS (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{n} b LEFT JOIN new{n} n USING (p, e))")
    return f"""
        WITH {", ".join(ctes)},
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label),
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, digest
    """


ORACLE_SQL: dict[str, str] = {
    "op8_substring_dedup": r"""
        WITH split AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT r, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35
        ), windows AS (
            SELECT r, i, array_to_string(w[i : i + 34], ' ') AS t FROM starts JOIN split USING (r)
        ), often AS (
            SELECT t FROM windows GROUP BY t HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN often USING (t)
        ), words AS (
            SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split
        ), kept AS (
            SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (r)
    """,
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), firsts AS (
            SELECT t, min(doc_id) AS least FROM d GROUP BY t
        ), told AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), failed AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
                len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
                regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
            FROM d JOIN firsts USING (t) LEFT JOIN told USING (doc_id)
        ), cells AS (
            SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, f
        ), letters AS (
            SELECT unnest(range(1, 6)) AS l
        ), orders AS (
            SELECT [a.l, b.l, c.l, x.l, y.l] AS o FROM letters a, letters b, letters c, letters x, letters y WHERE len(list_distinct([a.l, b.l, c.l, x.l, y.l])) = 5
        ), steps AS (
            SELECT part, o, l AS step, sum(n) FILTER (NOT list_contains(list_transform(o[1:l], lambda k: f[k]), true)) AS kept,
                sum(n) FILTER (f[o[l]] AND NOT list_contains(list_transform(o[1:l - 1], lambda k: f[k]), true)) AS removed,
                sum(n) FILTER (f[o[l]] AND list_contains(list_transform(o[1:l - 1], lambda k: f[k]), true)) AS redundant,
                sum(n) FILTER (f[o[l]] AND len(list_filter(f, lambda k: k)) = 1) AS unique_fails,
                sum(good) FILTER (f[o[l]] AND NOT list_contains(list_transform(o[1:l - 1], lambda k: f[k]), true)) AS good_lost,
                sum(toxic) FILTER (f[o[l]] AND NOT list_contains(list_transform(o[1:l - 1], lambda k: f[k]), true)) AS toxic_lost
            FROM cells, orders, letters GROUP BY part, o, l
        )
        SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
            CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
            CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
        FROM steps
    """,
    "op13_vector_codes": _codes_sql(),
}
