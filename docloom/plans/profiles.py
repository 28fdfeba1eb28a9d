"""Queries of profiles of tables, files and catalogues, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import profiles
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query
from docloom.sources import files

COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}  # the first is the key


def _types_sql(table: str) -> str:
    key = COLUMNS[table][0]

    def of(column: str) -> str:
        first = f"SELECT CAST({column} AS VARCHAR) AS v FROM {table} WHERE {column} IS NOT NULL AND CAST({column} AS VARCHAR) NOT IN ('', 'null') ORDER BY {key} LIMIT 100"
        share = lambda test: f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END)"
        booleans = ", ".join(f"'{b}'" for b in profiles.BOOLEANS)
        return (
            f"SELECT '{column}' AS column_name, CASE WHEN count(*) = 0 THEN 'unknown' WHEN {share(f'''regexp_matches(v, '{profiles.NUMBER}')''')} > 0.8 THEN 'numeric' WHEN {share(f'lower(v) IN ({booleans})')} > 0.8 THEN 'boolean'"
            f" WHEN {share(f'''regexp_matches(v, '{profiles.DATE}')''')} > 0.5 THEN 'date' WHEN {share(f'''regexp_matches(v, '{profiles.EMAIL}')''')} > 0.5 THEN 'email' ELSE 'string' END AS data_type FROM ({first})"
        )

    return " UNION ALL ".join(map(of, COLUMNS[table]))


def _quality_sql(table: str) -> str:
    counts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('', 'null')) AS present FROM {table}" for c in COLUMNS[table])
    return f"""
        SELECT '{table}' AS name, n_rows, n_columns, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(validity, 6) AS validity, 0.7::DOUBLE AS accuracy, round(overall, 6) AS overall,
            CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.8 THEN 'B' WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.6 THEN 'D' ELSE 'F' END AS grade
        FROM (SELECT *, 0.3::DOUBLE * completeness + 0.25::DOUBLE * consistency + 0.25::DOUBLE * 0.7::DOUBLE + 0.2::DOUBLE * validity AS overall FROM (
            SELECT max(total) AS n_rows, count(*) AS n_columns, avg(c) AS completeness, avg(CASE WHEN data_type = 'unknown' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END) AS consistency, 0.9::DOUBLE * avg(c) + 0.1::DOUBLE AS validity
            FROM (SELECT *, CASE WHEN total > 0 THEN round(present / total, 6) ELSE 0 END AS c FROM ({counts}) JOIN ({_types_sql(table)}) USING (column_name))))"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*COLUMNS.get(name, "*"))


def _quality(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return profiles.quality(_table(spark, sf_dir, name), COLUMNS[name][0], name)


_query("profile_types", "events", _types_sql("events"))(lambda t: profiles.column_types(t.select(*COLUMNS["events"]), "event_id"))
QUERIES["profile_quality"] = lambda spark, sf_dir: _quality(spark, sf_dir, "orders")
ORACLE_SQL["profile_quality"] = _quality_sql("orders")
QUERIES["profile_compare"] = lambda spark, sf_dir: profiles.compared(_quality(spark, sf_dir, "customer"), _quality(spark, sf_dir, "supplier"))
ORACLE_SQL["profile_compare"] = f"""
    SELECT a.name AS name_a, b.name AS name_b, round(a.completeness - b.completeness, 6) AS completeness_diff, round(a.consistency - b.consistency, 6) AS consistency_diff, round(a.overall - b.overall, 6) AS overall_diff,
        a.n_rows - b.n_rows AS n_rows_diff, a.n_columns - b.n_columns AS n_columns_diff FROM ({_quality_sql('customer')}) a, ({_quality_sql('supplier')}) b"""
QUERIES["profile_summary"] = lambda spark, sf_dir: profiles.summed_up(reduce(DataFrame.unionByName, [_quality(spark, sf_dir, t) for t in COLUMNS]))
ORACLE_SQL["profile_summary"] = f"""
    SELECT count(*) AS n_sources, round(avg(overall), 6) AS average_quality, CAST(sum(n_rows) AS BIGINT) AS total_rows, count(*) FILTER (overall >= 0.9) AS excellent, count(*) FILTER (overall >= 0.8 AND overall < 0.9) AS good,
        count(*) FILTER (overall >= 0.7 AND overall < 0.8) AS fair, count(*) FILTER (overall < 0.7) AS poor FROM ({' UNION ALL '.join(map(_quality_sql, COLUMNS))})"""
_query("profile_json", "events", "SELECT key, count(*) AS n, count(*) FILTER (value IS NULL OR value IN ('', 'null')) AS n_null, count(DISTINCT CASE WHEN value NOT IN ('', 'null') THEN value END) AS n_different FROM (SELECT unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value) GROUP BY key")(
    lambda e: profiles.json_profile(e, "props")
)
_query("profile_text", "documents", r"""
    WITH w AS (SELECT doc_id AS path, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(w) AS BIGINT) AS n_words, length(text) AS n_chars, round(length(text) / len(string_split(text, chr(10))), 6) AS line_length,
        CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) ELSE 0 END AS word_length, CASE WHEN len(w) > 0 THEN 1.0::DOUBLE ELSE 0 END AS completeness FROM w""")(lambda d: files.text_profile(d.select(F.col("doc_id").alias("path"), "text")))

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_query("catalog_timeliness", "events", f"""SELECT age, count(*) AS n FROM (SELECT CASE WHEN d < 1 THEN 'current (< 1 day)' WHEN d < 7 THEN 'recent (< 1 week)' WHEN d < 30 THEN 'moderate (< 1 month)' WHEN d < 365 THEN 'dated (< 1 year)' ELSE 'stale (> 1 year)' END AS age
    FROM (SELECT (epoch({_NOW}) - floor(epoch(ts))) / 86400.0::DOUBLE AS d FROM events)) GROUP BY age""")(lambda e: e.groupBy(files.age_class(F.col("ts"), F.expr(_NOW)).alias("age")).agg(F.count("*").alias("n")))
_formats = "CASE suffix " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in files.FORMATS.items()) + " END"
# Names of files made of the pages' and documents' numbers, as the tables name none.
_SUFFIXES = [*files.FORMATS, "PNG", "exe", "JPG"]
_name_sql = "'file_' || page_id || '.' || list_extract([" + ", ".join(f"'{s}'" for s in _SUFFIXES) + f"], CAST(page_id % {len(_SUFFIXES)} + 1 AS INT))"


def _named() -> Column:
    return F.concat(F.lit("file_"), F.col("page_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % len(_SUFFIXES) + 1).cast("int")))


_query("catalog_format", "pages", f"SELECT page_id, format, CASE WHEN format IN ('csv', 'xlsx') THEN 'structured' WHEN format IN ('json', 'xml', 'html') THEN 'semi_structured' ELSE 'unstructured' END AS source_type FROM (SELECT page_id, {_formats} AS format FROM (SELECT page_id, lower(regexp_extract({_name_sql}, '[.]([A-Za-z0-9]+)$', 1)) AS suffix FROM pages))")(
    lambda p: p.select("page_id", files.file_format(_named()).alias("format")).select("page_id", "format", files.structure(F.col("format")).alias("source_type"))
)
_uploads = ", ".join(f"'{s}'" for s in files.UPLOADS)
_query("upload_filter", "pages", f"SELECT page_id, CASE WHEN suffix NOT IN ({_uploads}) THEN 'type' WHEN size > 6000 THEN 'size' ELSE 'accepted' END AS decision FROM (SELECT page_id, length(html) AS size, lower(regexp_extract({_name_sql}, '[.]([A-Za-z0-9]+)$', 1)) AS suffix FROM pages)")(
    lambda p: p.select("page_id", files.accepted(_named(), F.length("html"), most=6000).alias("decision"))
)
_kinds = "CASE WHEN contains(n, 'inv') THEN 'Finance' WHEN contains(n, 'hr') OR contains(n, 'policy') THEN 'HR' WHEN contains(n, 'case') OR contains(n, 'eng') OR contains(n, 'spec') THEN 'Engineering' ELSE 'General' END"
_query("dashboard_types", "pages", f"SELECT doc_type, count(*) AS n, round(sum(size) / 1024 / 1024, 2) AS megabytes FROM (SELECT {_kinds} AS doc_type, size FROM (SELECT lower(url) AS n, length(html) AS size FROM pages)) GROUP BY doc_type")(
    lambda p: p.select(F.lower("url").alias("n"), F.length("html").alias("size")).groupBy(F.expr(_kinds).alias("doc_type")).agg(F.count("*").alias("n"), F.round(F.sum("size") / 1024 / 1024, 2).alias("megabytes"))
)
