"""Queries of files and lines as sources: discovery, and profiles of CSV and JSON lines of unlike rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import tables
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query
from docloom.sources import catalogue, folders, unlike


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with every document and every page as a file."""
    folder = folders.new_folder(spark, "files")
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    catalogue.write_each(docs.select(F.concat(F.lit("documents/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")), folder)
    catalogue.write_each(pages.select(F.concat(F.lit("pages/page_"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content")), folder)
    return folder


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue.discover(spark, [_written(spark, sf_dir)])
    known = F.col("source_id") == F.left(F.md5("path"), F.lit(12))
    return found.select("name", "format", "source_type", "size_bytes", known.alias("id_of_path"), "description")


_files_sql = """
    SELECT 'doc_' || doc_id || '.txt' AS name, 'txt' AS format, 'unstructured' AS source_type, strlen(text) AS size_bytes FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL
    UNION ALL SELECT 'page_' || page_id || '.html', 'html', 'semi_structured', strlen(html) FROM pages WHERE html IS NOT NULL"""
QUERIES["catalog_discover"] = _discovered
ORACLE_SQL["catalog_discover"] = f"SELECT name, format, source_type, size_bytes, true AS id_of_path, 'Document: ' || name AS description FROM ({_files_sql})"
QUERIES["catalog_discover_search"] = lambda spark, sf_dir: catalogue.search(
    catalogue.discover(spark, [_written(spark, sf_dir)]), query="PAGE_1", source_type="semi_structured", form="html", least=1000
).select("name", "size_bytes")
ORACLE_SQL["catalog_discover_search"] = f"SELECT name, size_bytes FROM ({_files_sql}) WHERE name LIKE 'page_1%' AND size_bytes >= 1000"

HEADER = "event_id,user_id,event_type,props,value"


def _lines(events: DataFrame) -> DataFrame:
    """Events as CSV lines; those of errors lack their last field, those of purchases have one too many."""
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    last = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "purchase", F.concat(F.col("value").cast("string"), F.lit(",more"))).otherwise(F.col("value").cast("string"))
    return events.select(F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", quoted, last).alias("line"))


_csv_columns = {"event_id": "CAST(event_id AS VARCHAR)", "user_id": "CAST(user_id AS VARCHAR)", "event_type": "event_type", "props": "props", "value": "CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR) END"}
_csv_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count(*) FILTER ({v} IS NULL) AS nulls, count(DISTINCT {v}) AS different, min({v}) AS least, max({v}) AS most FROM events" for c, v in _csv_columns.items()
)
_share_sql = "round((total - nulls) / total, 6) AS completeness, round(CASE WHEN total > nulls THEN different / (total - nulls) ELSE 0 END, 6) AS uniqueness"
_query("profile_csv", "events", f"SELECT *, {_share_sql} FROM ({_csv_sql})")(lambda e: unlike.profile_csv(unlike.csv_rows(_lines(e), HEADER)))
_query("profile_csv_problems", "events", "SELECT CASE event_type WHEN 'error' THEN 'short' WHEN 'purchase' THEN 'long' ELSE 'good' END AS problem, count(*) AS n FROM events GROUP BY 1")(
    lambda e: unlike.problems(unlike.csv_rows(_lines(e), HEADER))
)


def _objects(events: DataFrame) -> DataFrame:
    """Events as JSON objects with one key by their kind; those of clicks come in a list."""
    line = F.concat(F.lit('{"user": '), "user_id", F.lit(', "'), "event_type", F.lit('": '), F.col("value").cast("string"), F.lit(', "props": '), "props", F.lit("}"))
    return events.select(F.when(F.col("event_type") == "click", F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("line"))


_kinds_sql = "SELECT event_type AS column_name, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events) - count(*) AS nulls, count(DISTINCT value) AS different FROM events GROUP BY event_type"
_query("profile_json_unlike", "events", f"""SELECT column_name, total, nulls, different, {_share_sql} FROM ({_kinds_sql}
    UNION ALL SELECT 'user', count(*), 0, count(DISTINCT user_id) FROM events UNION ALL SELECT 'props', count(*), 0, count(DISTINCT props) FROM events)""")(
    lambda e: unlike.profile_json(_objects(e)).drop("least", "most", "types")
)


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: each order as a table, with its number in one cell beside all its lines, under a head of two rows; and a
    table of keys and values."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(cell("l_linenumber"), cell("l_partkey"))
    # An order has few lines: their number does not grow with the table.
    of_order = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rows"))
    body = F.concat(F.lit("<tr><td rowspan="), F.size("rows").cast("string"), F.lit(">"), F.col("l_orderkey").cast("string"), F.lit("</td>"), F.array_join("rows.r", "</tr><tr>"), F.lit("</tr>"))
    head = "<table><tr><th rowspan='2'>Order<th colspan=2>Line</tr><tr><th>No<th>Part</tr>"
    facts = F.concat(F.lit("<table><tr><td>Status:</td><td>"), "o_orderstatus", F.lit("</td></tr><tr><td>Customer :<td>"), F.col("o_custkey").cast("string"), F.lit("</table>"))
    both = of_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("<p>x</p>"), F.lit(head), body, F.lit("</table>"), facts).alias("html"))


QUERIES["table_cells"] = lambda spark, sf_dir: tables.html_cells(_order_pages(spark, sf_dir))
ORACLE_SQL["table_cells"] = """
    WITH o AS (SELECT DISTINCT o_orderkey AS k, o_orderstatus AS status, o_custkey AS cust FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    l AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '<td>' || l_linenumber || '</td><td>' || l_partkey || '</td>') + 1 AS INT) AS r, l_linenumber, l_partkey FROM lineitem JOIN o ON l_orderkey = k),
    h AS (SELECT * FROM (VALUES (0, 0, 'Order', true), (0, 1, 'Line', true), (0, 2, 'Line', false), (1, 0, 'Order', false), (1, 1, 'No', true), (1, 2, 'Part', true)) t(r, c, text, anchor))
    SELECT k AS page_id, 0 AS "table", r AS "row", c AS col, text, true AS header, anchor FROM o, h
    UNION ALL SELECT k, 0, r, 0, CAST(k AS VARCHAR), false, r = 2 FROM l UNION ALL SELECT k, 0, r, 1, CAST(l_linenumber AS VARCHAR), false, true FROM l UNION ALL SELECT k, 0, r, 2, CAST(l_partkey AS VARCHAR), false, true FROM l
    UNION ALL SELECT k, 1, 0, 0, 'Status:', false, true FROM o UNION ALL SELECT k, 1, 0, 1, status, false, true FROM o UNION ALL SELECT k, 1, 1, 0, 'Customer :', false, true FROM o UNION ALL SELECT k, 1, 1, 1, CAST(cust AS VARCHAR), false, true FROM o"""
QUERIES["table_key_values"] = lambda spark, sf_dir: tables.html_key_values(_order_pages(spark, sf_dir))
ORACLE_SQL["table_key_values"] = """
    WITH o AS (SELECT DISTINCT o_orderkey AS k, o_orderstatus AS status, o_custkey AS cust FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT k AS page_id, 1 AS "table", 0 AS "row", 'Status' AS key, status AS value FROM o UNION ALL SELECT k, 1, 1, 'Customer', CAST(cust AS VARCHAR) FROM o"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and result: each customer with their nation and region as the JSON result of a document analysis."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # A customer's record: a page of two lines, a table whose first row is one wide cell, and two pairs.
    both = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    line = lambda c: F.struct(F.col(c).alias("content"))
    cell = lambda c, r, k, w: F.struct(F.col(c).cast("string").alias("content"), F.lit(r).alias("row_index"), F.lit(k).alias("column_index"), F.lit(w).alias("column_span"))
    grid = F.struct(F.lit(2).alias("row_count"), F.lit(2).alias("column_count"), F.array(cell("c_name", 0, 0, 5), cell("n_name", 1, 0, None), cell("r_name", 1, 1, 1)).alias("cells"))
    pair = lambda key, c, sure: F.struct(F.struct(F.lit(key).alias("content")).alias("key"), F.when(F.lit(c is not None), line(c or "n_name")).alias("value"), F.lit(sure).alias("confidence"))
    result = F.struct(
        F.col("c_name").alias("content"),
        F.array(F.struct(F.lit(1).alias("page_number"), F.array(line("c_name"), line("n_name")).alias("lines"))).alias("pages"),
        F.array(grid).alias("tables"),
        F.array(pair("Nation", "n_name", 0.9), pair("Fax", None, 0.4)).alias("key_value_pairs"),
    )
    return both.select(F.col("c_custkey").alias("doc_id"), F.to_json(result).alias("result"))


_customers = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
QUERIES["analysis_lines"] = lambda spark, sf_dir: tables.analysis_lines(tables.analysed(_results(spark, sf_dir)))
ORACLE_SQL["analysis_lines"] = f"SELECT c_custkey AS doc_id, 1 AS page_number, 0 AS line, c_name AS content FROM {_customers} UNION ALL SELECT c_custkey, 1, 1, n_name FROM {_customers}"
QUERIES["analysis_cells"] = lambda spark, sf_dir: tables.analysis_cells(tables.analysed(_results(spark, sf_dir)))
ORACLE_SQL["analysis_cells"] = f"""
    SELECT c_custkey AS doc_id, 0 AS "table", 0 AS "row", 0 AS col, c_name AS content FROM {_customers} UNION ALL SELECT c_custkey, 0, 0, 1, c_name FROM {_customers}
    UNION ALL SELECT c_custkey, 0, 1, 0, n_name FROM {_customers} UNION ALL SELECT c_custkey, 0, 1, 1, r_name FROM {_customers}"""
QUERIES["analysis_pairs"] = lambda spark, sf_dir: tables.analysis_pairs(tables.analysed(_results(spark, sf_dir)))
ORACLE_SQL["analysis_pairs"] = f"SELECT c_custkey AS doc_id, 'Nation' AS key, n_name AS value, 0.9::DOUBLE AS confidence FROM {_customers} UNION ALL SELECT c_custkey, 'Fax', NULL, 0.4::DOUBLE FROM {_customers}"
