"""Queries of entities, topics and the links between documents, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import entities, graph, text, vector_index
from docloom.plans.registry import ORACLE_SQL, QUERIES, _query


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _normal(kind: str) -> str:
    return {"EMAIL": "lower(h)", "URL": "lower(h)", "PHONE": r"regexp_replace(h, '[^\d+]', '', 'g')"}.get(kind, "h")


_hits = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS type, {i} AS place, regexp_extract_all(text, '(?i){_quoted(p)}') AS h, regexp_split_to_array(text, '(?i){_quoted(p)}') AS g FROM @TABLE" for i, (k, p) in enumerate(entities.PATTERNS.items())
)
_normals = "CASE type " + " ".join(f"WHEN '{k}' THEN {_normal(k)}" for k in entities.PATTERNS) + " END"


def _found_sql(table: str = "documents") -> str:
    """doc_id, type, place, entity, start_pos, end_pos, h: the first match of each kind and normal form in a text."""
    return f"""
        SELECT doc_id, type, place, entity, start_pos, start_pos + length(h) AS end_pos, h FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, type, lower(entity) ORDER BY start_pos) AS r FROM (
                SELECT doc_id, type, place, h, {_normals} AS entity, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) AS INT) AS start_pos
                FROM (SELECT doc_id, type, place, h AS hs, g, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS i FROM ({_hits.replace('@TABLE', table)}))))
        WHERE r = 1"""


_found = _found_sql()
_query("entities_pattern", "documents", f"SELECT doc_id, type, entity, start_pos, end_pos FROM ({_found})")(lambda d: entities.entities(d).select("doc_id", "type", "entity", "start_pos", "end_pos"))
_query("entity_summary", "documents", f"SELECT doc_id, type, count(*) AS n, string_agg(entity, ' | ' ORDER BY start_pos) AS entities FROM ({_found}) GROUP BY doc_id, type")(lambda d: entities.summary(entities.entities(d)))

# `conversations` and `documents` hold no sentence with both a relation's verb and two entities, so the queries of relations
# read the contact details of suppliers as one sentence each, with both of them in it.
_contact = "'supplier {0} works for nation {1} since ' || (1990 + {0} % 30) || '-05-01 at +1 555 010 ' || (1000 + {0}) || ' or 12 dollars'"
_contacts_sql = f"(SELECT s_suppkey AS doc_id, {_contact.format('s_suppkey', 's_nationkey')} AS text FROM supplier)"


def _contacts(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").alias("doc_id"), F.expr(_contact.format("s_suppkey", "s_nationkey")).alias("text"))


_label = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for n, p in entities.RELATIONS.items()) + " END"
_related = f"""
    WITH f AS ({_found_sql('c')}), c AS {_contacts_sql},
    l AS (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS sentence FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+') AS w FROM c)),
    t AS (SELECT doc_id, sentence, low, {_label} AS relation FROM (SELECT doc_id, sentence, lower(w) AS low FROM l)),
    e AS (SELECT t.doc_id, sentence, relation, entity, place, start_pos FROM t JOIN f ON t.doc_id = f.doc_id AND contains(low, lower(h)) WHERE relation IS NOT NULL)
"""
_pair_sql = "SELECT a.doc_id, CAST(a.sentence AS INT) AS sentence, a.entity AS subject, b.entity AS object, a.relation FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND (a.place, a.start_pos, a.entity) < (b.place, b.start_pos, b.entity)"
_with_f = _related.replace("WITH f AS", "WITH c AS " + _contacts_sql + ", f AS").replace(f", c AS {_contacts_sql},\n", ",\n")
_query("entity_relations", "supplier", _with_f + _pair_sql)(lambda s: entities.relations(_contacts(s), entities.entities(_contacts(s))))
_query("entity_graph", "supplier", f"""{_with_f}, n AS (SELECT doc_id, entity, type, 'entity_' || (row_number() OVER (PARTITION BY doc_id ORDER BY place, start_pos) - 1) AS id FROM f), i AS (SELECT doc_id, entity, min(id) AS id FROM n GROUP BY 1, 2), p AS ({_pair_sql})
    SELECT 'node' AS kind, doc_id, id AS source, NULL AS target, type AS label FROM n UNION ALL
    SELECT 'edge', p.doc_id, a.id, b.id, relation FROM p JOIN i a ON a.doc_id = p.doc_id AND a.entity = subject JOIN i b ON b.doc_id = p.doc_id AND b.entity = object""")(
    lambda s: entities.graph(entities.entities(_contacts(s)), entities.relations(_contacts(s), entities.entities(_contacts(s))))
)


def _links_sql(rows: str, least: int, classes: bool = True) -> str:
    """Links of documents, or of the least ones of each set alike."""
    each = f"SELECT doc_id, list_sort(list(DISTINCT entity)) AS l FROM ({rows}) GROUP BY doc_id HAVING count(DISTINCT entity) >= {least}"
    each = f"SELECT min(doc_id) AS doc_id, l FROM ({each}) GROUP BY l" if classes else each
    one = f"(SELECT doc_id, len(l) AS n, unnest(l) AS entity FROM ({each}))"
    return f"SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, round(count(*) / min(least(a.n, b.n)), 6) AS confidence FROM {one} a JOIN {one} b ON a.entity = b.entity AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= {least}"


def _members_sql(rows: str, least: int) -> str:
    """Links counted document by document, without classes."""
    return f"""
        WITH e AS (SELECT DISTINCT doc_id, entity FROM ({rows})), s AS (SELECT doc_id, list_sort(list(entity)) AS l FROM e GROUP BY doc_id HAVING count(*) >= {least}),
        p AS (SELECT a.doc_id AS doc_id, b.doc_id AS other FROM e a JOIN e b ON a.entity = b.entity AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= {least})
        SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS representative, coalesce(n, 0) AS links FROM s LEFT JOIN (SELECT doc_id, count(*) AS n FROM p GROUP BY 1) USING (doc_id)"""


# Documents of the given tables have two entities only where a kind is met twice, so numbers count too.
_NUMBERS = r"[0-9]{2,}"
_named_sql = rf"SELECT doc_id, type || ':' || entity AS entity FROM ({_found}) UNION ALL SELECT doc_id, 'NUMBER:' || unnest(regexp_extract_all(text, '{_NUMBERS}')) FROM documents"


def _named(docs: DataFrame) -> DataFrame:
    kinds = entities.entities(docs).select("doc_id", F.concat_ws(":", "type", "entity").alias("entity"))
    numbers = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_NUMBERS), F.lit(0))).alias("number"))
    return kinds.unionByName(numbers.select("doc_id", F.concat(F.lit("NUMBER:"), "number").alias("entity")))


_query("xref_entity_links", "documents", _links_sql(_named_sql, 2))(lambda d: entities.links(_named(d), 2))
_query("xref_entity_members", "documents", _members_sql(_named_sql, 2))(lambda d: entities.members(_named(d), 2))

# Topics of the benchmark's texts: each link between two texts stands by itself.
_strip = r"""regexp_replace(regexp_replace(w, '^[.,!?;:"()\[\]{}]+', ''), '[.,!?;:"()\[\]{}]+$', '')"""
_topic_sql = rf"SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, {_strip} AS entity FROM (SELECT item_id AS doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS w FROM benchmark)) WHERE length(entity) > 2 AND regexp_matches(entity, '^[A-Z]')"


def _topics(b: DataFrame) -> DataFrame:
    word = F.regexp_replace(F.regexp_replace("w", r"""^[.,!?;:"()\[\]{}]+""", ""), r"""[.,!?;:"()\[\]{}]+$""", "")
    words = b.select(F.col("item_id").alias("doc_id"), F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("w")).select("doc_id", word.alias("entity"))
    return words.where((F.length("entity") > 2) & F.col("entity").rlike("^[A-Z]")).distinct()


_query("xref_topic_links", "benchmark", _links_sql(_topic_sql, 1))(lambda b: entities.links(_topics(b), 1))

_query("xref_topic_members", "benchmark", _members_sql(_topic_sql, 1))(lambda b: entities.members(_topics(b), 1))

_vector_sql = "SELECT item_id, " + "[" + ", ".join(f"(CAST('0x' || substr(sha256(text), {2 * i + 1}, 2) AS INT) - 128) / 128.0::DOUBLE" for i in range(16)) + "] AS v FROM benchmark"
_NEAR = 0.5


def _semantic(b: DataFrame) -> DataFrame:
    """Links from each text to at most five whose mock vectors have a cosine of _NEAR or more."""
    vectors = b.select(F.col("item_id").alias("vec_id"), text.mock_embedding(F.col("text")).alias("embedding"))
    near = vector_index.exact(vectors, vectors, 5).where(F.col("score") >= _NEAR)
    return near.select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), F.lit("semantic").alias("type"), F.col("score").alias("confidence"), F.lit(0).cast("long").alias("shared"))


_all_sql = f"""
    WITH t AS ({_links_sql(_topic_sql, 1, False)}), v AS ({_vector_sql}),
    s AS (SELECT a.item_id AS source, b.item_id AS target, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10), 6) AS confidence FROM v a JOIN v b ON a.item_id <> b.item_id),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS r FROM s) WHERE r <= 5 AND confidence >= {_NEAR}),
    e AS (SELECT a AS source, b AS target, 1 AS place, 'topic' AS type, confidence, shared FROM t UNION ALL SELECT b, a, 1, 'topic', confidence, shared FROM t UNION ALL SELECT source, target, 2, 'semantic', confidence, 0 FROM r),
    m AS (SELECT source, target, string_agg(type, '+' ORDER BY place) AS types, max(confidence) AS confidence, CAST(sum(shared) AS BIGINT) AS shared FROM e GROUP BY 1, 2)
"""


def _all_links(b: DataFrame) -> DataFrame:
    named = entities.entities(b.select(F.col("item_id").alias("doc_id"), "text")).select("doc_id", "entity")
    return entities.merged(entities.expanded(entities.links(named, 2, classes=False), "entity"), entities.expanded(entities.links(_topics(b), 1, classes=False), "topic"), _semantic(b))


_query("xref_all_links", "benchmark", _all_sql + "SELECT * FROM m")(_all_links)
_query("xref_graph", "benchmark", _all_sql + "SELECT source, target, types, confidence FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source) AS r FROM m) WHERE r = 1")(
    lambda b: entities.undirected(_all_links(b))
)


def _stats(b: DataFrame) -> DataFrame:
    docs = b.select(F.col("item_id").alias("doc_id"), "text")
    n_entities, n_topics = entities.entities(docs).agg(F.count("*").alias("total_entities")), _topics(b).agg(F.count("*").alias("total_topics"))
    return docs.agg(F.count("*").alias("registered_documents"), F.count("text").alias("documents_with_embeddings")).crossJoin(n_entities).crossJoin(n_topics)  # three rows of one number each


_query("xref_stats", "benchmark", f"SELECT count(*) AS registered_documents, count(text) AS documents_with_embeddings, (SELECT count(*) FROM ({_found_sql('(SELECT item_id AS doc_id, text FROM benchmark)')})) AS total_entities, (SELECT count(*) FROM ({_topic_sql})) AS total_topics FROM benchmark")(_stats)


def xref_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, n, keyword, n_keyword, rank: the documents of each cluster of mock vectors, and its five most frequent topics."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    vectors = b.select(F.col("item_id").alias("doc_id"), text.mock_embedding(F.col("text")).alias("embedding"))
    start = [r[1] for r in vectors.orderBy(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string")))).limit(5).collect()]
    return graph.clusters(vectors, _topics(b).withColumnRenamed("entity", "topic"), start)


QUERIES["xref_clusters"] = xref_clusters
