"""Queries of made datasets and their checks, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import agents, search, synthesis
from docloom.plans.registry import _query


def _draw(what: str, key: str = "doc_id", seed: str = "42") -> str:
    return f"CAST('0x' || left(md5('{seed}|{what}|' || {key}), 8) AS BIGINT)"


def _list(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def _drawn(options: list[str], number: str) -> str:
    return f"list_extract({_list(options)}, CAST({number} % {len(options)} + 1 AS INT))"


def _filled(template: str, **values: str) -> str:
    for name, value in values.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


_template = "CASE question_type " + " ".join(f"WHEN '{k}' THEN {_drawn(o, _draw('template'))}" for k, o in synthesis.TEMPLATES.items()) + " END"
_asked = rf"""
    w AS (SELECT doc_id, text, lang, list_filter(list_transform(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: trim(x, '.,!?;:()"''')), lambda x: length(x) > 2 AND regexp_matches(x, '^\p{{Lu}}')) AS w, regexp_extract_all(text, '"([^"]+)"', 1) AS g FROM documents),
    t AS (SELECT doc_id, text, lang AS category, list_sort(list_distinct(list_concat(w, g)))[1:20] AS topics, {_draw('difficulty')} / 4294967296.0::DOUBLE AS unit, {_drawn(synthesis.TYPES, _draw('type'))} AS question_type FROM w),
    p AS (SELECT *, CASE WHEN unit < 0.4 THEN 'easy' WHEN unit < 0.8 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN len(topics) > 0 THEN topics[CAST({_draw('topic')} % len(topics) + 1 AS INT)] ELSE 'the topic' END AS topic,
        CASE WHEN len(topics) > 1 THEN topics[CAST({_draw('second')} % len(topics) + 1 AS INT)] END AS second, {_template} AS template FROM t),
    q AS (SELECT doc_id, difficulty, question_type, topic, category, text, {_filled('template', topic='topic', topic1='topic', topic2="coalesce(second, 'related concept')", event='topic', location='topic', other_topic="coalesce(second, 'another aspect')")} AS question FROM p)"""
# A context takes each telling sentence that still fits; the fold is a recursion over the sentences of a text.
_answered = f"""{_asked},
    s AS (SELECT *, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: contains(lower(x), lower(topic))) AS telling FROM q),
    f AS (SELECT *, list_reduce(list_prepend({{'n': 0::BIGINT, 'kept': []::VARCHAR[]}}, list_transform(telling, lambda x: {{'n': length(x), 'kept': [trim(x, ' ')]}})),
        lambda a, x: CASE WHEN a.n + x.n <= 1000 THEN {{'n': a.n + x.n, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept AS kept FROM s),
    a AS (SELECT *, CASE WHEN len(telling) > 0 THEN left(trim(telling[1], ' '), 500) ELSE 'Based on the provided context, ' || topic || ' refers to relevant information in the document.' END AS answer,
        CASE WHEN len(kept) > 0 THEN array_to_string(kept, '. ') || '.' ELSE left(text, 1000) END AS context FROM f)"""

_query("synth_qa", "documents", f"WITH {_asked} SELECT doc_id, difficulty, question_type, topic, question, category FROM q")(lambda d: synthesis.questions(d).drop("text"))


def _pairs(d: DataFrame) -> DataFrame:
    return synthesis.answers(synthesis.questions(d))


_query("synth_answer", "documents", f"WITH {_answered} SELECT doc_id, md5(answer) AS answer_md5, md5(context) AS context_md5 FROM a")(lambda d: _pairs(d).select("doc_id", F.md5("answer").alias("answer_md5"), F.md5("context").alias("context_md5")))
_query("synth_edge", "documents", f"WITH {_asked} SELECT doc_id, {_filled(_drawn(synthesis.EDGE_CASES, _draw('pattern')), topic='topic')} AS question, {_filled(_list([synthesis.EDGE_ANSWER]) + '[1]', topic='topic')} AS answer FROM q WHERE {_draw('edge')} < 429496729")(
    lambda d: synthesis.edge_cases(synthesis.questions(d))
)
_query("synth_negative", "documents", f"""WITH {_answered},
    n AS (SELECT *, doc_id % 64 AS part, md5('42|negative|' || doc_id) AS pos FROM a),
    o AS (SELECT doc_id, question, topic, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS other_id, coalesce(lead(context) OVER w, first_value(context) OVER w) AS context FROM n WINDOW w AS (PARTITION BY part ORDER BY pos, doc_id))
    SELECT doc_id, question, {_filled(_drawn(synthesis.NEGATIVES, _draw('reply')), topic='topic', answer="'the requested information'")} AS answer, other_id, md5(context) AS context_md5 FROM o WHERE other_id <> doc_id""")(
    lambda d: synthesis.negatives(_pairs(d)).select("doc_id", "question", "answer", "other_id", F.md5("context").alias("context_md5"))
)
_new = "CASE " + " ".join(f"WHEN contains(lower(question), '{p.lower()}') THEN regexp_replace(question, '(?i){p}', '{o}', 'g')" for p, o in synthesis.PARAPHRASES.items()) + " END"
_query("synth_paraphrase", "documents", f"WITH {_asked} SELECT doc_id, copy, new AS question FROM (SELECT doc_id, question, {_new} AS new FROM q), (VALUES (1), (2)) AS c(copy) WHERE new <> question")(lambda d: synthesis.paraphrases(synthesis.questions(d)))
_lengths = "round(avg(length(question)), 6) AS question_length, round(avg(length(answer)), 6) AS answer_length"
_query("synth_stats", "documents", f"WITH {_answered} SELECT 'all' AS field, 'all' AS value, count(*) AS n, {_lengths} FROM a UNION ALL SELECT 'difficulty', difficulty, count(*), {_lengths} FROM a GROUP BY difficulty UNION ALL SELECT 'question_type', question_type, count(*), {_lengths} FROM a GROUP BY question_type")(
    lambda d: synthesis.counted(_pairs(d))
)
_split = f"CASE WHEN {_draw('split')} / 4294967296.0::DOUBLE < 0.7 THEN 'train' WHEN {_draw('split')} / 4294967296.0::DOUBLE < 0.85 THEN 'validation' ELSE 'test' END"
_query("split_simple", "documents", f"SELECT doc_id, {_split} AS split FROM documents")(lambda d: synthesis.split(d.select("doc_id"), "doc_id"))
_query("dataset_stats", "documents", f"WITH {_answered} SELECT {_split} AS split, count(*) AS n, {_lengths}, round(avg(length(context)), 6) AS context_length, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM a GROUP BY 1")(
    lambda d: synthesis.shares(synthesis.split(_pairs(d), "doc_id"))
)
_sides = f"""{_answered}, b AS (SELECT *, {_split} AS split FROM a),
    l AS (SELECT x.doc_id FROM b x JOIN (SELECT DISTINCT md5(lower(trim(question))) AS h FROM b WHERE split = 'train') y ON md5(lower(trim(x.question))) = y.h WHERE split <> 'train'
        UNION ALL SELECT x.doc_id FROM b x JOIN (SELECT DISTINCT md5(lower(trim(context))) AS h FROM b WHERE split = 'train') y ON md5(lower(trim(x.context))) = y.h WHERE split <> 'train'),
    m AS (SELECT split, count(*) AS n, avg(CASE WHEN trim(question) <> '' AND trim(answer) <> '' AND trim(context) <> '' THEN 1.0::DOUBLE ELSE 0 END) AS completeness, count(DISTINCT question) / count(*) AS unique_questions FROM b GROUP BY split),
    v AS (SELECT split, least(1.0::DOUBLE, 2 * count(DISTINCT w) / count(*)) AS diversity FROM (SELECT split, unnest(list_filter(regexp_split_to_array(lower(question || ' ' || answer), '\\s+'), lambda x: x <> '')) AS w FROM b) GROUP BY split),
    c AS (SELECT split, greatest(0, 1 - stddev_pop(n) / avg(n)) AS balance FROM (SELECT split, category, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY split),
    z AS (SELECT *, 0.3::DOUBLE * completeness + 0.25::DOUBLE * coalesce(diversity, 0) + 0.25::DOUBLE * balance + 0.2::DOUBLE * unique_questions AS overall FROM m LEFT JOIN v USING (split) JOIN c USING (split)),
    g AS (SELECT avg(overall) AS mean, count(*) FILTER (completeness < 0.8) AS low, count(*) AS present, least(1.0::DOUBLE, (SELECT count(*) FROM l) / sum(CASE WHEN split <> 'train' THEN n ELSE 0 END)) AS leak, max(CASE WHEN split = 'train' THEN diversity END) AS diversity FROM z),
    k AS (SELECT (SELECT max(n) > 3 * min(n) FROM (SELECT count(*) AS n FROM b WHERE split = 'train' GROUP BY difficulty)) AS skew_d, (SELECT max(n) > 3 * min(n) FROM (SELECT count(*) AS n FROM b WHERE split = 'train' GROUP BY question_type)) AS skew_t),
    e AS (SELECT (3 - present) + low + (leak > 0.3)::INT AS n_issues, (leak > 0 AND leak <= 0.3)::INT + skew_d::INT + skew_t::INT + (diversity < 0.5)::INT AS n_warnings, mean FROM g, k)
"""
_query("dataset_validate", "documents", f"""WITH {_sides} SELECT CAST(n_issues AS BIGINT) AS n_issues, CAST(n_warnings AS BIGINT) AS n_warnings, n_issues = 0 AS valid,
    CASE WHEN n_issues > 0 THEN 'F' WHEN mean - 0.05 * n_warnings >= 0.9 THEN 'A' WHEN mean - 0.05 * n_warnings >= 0.8 THEN 'B' WHEN mean - 0.05 * n_warnings >= 0.7 THEN 'C' WHEN mean - 0.05 * n_warnings >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM e""")(
    lambda d: _validated(synthesis.split(_pairs(d), "doc_id"))
)


def _validated(pairs: DataFrame) -> DataFrame:
    held_out = pairs.where("split <> 'train'").withColumnRenamed("doc_id", "item_id")
    return synthesis.validated(pairs, search.leakage(held_out, pairs.where("split = 'train'")))


# The three cuts in SQL: a mark is set where a section begins, as that engine's patterns cannot look ahead.
_cut = r"string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n\n+', chr(1), 'g'), '\n([A-Z][a-z]+:)', chr(1) || '\1', 'g'), '\n(\d+\.)', chr(1) || '\1', 'g'), chr(1))"
_each = rf"SELECT doc_id, unnest(s) AS answer, unnest(range(0, len(s))) AS place FROM (SELECT doc_id, list_filter(list_transform({_cut}, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS s FROM documents)"
_query("train_sections", "documents", f"SELECT doc_id, CAST(place AS INT) AS place, md5(answer) AS section_md5 FROM ({_each})")(lambda d: d.select("doc_id", F.posexplode(agents.sections(F.col("text"))).alias("place", "section")).select("doc_id", "place", F.md5("section").alias("section_md5")))
_topic = r"array_to_string(list_filter(regexp_split_to_array(answer, '\s+'), lambda x: x <> '')[1:10], ' ') || '...'"
_query("train_qa", "documents", rf"SELECT doc_id, CAST(place AS INT) AS place, {_drawn(synthesis.QUESTIONS, _draw('prefix', 'key'))} || chr(10) || chr(10) || {_topic} AS question, md5(answer) AS answer_md5 FROM (SELECT *, doc_id || ':' || place AS key FROM ({_each}) WHERE place < 5) WHERE length(answer) BETWEEN 10 AND 4096")(
    lambda d: synthesis.section_questions(d).select("doc_id", "place", "question", F.md5("answer").alias("answer_md5"))
)
