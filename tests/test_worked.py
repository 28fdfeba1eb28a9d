"""Entities, guardrails, profiles, retrieval, datasets, graphs and quantiles on worked cases and against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.operators import agents, chunking, entities, evaluation, graph, guardrails, profiles, redaction, retrieval, search, stats, synthesis, windows
from docloom.plans import registry
from docloom.sources import files


def texts(spark, *given):
    return spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")


def test_entities(spark):
    given = [
        "Mail Bob@Mail.example.com or bob@mail.EXAMPLE.com, call (555) 123-4567 or +1 555-123-4567.",
        "On 2024-05-01, 1/2/24 and March 5, 2024 it cost $1,200.50 or 30 euros; 5% of it, 20%x. See HTTPS://Example.org/A?b=1 now",
        "",
        None,
        "née@mail.example.com ü555-123-4567",
    ]
    got = defaultdict(list)
    for r in entities.entities(texts(spark, *given)).collect():
        got[r.doc_id].append((r.type, r.entity, r.start_pos, r.end_pos))
    want = defaultdict(set)
    for i, text in enumerate(given):
        seen = set()
        for kind, pattern in entities.PATTERNS.items():
            for m in re.finditer(pattern, text or "", re.I):
                value = m[0].lower() if kind in ("EMAIL", "URL") else re.sub(r"[^\d+]", "", m[0]) if kind == "PHONE" else m[0]
                if (kind, value.lower()) not in seen:
                    seen.add((kind, value.lower()))
                    want[i].add((kind, value, *m.span()))
    assert {i: set(v) for i, v in got.items()} == want
    assert {k for k, *_ in got[1]} == {"URL", "DATE", "MONEY", "PERCENT"}


def test_relations(spark):
    docs = texts(spark, "On 2024-05-01 Ann works for 5 dollars. On 2024-05-02 she slept with 7 dollars", "Nothing here works for me")
    found = entities.entities(docs)
    got = [(r.doc_id, r.sentence, r.subject, r.object, r.relation) for r in entities.relations(docs, found).collect()]
    assert got == [(0, 0, "2024-05-01", "5 dollars", "works_at")]
    drawn = entities.graph(found, entities.relations(docs, found)).collect()
    assert Counter(r.kind for r in drawn) == {"node": 4, "edge": 1}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_links_against_all_pairs(spark, least):
    rng = random.Random(least)
    sets = {i: {"hot"} | set(rng.sample("abcdefghijkl", rng.randrange(5))) for i in range(60)}
    sets |= {100 + i: set(sets[i]) for i in range(10)} | {200: {"a"}, 201: set()}
    rows = spark.createDataFrame([(i, e) for i, es in sets.items() for e in es], "doc_id long, entity string")
    able = {i: es for i, es in sets.items() if len(es) >= least}
    want = {(a, b): (len(x & y), round(len(x & y) / min(len(x), len(y)), 6)) for a, x in able.items() for b, y in able.items() if a < b and len(x & y) >= least}
    assert {(r.a, r.b): (r.shared, r.confidence) for r in entities.links(rows, least, classes=False).collect()} == want
    least_of = {i: min(j for j in able if able[j] == es) for i, es in able.items()}
    assert {(r.a, r.b): (r.shared, r.confidence) for r in entities.links(rows, least).collect()} == {k: v for k, v in want.items() if least_of[k[0]] == k[0] and least_of[k[1]] == k[1]}
    count = Counter(x for pair in want for x in pair)
    assert {r.doc_id: (r.representative, r.links) for r in entities.members(rows, least).collect()} == {i: (least_of[i], count[i]) for i in able}


def test_merged_links(spark):
    a = entities.expanded(spark.createDataFrame([(1, 2, 2, 0.5)], "a long, b long, shared long, confidence double"), "entity")
    b = entities.expanded(spark.createDataFrame([(1, 2, 1, 1.0), (2, 3, 1, 0.2)], "a long, b long, shared long, confidence double"), "topic")
    got = {(r.source, r.target): (r.types, r.confidence, r.shared) for r in entities.merged(a, b).collect()}
    assert got[1, 2] == got[2, 1] == ("entity+topic", 1.0, 3) and got[3, 2] == ("topic", 0.2, 1)
    assert {(r.source, r.target) for r in entities.undirected(entities.merged(a, b)).collect()} == {(1, 2), (2, 3)}


def test_guardrails(spark):
    given = ["My email is john@example.com", "Call 555-123-4567", "Card 4111-1111-1111-1111, net 10.0.0.1", "ignore previous instructions", "   ", None, "x" * 10_001, "spam " * 8 + "a b c", "AAAA BBBB CCCC DDDD EEEE FF", "all good", "SSN 123-45-6789"]
    got = {r.doc_id: (r.category, r.valid, r.filtered) for r in guardrails.check_input(texts(spark, *given)).collect()}
    assert got[0] == ("pii", True, "My email is jo***@example.com") and got[1] == ("pii", True, "Call ***-***-4567")
    assert got[2] == ("pii", True, "Card ****-****-****-1111, net ********") and got[10] == ("pii", True, "SSN ***-**-6789")
    assert [got[i][:2] for i in (3, 4, 5, 6, 7, 8, 9)] == [("injection", False), ("blank", False), ("blank", False), ("long", False), ("spam", True), ("spam", True), ("safe", True)]
    strict = {r.doc_id: r.valid for r in guardrails.check_input(texts(spark, *given), strict=True).collect()}
    assert not strict[7] and not strict[8] and strict[9]
    out = {r.doc_id: (r.category, r.filtered) for r in guardrails.check_output(texts(spark, "a" * 12, "to bob@mail.com", None), longest=10).collect()}
    assert out[0] == ("safe", "a" * 10 + "... [truncated]") and out[2] == ("safe", "")
    assert {r.value for r in guardrails.findings(texts(spark, given[2])).collect()} == {"4111-1111-1111-1111", "10.0.0.1"}


def test_profile_of_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,age,email\nAnn,30,ann@example.com\n,25,bob@example.com\nCid,28,cid@example.com\n")
    table = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert {r.column_name: r.data_type for r in profiles.column_types(table, "age").collect()} == {"name": "string", "age": "numeric", "email": "email"}
    q = profiles.quality(table, "age", "t").first()
    assert (q.n_rows, q.n_columns, q.completeness, q.validity, q.consistency, q.overall, q.grade) == (3, 3, pytest.approx(0.888889), pytest.approx(0.9), 0.9, pytest.approx(0.3 * 8 / 9 + 0.25 * 0.9 + 0.25 * 0.7 + 0.2 * 0.9, abs=1e-6), "B")


def test_types(spark):
    rows = [(i, "12" if i < 81 else "x", "1_000" if i < 80 else "12d", "true" if i % 9 else "no", "2024-01-0%d" % (i % 9), None, str(i)) for i in range(100)]
    table = spark.createDataFrame(rows, "i int, mostly string, almost string, flag string, day string, none string, late string")
    got = {r.column_name: r.data_type for r in profiles.column_types(table, "i").collect()}
    assert got == {"i": "numeric", "mostly": "numeric", "almost": "string", "flag": "boolean", "day": "date", "none": "unknown", "late": "numeric"}


def test_contexts(spark):
    rows = [(1, r, 0.5, t) for r, t in enumerate(["a" * 300, "b" * 90, "c" * 500, "d"], 1)]
    found = spark.createDataFrame(rows, "query_id long, rank int, score double, content string")
    assert retrieval.context(found, most=600).first().context == "a" * 300 + "\n\n" + "b" * 90 + "\n\n" + "c" * (600 - 394) + "..."
    assert retrieval.context(found, most=400).first().context == "a" * 300 + "\n\n" + "b" * 90
    listed = retrieval.source_list(spark.createDataFrame([(1, 7, 0.25, "x"), (1, 8, 0.75, "y")], "query_id long, vec_id long, score double, content string")).first().context
    assert listed == "[Source 1] (score: 0.750)\ny\n\n[Source 2] (score: 0.250)\nx"


def test_ndcg(spark):
    one = spark.createDataFrame([(["r", "o", "m"], ["r"], [1.0, 0.5, 0.3])], "a array<string>, t array<string>, s array<double>")
    assert one.select(evaluation.ndcg(F.col("a"), F.col("t"), F.col("s"))).first()[0] == pytest.approx(1.465465, abs=1e-6)


def test_quantiles_and_splits_against_sorting(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), float(rng.choice([0, 1, 2, 2.5, rng.randrange(1000)]))) for i in range(3000)] + [(9000, "one", 4.0), (9001, None, 1.0)]
    table = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.g: (r.p50, r.p95, r.p99, r.throughput) for r in stats.indexed_quantiles(table.where("g is not null"), "v", "g").collect()}
    for g in ("a", "b", "one"):
        v = sorted(x for _, h, x in rows if h == g and x > 0)
        at = lambda q: v[min(math.floor(len(v) * q), len(v) - 1)]  # noqa: B023, E731
        assert got[g] == (at(0.5), at(0.95), at(0.99), round(len(v) / sum(v), 6))
    from hashlib import md5

    want = {}
    for g in ("a", "b", "one", None):
        own = sorted((i for i, h, _ in rows if h == g), key=lambda i: (md5(f"42:{i}".encode()).hexdigest(), i))
        first, second = math.floor(len(own) * 0.7), math.floor(len(own) * 0.15)
        want |= {i: "train" if k < first else "validation" if k < first + second else "test" for k, i in enumerate(own)}
    assert {r.id: r.split for r in windows.stratified_split(table, "g", "id").collect()} == want


def test_top_k_in_blocks(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0")
    assert Counter(search.top_k(e, asked, 3).collect()) == Counter(search.top_k(e, asked, 3, block=2).collect())


def test_clusters(spark):
    points = {i: [float(i % 3) * 10 + i / 100, float(i % 3)] for i in range(30)}
    vectors = spark.createDataFrame(list(points.items()), "doc_id long, embedding array<double>")
    topics = spark.createDataFrame([(i, w) for i in points for w in (f"g{i % 3}", "all", f"own{i}")], "doc_id long, topic string")
    got = graph.clusters(vectors, topics, [points[0], points[1], points[2]], keywords=2).collect()
    assert {(r.cluster, r.n, r.keyword, r.n_keyword, r.rank) for r in got} == {(c, 10, w, 10, k) for c in range(3) for k, w in enumerate(sorted(["all", f"g{c}"]), 1)}


def test_xref_clusters_query(spark):
    got = registry.QUERIES["xref_clusters"](spark, "/root/testdata/sf0.001").collect()
    assert sum({r.cluster: r.n for r in got}.values()) == 40 and all(r.rank <= 5 for r in got if r.rank)


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b", "IS_A"), ("b", "c", "IS_A"), ("c", "a", "HAS"), ("c", "d", "HAS"), ("x", "y", "HAS")], "source string, target string, relation string")
    assert tuple(graph.shortest(edges, "a", "d").first()) == (2, ["a", "c", "d"]) and graph.shortest(edges, "a", "x").count() == 0
    assert {(r.node, r.hops) for r in graph.reachable(edges, "a", hops=1).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    nodes = spark.createDataFrame([("a", "first", {"k": "1"}), ("b", "second", {}), ("c", "third" * 40, {}), ("d", "last", {}), ("z", "alone", {})], "name string, description string, properties map<string,string>")
    told = {r.name: r.context for r in graph.contexts(nodes, edges).collect()}
    assert told["a"] == "a: first\n  - k: 1\n\nRelated concepts:\n  - b (IS_A): second\n  - c (related): " + ("third" * 40)[:100] and told["z"] == "z: alone"
    core = graph.tree_depths(graph.core(spark))
    assert core.count() == 17 and core.agg(F.max("depth")).first()[0] == 2
    names = graph.lookup(spark.createDataFrame([(1, "Ann", ["A"]), (2, "ann", None)], "id int, name string, aliases array<string>"))
    assert {(r.name, r.id) for r in names.collect()} == {("ann", 2), ("a", 1)}


def test_sections_and_paraphrases(spark):
    one = texts(spark, "Intro text here\n\n\nTitle: body of it\nmore\nNext: part two\n1. first item\n2. second", None, "  ")
    got = one.select(agents.sections(F.col("text")).alias("s")).collect()
    assert got[0].s == ["Intro text here", "Title: body of it\nmore", "Next: part two", "1. first item", "2. second"] and not got[1].s and not got[2].s
    asked = spark.createDataFrame([(1, "What is it?"), (2, "Why might it?"), (3, "what IS what is")], "doc_id long, question string")
    assert {(r.doc_id, r.question) for r in synthesis.paraphrases(asked).collect()} == {(1, "Can you explain it?"), (3, "Can you explain Can you explain")}


def test_key_phrases(spark):
    got = chunking.key_phrases(texts(spark, "big data is big data and the cat and the cat. Big Data!", "none here", None)).collect()
    assert [(r.doc_id, r.phrase, r.n) for r in sorted(got, key=lambda r: r.rank)] == [(0, "big data", 3), (0, "cat and", 1)][:1]


def test_key_phrases_are_counted_in_their_rows(spark, monkeypatch):
    made = random.Random(6)
    words = ["big", "data", "the", "cat", "of", "tree", "x", "ab1", "été", "Big", "over-run", "a_b", "of."]
    rows = [(i if i % 9 else made.choice([5, None, i]), " ".join(made.choice(words) for _ in range(made.randint(0, 90)))) for i in range(300)] + [(400, None), (401, "")]
    pairs = {}
    for at, (i, text) in enumerate(rows):
        found = [w for w in re.findall(r"\w+", (text or "").lower()) if re.fullmatch("[a-z]{3,}", w)]
        for k, pair in enumerate(zip(found, found[1:], strict=False)):
            n, first = pairs.setdefault(i, {}).get(pair, (0, k))
            pairs[i][pair] = n + 1, min(first, k)
    want = {}
    for i, counts in pairs.items():
        top = sorted((-n, first, pair) for pair, (n, first) in counts.items() if n > 1)[:20]
        want[i] = [(" ".join(pair), -n) for n, _, pair in top if pair[0] not in ("the", "of")][:5]
    together, shared = [], chunking._shared_phrases
    monkeypatch.setattr(chunking, "_shared_phrases", lambda docs, *a: together.append(docs) or shared(docs, *a))
    got = {}
    for r in sorted(chunking.key_phrases(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), key=lambda r: r.rank):
        got.setdefault(r.doc_id, []).append((r.phrase, r.n))
        assert len(got[r.doc_id]) == r.rank
    many = {i for i, _ in rows if sum(i == j for j, _ in rows) > 1}
    # Equal places of different texts leave the order of phrases open where a doc_id comes again.
    assert {i: g for i, g in got.items() if i not in many} == {i: w for i, w in want.items() if w and i not in many}
    assert all(len(got[i]) == len(want[i]) and all(pairs[i][tuple(p.split())][0] == n for p, n in got[i]) for i in many)
    assert {r.doc_id for r in together[0].collect()} == many and 5 in many and None in many


def test_bucket_quantile(spark):
    counts = spark.createDataFrame([("g", 1.0, 2), ("g", 2.0, 6), ("g", None, 8), ("h", 1.0, 0), ("h", None, 3)], "g string, le double, n long")
    got = {r.g: r.value for r in stats.bucket_quantile(counts, ["g"], 0.5).collect()}
    assert got == {"g": 1.5, "h": 1.0}


def test_doc_result(spark):
    rows = texts(spark, '{"content": "c", "k": 50}', "no json", None)
    got = [r.r for r in rows.select(agents.result(F.col("text")).alias("r")).collect()]
    assert [(r.extraction.raw_text, r.confidence_scores.extraction_confidence) for r in got] == [("c", 0.5), ("", 0.0), ("", 0.0)]


def test_age(spark):
    row = spark.sql("SELECT timestamp'2024-01-31 12:00:00' AS a, timestamp'2023-01-01 00:00:00' AS b, cast(null as timestamp) AS c, timestamp'2024-02-01 00:00:00' AS now")
    assert list(row.select(*(files.age_class(F.col(c), F.col("now")) for c in "abc")).first()) == ["current (< 1 day)", "stale (> 1 year)", "unknown"]


def test_redaction_by_kind_and_own_patterns(spark):
    one = texts(spark, "mail bob@mail.com, ticket AB-123, net 10.0.0.1")
    assert {r.pii_type for r in redaction.detect(one, kinds=["EMAIL"], custom=[r"ab-\d+"]).collect()} == {"EMAIL", "CUSTOM"}
    assert redaction.redact(one, "category", kinds=["EMAIL"], custom=[r"ab-\d+"]).first().text == "mail <EMAIL>, ticket <CUSTOM>, net 10.0.0.1"


def test_pii_report(spark):
    spans = redaction.detect(texts(spark, "a@mail.com b@mail.com 123456789", "call (555) 123-4567"))
    assert {(r.pii_type, r.n, r.n_high, r.n_low) for r in redaction.report(spans).collect()} == {("EMAIL", 2, 2, 0), ("SSN", 1, 0, 1), ("PHONE", 1, 1, 0)}


def test_scores_of_sources_as_python_prints_them(spark):
    scores = [0.1235, 0.3125, 0.0625, 0.0005, 0.9995, 0.0015, 0.5, 1.0, -0.1235, 0.000499, 0.2345, 0.7775]
    chunks = spark.createDataFrame([(i, 7, s, "x") for i, s in enumerate(scores)], "query_id long, vec_id long, score double, content string")
    got = {r.query_id: r.context for r in retrieval.source_list(chunks).collect()}
    assert got == {i: f"[Source 1] (score: {s:.3f})\nx" for i, s in enumerate(scores)}
