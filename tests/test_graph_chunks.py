"""Typed graphs, chunks by the caller's length, links over hot entities, and sums in blocks, on worked and brute-force cases."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, entities, evaluation, synthesis, typed_graph, windows
from docloom.plans import registry

EDGES = "source string, target string, relation string, bidirectional boolean"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "is_a", False), ("b", "c", "is_a", False), ("d", "b", "uses", True), ("d", "e", "is_a", None), ("a", "b", "is_a", False), ("x", None, "is_a", True), ("a", "e", "uses", False)]
    return spark.createDataFrame(rows, EDGES)


def test_relations_of_a_node(edges):
    got = lambda *a, **k: sorted(map(tuple, typed_graph.relations(edges, *a, **k).collect()))
    assert got("b") == [("in", "is_a", "a"), ("in", "uses", "d"), ("out", "is_a", "c"), ("out", "uses", "d")]
    assert got("b", direction="out") == [("out", "is_a", "c"), ("out", "uses", "d")]
    assert got("d", direction="in") == [("in", "uses", "b")]
    assert got("b", types=["is_a"]) == [("in", "is_a", "a"), ("out", "is_a", "c")]
    assert got("x") == []


def plain_related(edges, start, hops, types):
    """Breadth first, with the least of all shortest ways."""
    ways = {(a, b, r) for x, y, r, _ in edges if y and (types is None or r in types) for a, b in ((x, y), (y, x))}
    best = {start: (0, [start], [])}
    front = [start]
    for hop in range(1, hops + 1):
        found = {}
        for a in front:
            for x, b, r in ways:
                if x == a and b not in best:
                    way = (best[a][1], [*best[a][2], r])
                    found[b] = min(found.get(b, way), way)
        for b, (path, rel) in found.items():
            best[b] = (hop, [*path, b], rel)
        front = list(found)
    return {(n, h, tuple(p), tuple(r)) for n, (h, p, r) in best.items()}


def test_related_by_types(spark):
    made = random.Random(2)
    for n, m in ((6, 8), (15, 30)):
        rows = [(f"n{made.randrange(n)}", f"n{made.randrange(n)}", made.choice("pqr"), made.choice([True, False, None])) for _ in range(m)]
        table = spark.createDataFrame(rows, EDGES)
        for types in (None, ["p"], ["p", "r"]):
            got = {(r.node, r.hops, tuple(r.path), tuple(r.relations)) for r in typed_graph.related(table, "n1", hops=4, types=types).collect()}
            assert got == plain_related(rows, "n1", 4, types)
    assert typed_graph.related(table, "not there").count() == 1
    assert typed_graph.related(table.limit(0), "n1").count() == 1


def test_import(spark):
    one = '{"name": "g", "nodes": [{"node_id": "1", "name": "Ann", "aliases": ["A", "annie"]}, {"node_id": "2", "name": "Bob", "parent_id": "1"}], "relations": [{"source_id": "1", "target_id": "2", "relation_type": "knows", "bidirectional": true}]}'
    two = '{"nodes": [{"node_id": "1", "name": "Ann", "aliases": ["A", "annie"]}, {"name": "no id"}], "relations": [{"source_id": "1", "target_id": "2", "relation_type": "knows"}]}'
    nodes, edges = typed_graph.imported(spark.createDataFrame([(x,) for x in (one, two, "no json", None, "{}")], "line string"))
    assert sorted(map(tuple, nodes.collect())) == [("1", "Ann", None, ["A", "annie"]), ("2", "Bob", "1", [])]
    assert [tuple(r) for r in edges.collect()] == [("1", "2", "knows", True)]
    assert {(r.direction, r.other) for r in typed_graph.relations(edges, "2").collect()} == {("in", "1"), ("out", "1")}


def test_chunks_by_length(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(900, None, "en", "s", 0), (901, " \n ", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    for by_sentence in (False, True):
        assert Counter(chunking.chunks_by(table, len, by_sentence=by_sentence).collect()) == Counter(chunking.chunks(table, by_sentence=by_sentence).collect())
    words = chunking.chunks_by(table, chunking.word_count, size=50, overlap=0).collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    assert max(len(r.content.split()) for r in words) <= 51
    joined = {}
    for r in sorted(words, key=lambda r: (r.doc_id, r.start_char)):
        joined.setdefault(r.doc_id, []).extend(r.content.split())
    assert {i for i, t in texts.items() if t and t.strip()} == set(joined)
    bare = lambda ws: Counter(w.strip(".") for w in ws if w.strip("."))  # noqa: E731 - a full stop may be lost or said twice at a cut
    assert all(bare(w) == bare(texts[i].split()) for i, w in joined.items())
    spark.udtf.register("cut", chunking.chunk_function(size=3, overlap=0, length=chunking.word_count))
    assert [r.content for r in spark.sql("SELECT content FROM VALUES ('one two. three four. five') AS t(x), LATERAL cut(x)").collect()] == ["one two.", "three four. five"]


@pytest.mark.parametrize("most", [None, 5, 17])
def test_links_over_hot_entities(spark, most):
    made = random.Random(8)
    rows = [(d, f"e{int(made.paretovariate(0.6)) % 60}") for d in range(150) for _ in range(made.randint(1, 5))] + [(d, "hot") for d in range(0, 150, 2)]
    table = spark.createDataFrame(rows, "doc_id long, entity string").repartition(4)
    sets = {}
    for d, e in rows:
        sets.setdefault(d, set()).add(e)
    for least in (1, 2):
        want = {(a, b): (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])), 6)) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least and min(len(sets[a]), len(sets[b])) >= least}
        got = entities.links(table, least, classes=False, most=most).collect()
        assert len({(r.a, r.b) for r in got}) == len(got)
        assert {(r.a, r.b): (r.shared, r.confidence) for r in got} == want


def test_no_task_has_all_rows_of_an_entity(spark):
    long = spark.range(1000).selectExpr("id as doc_id", "array('hot') as members", "'hot' as entity")
    pairs = entities.paired(long, 100)
    assert pairs.count() == 1000 * 999 // 2 == pairs.select("a", "b").distinct().count() and pairs.where("a >= b").isEmpty()


def test_ideal_gains_in_blocks(spark):
    sizes = spark.createDataFrame([(1,), (7,), (2500,)], "others long")
    want = {(r.others, round(r.ideal, 9)) for r in evaluation.ideal_gains(sizes).collect()}
    assert {(r.others, round(r.ideal, 9)) for r in evaluation.ideal_gains(sizes, 3).collect()} == want
    assert (1, 1.0) in want


def test_negatives_in_more_parts(spark):
    pairs = spark.range(200).selectExpr("id as doc_id", "concat('q', id) as question", "concat('c', id) as context", "'t' as topic")
    found = synthesis.negatives(pairs, parts=2, largest=10).collect()
    assert len(found) == 200 and all(r.other_id != r.doc_id and r.context == f"c{r.other_id}" and r.other_id % 20 == r.doc_id % 20 for r in found)


def test_first_of_each(spark):
    rows = spark.createDataFrame([(3, "a", None), (1, "a", 5), (2, "b", 6), (4, None, 7), (5, None, 8)], "n int, text string, `_row` int")
    assert sorted(map(str, windows.first_of_each(rows, F.col("text"), "n").collect())) == sorted(map(str, rows.where("n in (1, 2, 4)").collect()))


def test_chunks_go_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PIECE", 300)
    docs = spark.createDataFrame([(i, f"One sentence {i}. " * 40) for i in range(30)] + [(90, None), (91, "")], "doc_id long, text string").coalesce(1)
    want = sorted((d, *row) for d, t in docs.collect() if t for row in chunking.placed(chunking.split_recursively(t, chunking.SEPARATORS, 1000, 200)))
    assert sorted(tuple(r) for r in chunking.chunks(docs).collect()) == want


def test_contexts_in_order(spark):
    made = random.Random(4)
    rows = [(made.choice(["a", "b", None]), rank, made.choice([None, "x", "y", "z"])) for rank in [*made.sample(range(-50, 400), 200), 7, 7, 7, None, None]]
    less = lambda v: (v is not None, v)  # noqa: E731 - nulls first
    md5 = lambda lines: hashlib.md5("\n".join(lines).encode()).hexdigest()
    want = []
    for group in ("a", "b", None):
        chunks = sorted(((r, m) for g, r, m in rows if g == group), key=lambda c: (less(c[0]), less(c[1])))
        parts = [md5(m or "" for _, m in part) for _, part in itertools.groupby(chunks, lambda c: c[0] if c[0] is None else c[0] // 10)]
        want += [(group, r, i + 1, len(chunks), m, md5(parts)) for i, (r, m) in enumerate(chunks)]
    table = spark.createDataFrame(rows, "group_id string, rank long, chunk_md5 string").repartition(4)
    assert Counter(map(tuple, windows.contexts(table, part=10).collect())) == Counter(want)
    assert windows.contexts(table.limit(0)).count() == 0


def test_guardrail_context_gives_whole_contexts(spark):
    got = registry.QUERIES["guardrail_context"](spark, "/root/testdata/sf0.001").collect()
    sizes = Counter(r.group_id for r in got)
    assert all(r.n == sizes[r.group_id] for r in got) and len({(r.group_id, r.context_md5) for r in got}) == len(sizes)
    for group, n in sizes.items():
        assert [r.place for r in sorted((r for r in got if r.group_id == group), key=lambda r: r.rank)] == list(range(1, n + 1))
