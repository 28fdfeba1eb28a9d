"""Lineage, the status of documents, and the vector store, on worked cases and in forms that SQL does not show."""

import datetime as dt
import random

import pytest

from docloom.operators import lineage
from docloom.sources.vector_store import VectorStore
from docloom.streaming import events as streams
from docloom.streaming import status

EDGES = "source string, target string, type string"


def plain_closure(edges):
    """The least number of edges between all pairs, by Floyd and Warshall."""
    nodes = sorted({x for e in edges for x in e[:2]})
    far = {(a, b): 1 for a, b, *_ in edges}
    for m in nodes:
        for a in nodes:
            for b in nodes:
                if (a, m) in far and (m, b) in far and far[a, m] + far[m, b] < far.get((a, b), 10**9):
                    far[a, b] = far[a, m] + far[m, b]
    return far


def test_closure(spark):
    made = random.Random(1)
    for n, m in ((8, 6), (12, 20), (20, 60)):
        edges = [(f"n{made.randrange(n)}", f"n{made.randrange(n)}", made.choice(["made_of", "copy_of"])) for _ in range(m)]
        found = lineage.closure(spark.createDataFrame([*edges, edges[0], ("n1", None, "made_of"), (None, "n2", None)], EDGES))
        assert {(r.source, r.target): r.hops for r in found.paths.collect()} == plain_closure(edges)
        assert all(r.hops == plain_closure(edges)[r.source, r.source] for r in found.cycles().collect())
        own = [e for e in edges if e[2] == "copy_of"]
        some = lineage.closure(spark.createDataFrame(edges, EDGES), types=["copy_of"])
        assert {(r.source, r.target): r.hops for r in some.paths.collect()} == plain_closure(own)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    for n in (16, 64):
        found = lineage.closure(spark.range(n).selectExpr("concat('n', id) as source", "concat('n', id + 1) as target", "'after' as type"))
        assert found.rounds == n.bit_length()  # doublings to n, and one that finds nothing
        assert found.ancestors().count() == n * (n + 1) // 2 and found.cycles().isEmpty()
    assert lineage.closure(spark.createDataFrame([], EDGES)).paths.isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_twigs_are_set_aside(spark, monkeypatch, seed):
    """A forest, alone and with a cycle it grows on and a leaf of two parents: the paths and their counts, and what is written."""
    made = random.Random(seed)
    forest = [(f"l{i}", f"o{made.randrange(12)}") for i in range(60)] + [(f"o{i}", f"c{made.randrange(4)}") for i in range(12)] + [(f"c{i}", "r") for i in range(4)]
    rows, written = [], lineage.folders.written

    def counted(frame, name):
        table = written(frame, name)
        rows.append((name, table.count()))
        return table

    monkeypatch.setattr(lineage.folders, "written", counted)
    for edges in (forest, [*forest, ("r", "s"), ("s", "t"), ("t", "r"), ("t", "u"), ("two", "o1"), ("two", "c2")]):
        want = plain_closure(edges)
        ends = {}
        for (source, target), hops in want.items():
            if source != target:
                n, deepest = ends.get(target, (0, 0))
                ends[target] = (n + 1, max(deepest, hops))
        found = lineage.closure(spark.createDataFrame([(*e, "made_of") for e in edges + edges[:5]], EDGES))
        assert {r.target: (r.n_sources, r.deepest) for r in lineage.summary(found).collect()} == ends
        if edges is forest:
            assert {name for name, _ in rows} == {"edges", "hung"} and sum(n for _, n in rows) < len(want) and len(found.layers) == 3
        got = found.paths.collect()
        assert {(r.source, r.target): r.hops for r in got} == want and len(got) == len(want)
        assert {r.source: r.hops for r in found.cycles().collect()} == {a: n for (a, b), n in want.items() if a == b}


STEP = "step_name"
EVENTS = "document_id string, ts timestamp, event_id long, step_name string"
BEGIN = dt.datetime(2024, 1, 1)


def made_events(seed, documents, events):
    made = random.Random(seed)
    names = [*status.STEPS, "nothing", None]
    weights = [2 if n in ("completed", "failed") else 5 for n in names]
    rows = []
    for i in range(events):
        # One document has a third of all events.
        doc = "hot" if made.random() < 0.34 else f"d{made.randrange(documents)}"
        rows.append((doc, BEGIN + dt.timedelta(minutes=made.randrange(6000), microseconds=made.randrange(3)), i, made.choices(names, weights)[0]))
    return rows


def plain_transitions(rows, timeout, until):
    """One event after the other, document by document."""
    out, order = [], list(status.STEPS)
    for doc in {r[0] for r in rows if r[0] is not None}:
        now, last = None, None
        for _, ts, event_id, step in sorted((r for r in rows if r[0] == doc and r[1] is not None and r[3] in status.STEPS), key=lambda r: (r[1], r[2])):
            is_open = now is not None and now not in ("completed", "failed")
            if last is not None and is_open and ts - last >= timeout:
                out.append((doc, last + timeout, None, now, "failed", "timeout"))
                now, is_open = "failed", False
            if step == "queued":
                good = not is_open
            elif step == "failed":
                good = is_open
            else:
                good = now is None or is_open and order.index(now) < order.index(step)
            if good:
                out.append((doc, ts, event_id, now, step, "event"))
                now = step
            last = ts
        if until is not None and now not in (None, "completed", "failed") and until - last >= timeout:
            out.append((doc, last + timeout, None, now, "failed", "timeout"))
    return sorted(map(str, out))


def as_plain(rows):
    return sorted(str((r.document_id, r.ts, r.event_id, r.step_before, r.step, r.reason)) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_transitions(spark, seed):
    rows = made_events(seed, 30, 3000)
    rows += [rows[0], (None, BEGIN, 1, "queued"), ("d1", None, 2, "queued")]
    until = BEGIN + dt.timedelta(minutes=6500)
    for limit in (None, until):
        got = status.transitions(spark.createDataFrame(rows, EVENTS).repartition(3), STEP, timeout="3 hours", until=limit)
        assert as_plain(got.collect()) == plain_transitions(rows[:3001], dt.timedelta(hours=3), limit)
    assert status.transitions(spark.createDataFrame([], EVENTS), STEP).count() == 0


def test_transitions_of_one_document(spark):
    hour = dt.timedelta(hours=1)
    steps = ["extracting", "queued", "analyzing", "extracting", "indexing", "completed", "failed", "queued", "failed", "queued"]
    rows = [("d", BEGIN + i * hour, i, s) for i, s in enumerate(steps)]
    found = status.transitions(spark.createDataFrame(rows, EVENTS), STEP, until=BEGIN + dt.timedelta(days=9))
    got = [(r.step_before, r.step, r.progress, r.message) for r in found.orderBy("ts").collect()]
    assert got[:4] == [(None, "extracting", 10, "Extracting text"), ("extracting", "analyzing", 40, "Text extracted, analyzing with AI"), ("analyzing", "indexing", 80, "AI analysis complete, indexing for search"), ("indexing", "completed", 100, "Complete")]
    assert got[4:] == [("completed", "queued", 0, "Queued for processing"), ("queued", "failed", None, "Failed"), ("failed", "queued", 0, "Queued for processing"), ("queued", "failed", None, "Timed out")]
    last = status.current(found).first()
    assert (last.status, last.n_transitions, last.updated) == ("failed", 8, BEGIN + 9 * hour + dt.timedelta(days=1))


def test_stream_of_transitions(spark, tmp_path):
    """A stream in three runs from one checkpoint, with rows out of order, gives what the table gives."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(made_events(3, 8, 600), key=lambda r: (r[1], r[2]))
        made, source = random.Random(4), str(tmp_path / "in")
        end = ("end", BEGIN + dt.timedelta(days=30), 10**6, "queued")
        parts = [rows[:250], rows[250:450], [*rows[450:], end]]
        for part in parts:
            mixed = sorted(part, key=lambda r: r[1] + dt.timedelta(minutes=made.randrange(9)))  # late, but within the watermark
            spark.createDataFrame(mixed, EVENTS).coalesce(1).write.mode("append").parquet(source)
            given = spark.readStream.schema(EVENTS).parquet(source)
            found = status.stream_transitions(given, STEP, timeout="3 hours")
            query = streams.write_available(found, str(tmp_path / "out"), str(tmp_path / "state"))
            query.awaitTermination()
        got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.document_id != "end"]
        want = status.transitions(spark.createDataFrame(rows, EVENTS), STEP, timeout="3 hours", until=BEGIN + dt.timedelta(days=29)).collect()
        assert len(got) > 100 and as_plain(got) == as_plain(want)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


CHUNKS = "chunk_id string, version long, document_id string, embedding array<float>, deleted boolean"


def contents(store, commit=None):
    return sorted((r.chunk_id, r.version, r.document_id, r.embedding) for r in store.read(commit).collect())


def test_vector_store(spark, tmp_path):
    made = random.Random(6)
    batches = [[(f"c{made.randrange(40)}", made.randrange(5), f"d{made.randrange(4)}", [float(made.randrange(9))], made.random() < 0.1) for _ in range(25)] for _ in range(4)]
    best = {}
    results = []
    for name, order in (("a", [0, 1, 2, 3]), ("b", [3, 1, 1, 0, 2, 3])):
        store = VectorStore(spark, str(tmp_path / name), buckets=7)
        for i in order:
            store.upsert(spark.createDataFrame(batches[i], CHUNKS))
        results.append(contents(store))
    for row in (r for b in batches for r in b):
        best[row[0]] = max(best.get(row[0], -1), row[1])
    assert results[0] == results[1]
    assert all(version == best[chunk] for chunk, version, *_ in results[0])
    gone = {c for c, v in best.items() if any(r[0] == c and r[1] == v and r[4] for b in batches for r in b)}
    assert {c for c, *_ in results[0]} == set(best) - gone


def test_vector_store_commits(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.upsert(spark.createDataFrame([], CHUNKS)) == 0 and contents(store) == []
    rows = spark.createDataFrame([("a", 1, "d", [1.0]), ("b", 1, "d", [2.0]), ("c", None, "e", [3.0]), (None, 9, "e", [3.0])], CHUNKS.rsplit(",", 1)[0])
    assert store.upsert(rows) == 1
    assert store.upsert(spark.createDataFrame([("b", 2, "d", [5.0])], CHUNKS.rsplit(",", 1)[0])) == 2
    first, second = store.manifest(1)[1], store.manifest(2)[1]
    assert len([b for b in second if second[b] != first.get(b)]) == 1  # one bucket was written anew
    # What a writer that died before its manifest has left is never read.
    spark.createDataFrame([("z", 1, "d", [1.0], False)], CHUNKS).selectExpr("*", "0 as bucket").write.partitionBy("bucket").parquet(str(tmp_path / "s/data/commit=3"))
    assert contents(store) == [("a", 1, "d", [1.0]), ("b", 2, "d", [5.0]), ("c", 0, "e", [3.0])]
    assert contents(store, 1) == [("a", 1, "d", [1.0]), ("b", 1, "d", [2.0]), ("c", 0, "e", [3.0])]
    assert store.delete_document("d", 1) == 3
    assert contents(store) == [("b", 2, "d", [5.0]), ("c", 0, "e", [3.0])]
