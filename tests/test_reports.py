"""ROUGE-L, judging, replies and indexing on worked cases and against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import agents, evaluation
from docloom.plans import registry


def table_of(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randrange(90)) for _ in "ab")
        assert evaluation.longest_common(a, b) == table_of(a, b)


def test_rouge(spark):
    rows = [(1, "The quick fox", "the fox"), (2, None, "x"), (3, " ", "x"), (4, "a b", "c")]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", evaluation.rouge_l(F.col("a"), F.col("b")).alias("s"))
    assert {r.i: r.s for r in got.collect()} == {1: pytest.approx(0.8), 2: 0.0, 3: 0.0, 4: 0.0}


def test_rouge_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        if r.item_id in texts:
            a, b = r.text.lower().split(), texts[r.item_id].lower().split()
            want[r.item_id] = round(2 * table_of(a, b) / (len(a) + len(b)), 6) if a and b else 0.0
    got = {r.item_id: r.rouge_l for r in registry.QUERIES["eval_rouge_l"](spark, sf).collect()}
    assert want and got == pytest.approx(want, abs=2e-6)
    judged = registry.QUERIES["eval_judge"](spark, sf).first()
    assert judged.accuracy == pytest.approx(sum(0.5 if not texts[i] else v for i, v in want.items()) / len(want), abs=1e-5) and judged.coherence == 0.8


def test_replies(spark):
    rows = spark.createDataFrame([('{"k": 1}',), ("no json " * 50,), (None,)], "t string")
    got = rows.select(*agents.parsed_reply(F.col("t"), ["k"])).collect()
    assert [r.parsed for r in got] == [True, False, False]
    assert got[0].k == "1" and len(got[1].fallback) == 200 and got[2].fallback is None


def test_index(spark):
    sf = "/root/testdata/sf0.001"
    got, pieces = registry.QUERIES["index_documents"](spark, sf), registry.QUERIES["chunk_recursive"](spark, sf)
    assert got.count() == got.select("chunk_id").distinct().count() == pieces.count() > 0
    assert got.where(F.size("embedding") != 16).isEmpty()
