"""The vector index and the exact search in blocks against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import search, vector_index

VECTORS = "vec_id long, embedding array<float>"


def best(table, asked, k):
    """(query, vector) to score of the k nearest, by all pairs."""
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect() if r.embedding is not None]
    every = np.stack([v for _, v in rows])
    out = {}
    for r in asked.collect():
        if r.embedding is not None:
            q = np.array(r.embedding, np.float64)
            score = np.round(every @ q / (np.linalg.norm(every, axis=1) * np.linalg.norm(q) + 1e-10), 6)
            near = sorted((-s, i) for s, (i, _) in zip(score, rows, strict=True) if i != r.vec_id)[:k]
            out |= {(r.vec_id, i): (-s, place + 1) for place, (s, i) in enumerate(near)}
    return out


def as_best(frame):
    rows = frame.collect()
    found = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    """0.9 of the nearest are found; every vector is in a list; at most a fifth of the vectors are scored."""
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    asked = table.where("vec_id % 20 = 0")
    index = vector_index.build(table, vector_index.fit(table))
    found = as_best(vector_index.search(table, asked, index))
    want = best(table, asked, 5)
    assert len(found) == len(want) and len(found.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(want[pair][0] - found[pair][0]) < 1e-5 for pair in found.keys() & want.keys())
    n = table.count()
    assert sorted(i for r in index.packs.collect() for i in r.ids) == sorted(r.vec_id for r in table.collect())
    scored = vector_index.shortlist(index, vector_index.probed(asked, index, 80), 100).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert scored <= 0.2 * n


def clustered(spark, n, seed):
    made = np.random.default_rng(seed)
    middles = made.normal(size=(40, 16))
    rows = middles[made.integers(0, 40, n)] + made.normal(size=(n, 16)) * 0.2
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], VECTORS)


def test_few_lists_do_for_vectors_with_clusters(spark, monkeypatch):
    """Of clustered vectors 4 of 32 lists hold the nearest; packs of a hot list are spread over cells."""
    monkeypatch.setattr(vector_index, "PACK", 16)
    monkeypatch.setattr(vector_index, "ASKED", 8)
    monkeypatch.setattr(vector_index, "CELL", 2)
    table = clustered(spark, 1500, 3).unionByName(spark.createDataFrame([(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 16), (5003, [1.0] * 16)], VECTORS))
    asked = table.where("vec_id % 10 = 0")
    index = vector_index.build(table, vector_index.fit(table, lists=32, parts=8, sample=600))
    found, want = as_best(vector_index.search(table, asked, index, probes=4, most=40)), best(table.where("vec_id <> 5001"), asked, 5)
    assert len(found.keys() & want.keys()) >= 0.95 * len(want)
    assert vector_index.search(table, asked.limit(0), index).count() == 0
    with pytest.raises(ValueError):
        vector_index.fit(table.limit(0))


def test_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PACK", 50)
    monkeypatch.setattr(vector_index, "ASKED", 7)
    table = clustered(spark, 400, 5).unionByName(spark.createDataFrame([(900, None), (901, [1.0] * 16), (902, [1.0] * 16), (903, [2.0] * 16)], VECTORS))
    assert as_best(vector_index.exact(table, table, 4)) == best(table, table, 4)
    one = table.limit(1)
    assert vector_index.exact(one, one).count() == 0 == vector_index.exact(table.limit(0), table).count()


def test_exact_is_top_k(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = table.where("vec_id % 100 = 0")
    a, b = (as_best(f(table, asked, 10)) for f in (vector_index.exact, search.top_k))
    assert a.keys() == b.keys()


def test_top_k_by_a_plain_version(spark):
    """Cells of a few rows, copies, ties, repeated numbers, no vectors and none alike: rows and order as by one window."""
    made = random.Random(2)
    rows = [(i, [float(made.randint(-1, 1)) for _ in range(3)], made.choice([0, 1, None])) for i in range(60)]
    rows += [(1000, None, 0), (1001, [None, 1.0, 2.0], 0), (1002, [1e-9, 1e-9, 0.0], 1), (1003, [0.0, 0.0, 0.0], 1), (1004, [0.5, 0.25, 0.125], 0), (1000, None, 0), (3, [1.0, 0.0, 1.0], 1)]
    table = spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>, label int")
    for same in (None, "label"):
        a, b = (table.select(F.col("vec_id").alias(i), F.col("embedding").alias(e), F.col("label").alias(x)) for i, e, x in (("query_id", "q", "l"), ("vec_id", "v", "m")))
        pairs = a.join(b, F.col("query_id") != F.col("vec_id")).where("true" if same is None else "l = m")
        score = F.round(search.dot(F.col("q"), F.col("v")) / (F.sqrt(search.dot(F.col("q"), F.col("q"))) * F.sqrt(search.dot(F.col("v"), F.col("v"))) + 1e-10), 6)
        ranked = pairs.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
        assert sorted(map(str, search.top_k(table, table, same=same, block=7, given=20).collect())) == sorted(map(str, ranked.where("rank <= 5").collect()))
