"""Approximate search by cosine: inverted lists of product-quantised residuals, then exact scores for a short list.

Vectors of length 1 are dealt to lists by the nearest of as many centroids, and what is left of each, cut into parts, is
coded by the nearest entry of a codebook for each part. A query's likeness to a coded vector is then a sum of looked-up
numbers: its likeness to the centroid, and one entry of a table for each part. The best of these, the short list, are
scored exactly on the vectors themselves.

Codes lie in packs of bounded size, and so do queries: a pack of codes meets a pack of queries of the same list in one row
of a join, and numpy scores that block. Lists with many packs are cut into cells to which their queries are copied, so that
no list is one task's work. What is sent to all tasks is the centroids and codebooks, whose size is set when they are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import kept
from docloom.operators.search import cosine, top_k

PACK = 4096  #: vectors of one pack of codes
ASKED = 256  #: queries of one pack
CELL = 8  #: packs of one list that a task gets, about
ENTRIES = 256  #: of a codebook, so that a code is one byte for each part


def lloyd(rows: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    """At most k means of rows, from k different rows drawn by `seed`; a mean without rows stays."""
    different = np.unique(rows, axis=0)
    means = different[np.random.default_rng(seed).permutation(len(different))[:k]].astype(np.float32)
    for _ in range(steps):
        at = nearest(rows, means)
        counts = np.bincount(at, minlength=len(means))
        sums = np.zeros_like(means, np.float64)
        np.add.at(sums, at, rows)
        met = counts > 0
        means[met] = (sums[met] / counts[met, None]).astype(np.float32)
    return means


def nearest(rows: np.ndarray, means: np.ndarray, block: int = 4096) -> np.ndarray:
    """The number of the mean nearest to each row."""
    half = (means.astype(np.float64) ** 2).sum(axis=1) / 2
    return np.concatenate([(half - rows[i : i + block] @ means.T).argmin(axis=1) for i in range(0, len(rows), block)] or [np.empty(0, np.int64)])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norm > 0, norm, 1)).astype(np.float32)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long arrays as rows."""
    return np.asarray(column.flatten(), np.float32).reshape(len(column), width)


@dataclass
class Index:
    """Centroids (lists, d) and codebooks (parts, entries, d / parts), and the packs of all vectors once they are added."""

    centroids: np.ndarray
    codebooks: np.ndarray
    packs: DataFrame | None = None

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row of length 1, and its codes (n, parts)."""
        own = nearest(rows, self.centroids)
        left = rows - self.centroids[own]
        step = self.width // len(self.codebooks)
        codes = [nearest(left[:, p * step : p * step + step], book) for p, book in enumerate(self.codebooks)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """The likeness of each query's parts to each codebook's entries (n, parts, entries)."""
        cut = queries.reshape(len(queries), len(self.codebooks), -1)
        return np.einsum("qpd,ped->qpe", cut, self.codebooks)


def fit(vectors: DataFrame, *, lists: int = 128, parts: int = 16, sample: int = 20_000, steps: int = 12) -> Index:
    """Centroids and codebooks from at most `sample` of `vectors` (vec_id, embedding): those least by a hash of vec_id.

    Only this sample, a bounded number of rows, comes to the driver. The number of components must be a multiple of `parts`.
    """
    some = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(some):
        raise ValueError("an index needs vectors to be fitted on")
    rows = unit(np.stack(some.to_list()))
    if rows.shape[1] % parts:
        raise ValueError(f"{rows.shape[1]} components are no multiple of {parts}")
    centroids = lloyd(rows, min(lists, len(rows)), steps, 1)
    left = rows - centroids[nearest(rows, centroids)]
    step = rows.shape[1] // parts
    books = []
    for p in range(parts):
        book = lloyd(left[:, p * step : p * step + step], ENTRIES, steps, p)
        books.append(np.concatenate([book, np.repeat(book[:1], ENTRIES - len(book), axis=0)]))
    return Index(centroids, np.stack(books))


def _packed(rows: DataFrame, size: int, id_type: str) -> DataFrame:
    """list, pack, ids, data: rows (list, id, data) of one list put together, at most `size` in a pack.

    Rows are sorted into ranges of (list, id), so a list of any size is spread over the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, data, own = None, [], [], None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([b"".join(data)], pa.binary())], ["list", "ids", "data"])

        for batch in batches:
            kind = batch.column(1).type
            for place, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (place != own or len(ids) >= size):
                    yield out()
                    ids, data = [], []
                own = place
                ids.append(name)
                data.append(value)
        if ids:
            yield out()

    ordered = rows.select("list", "id", "data").repartitionByRange("list", "id").sortWithinPartitions("list", "id")
    packed = ordered.mapInArrow(run, f"list int, ids array<{id_type}>, data binary")
    return packed.select("list", F.xxhash64("list", F.col("ids")[0]).alias("pack"), "ids", "data")


def build(vectors: DataFrame, index: Index) -> Index:
    """The index with the packs of all `vectors` (vec_id, embedding); rows without a vector are in no list."""
    shared = vectors.sparkSession.sparkContext.broadcast((index.centroids, index.codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        for batch in batches:
            if len(batch):
                place, codes = own.encode(unit(matrix(batch.column(1), own.width)))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "data"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    coded = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, f"list int, id {id_type}, data binary")
    return Index(index.centroids, index.codebooks, kept(_packed(coded, PACK, id_type)))


def probed(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """list, pack, ids, data: `queries` (vec_id, embedding), once for each of the `probes` lists most like them, in packs."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        for batch in batches:
            if len(batch):
                rows = unit(matrix(batch.column(1), own.width))
                like = rows @ own.centroids.T
                n = min(probes, like.shape[1])
                best = np.sort(np.argpartition(-like, n - 1, axis=1)[:, :n], axis=1)
                row = np.repeat(np.arange(len(rows)), n)
                yield pa.RecordBatch.from_arrays([pa.array(best.reshape(-1), pa.int32()), batch.column(0).take(pa.array(row)), pa.array([rows[i].tobytes() for i in row], pa.binary())], ["list", "id", "data"])

    id_type = queries.schema["vec_id"].dataType.simpleString()
    spread = queries.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, f"list int, id {id_type}, data binary")
    return _packed(spread, ASKED, id_type)


def shortlist(index: Index, asked: DataFrame, most: int) -> DataFrame:
    """query_id, vec_id, likeness: for each query in `asked` (of `probed`) the `most` vectors that their codes say are most like it."""
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast((index.centroids, index.codebooks))
    cells = index.packs.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))  # one row a list
    codes = index.packs.join(F.broadcast(cells), "list").select("list", F.pmod("pack", "cells").cast("int").alias("cell"), F.col("ids").alias("vec_ids"), F.col("data").alias("codes"))
    copies = asked.join(F.broadcast(cells), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("ids").alias("query_ids"), F.col("data").alias("queries"))
    blocks = codes.join(copies, ["list", "cell"]).select("list", "query_ids", "queries", "vec_ids", "codes")
    query_type, vec_type = (blocks.schema[c].dataType.elementType.simpleString() for c in ("query_ids", "vec_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        parts = len(own.codebooks)
        for batch in batches:
            for i in range(len(batch)):
                place, asking, data, having, coded = (batch.column(c)[i] for c in range(5))
                queries = np.frombuffer(data.as_py(), np.float32).reshape(-1, own.width)
                code = np.frombuffer(coded.as_py(), np.uint8).reshape(-1, parts)
                table = own.tables(queries)
                like = np.repeat((queries @ own.centroids[place.as_py()])[:, None], len(code), axis=1)
                for p in range(parts):
                    like += table[:, p, :][:, code[:, p]]
                n = min(most + 1, len(code))  # one more, as a query may find itself
                best = np.argpartition(-like, n - 1, axis=1)[:, :n].reshape(-1)
                row = np.repeat(np.arange(len(queries)), n)
                columns = [asking.values.take(pa.array(row)), having.values.take(pa.array(best)), pa.array(like[row, best].astype(np.float64), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "likeness"])

    near = blocks.mapInArrow(run, f"query_id {query_type}, vec_id {vec_type}, likeness double").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("likeness").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def search(vectors: DataFrame, queries: DataFrame, index: Index, k: int = 5, *, probes: int = 80, most: int = 100, eps: float = 1e-10) -> DataFrame:
    """query_id, vec_id, score, rank: about the k most similar of `vectors` (vec_id, embedding) for each of `queries`, itself
    left out.

    `index` must be built on `vectors`. `probes` lists are looked through by their codes and `most` vectors are scored exactly.
    Queries without a vector have no rows.
    """
    found = shortlist(index, probed(queries, index, probes), most)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = found.join(vectors.select("vec_id", "embedding"), "vec_id").join(asked, "query_id")
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("query"), F.col("embedding"), eps), 6).alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", best).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 5, *, eps: float = 1e-10, others: bool = True) -> DataFrame:
    """query_id, vec_id, score, rank: the k most similar of `vectors` (vec_id, embedding) for each of `queries`; of `others`
    only, a query does not find the vector of its own number.

    This is `search.top_k` of the rows that have a vector: pairs of cells of bounded size, no side sent to all tasks.
    """
    have = "embedding is not null"
    return top_k(vectors.where(have), queries.where(have), k, eps=eps, others=others)
