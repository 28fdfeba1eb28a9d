"""Exact vector search and links between documents."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import kept


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(eps))


def _rounded(values: np.ndarray) -> np.ndarray:
    """Values rounded to six places as Spark's `round` does it: half up, by their shortest decimals."""
    scaled = np.abs(values) * 1e6
    whole = np.floor(scaled + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):  # too near to a half for binary numbers
        whole[i] = float(Decimal(repr(abs(float(values[i])))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.copysign(whole, values) + 0.0


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The dot product of each row of x and of y, added up in order as `dot` does, so that every bit is the same."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def _candidates(x: np.ndarray, y: np.ndarray, n: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) that hold the n most like rows of y for each row of x, rounding and ties included.

    Likenesses in single precision say which pairs can be among them. The n-th greatest of the maxima of groups of rows is
    not above the n-th greatest likeness, so only the maxima are ordered.
    """
    with np.errstate(all="ignore"):
        nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        usual = all(np.isfinite(m).all() and ((m == 0) | (m >= 1e-2)).all() for m in (nx, ny)) and eps <= 1e-8
        if usual:
            u, v = ((m / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32) for m, norm in ((x, nx), (y, ny)))
            like = u @ v.T
        else:  # very short or endless vectors: the terms as they stand, and what is no number is greatest
            like = x @ y.T / (nx[:, None] * ny + eps)
            like[np.isnan(like)] = np.inf
    if len(y) <= n:
        return tuple(np.indices(like.shape).reshape(2, -1))
    groups = min(len(y), max(4 * n, len(y) // 64))
    width = len(y) // groups
    top = like[:, : groups * width].reshape(len(x), groups, width).max(axis=2)
    least = np.partition(top, groups - n, axis=1)[:, groups - n]
    return np.nonzero(like >= (least - (4e-6 + 1e-6 * x.shape[1]))[:, None])


def _best(x: np.ndarray, y: np.ndarray, n: int, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, score) in parts: for each row of x the n rows of y with the greatest scores, lesser rows first."""
    with np.errstate(all="ignore"):
        nx, ny = np.sqrt(_summed(x, x)), np.sqrt(_summed(y, y))
    step = max(1, 16_000_000 // max(1, len(y)))
    for at in range(0, len(x), step):
        row, col = _candidates(x[at : at + step], y, n, eps)
        row, score = row + at, np.empty(len(row))
        for i in range(0, len(row), 200_000):
            r, c = row[i : i + 200_000], col[i : i + 200_000]
            with np.errstate(all="ignore"):
                score[i : i + 200_000] = _rounded(_summed(x[r], y[c]) / (nx[r] * ny[c] + eps))
        order = np.lexsort((col, -np.where(np.isnan(score), np.inf, score), row))
        row, col, score = row[order], col[order], score[order]
        begun = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, int)
        place = np.arange(len(row)) - np.repeat(begun, np.diff(np.r_[begun, len(row)]))
        yield row[place < n], col[place < n], score[place < n]


def _rows(table: pa.Table) -> tuple[pa.Table, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The rows in rising order of their ids, and for each length of vectors (0: none, or nulls within) the places of their ids and the vectors."""
    table = table.sort_by("id").combine_chunks()
    vectors = table.column("embedding").combine_chunks()
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    if vectors.flatten().null_count:
        length = np.array([0 if v is None or None in v else len(v) for v in vectors.to_pylist()])
    found = []
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        flat = vectors.take(pa.array(at)).flatten()
        found.append((int(d), at, flat.to_numpy(zero_copy_only=False).reshape(len(at), d) if d else np.empty((len(at), 0))))
    return table, found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, same: str | None = None, block: int = 8192, eps: float = 1e-10, others: bool = True, given: int = 32_768) -> DataFrame:
    """query_id, vec_id, score, rank: the k most similar of `vectors` (vec_id, embedding) for each of `queries`, of `others`
    only: a query does not find the vector of its own number; with `same`, only those alike in that column. Rows without a
    score (no vector, nulls in it, unequal lengths) come last.

    Queries and vectors are dealt to cells of about `block` and `given` rows; each pair of cells is a group of its own, which
    numpy scores and of which n = k + 1 rows a query go on. So tasks are bounded, no side is sent to all tasks, and the work is
    queries times vectors. Of equal vectors only the n least ids can be found, and equal queries are asked once.
    """
    alike = (F.lit(0) if same is None else F.col(same)).alias("alike")
    rows = lambda frame: frame.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), alike).where("alike is not null")
    # A query leaves out all rows of its own number: one, unless numbers repeat.
    n = k + (vectors.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0 if others else 0)
    group = Window.partitionBy("alike", "embedding")
    having = kept(rows(vectors).withColumn("r", F.row_number().over(group.orderBy("id"))).where(F.col("r") <= n).drop("r"))
    asking = kept(rows(queries).withColumn("key", F.min("id").over(group)).withColumn("mark", F.xxhash64("alike", "embedding")))
    classes = asking.where("id = key").dropDuplicates(["alike", "embedding"])
    cells = lambda frame, size, name: frame.groupBy("alike").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    dealt = cells(classes, block, "across").join(cells(having, given, "down"), "alike")
    own = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = classes.join(dealt, "alike").select("alike", own("across").alias("i"), every("down").alias("j"), "id", "mark", "embedding")
    right = having.join(dealt, "alike").select("alike", every("across").alias("i"), own("down").alias("j"), "id", "embedding")

    def score(asked: pa.Table, met: pa.Table) -> pa.Table:
        parts = []
        if len(asked) and len(met):
            asked, mine = _rows(asked)
            met, theirs = _rows(met)
            for d, at, x in mine:
                fits = [(to, y) for length, to, y in theirs if d and length == d]
                for to, y in fits:
                    parts += [(at[r], to[c], s, None) for r, c, s in _best(x, y, n, eps)]
                # Only where fewer than n have a score others can be among the first.
                rest = np.setdiff1d(np.arange(len(met)), *(to for to, _ in fits))[:n] if fits else np.arange(len(met))[:n]
                if not fits or len(fits[0][0]) < n:
                    parts.append((np.repeat(at, len(rest)), np.tile(rest, len(at)), np.zeros(len(at) * len(rest)), np.ones(len(at) * len(rest), bool)))
        join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind)
        none = np.concatenate([np.zeros(len(p[0]), bool) if p[3] is None else p[3] for p in parts]) if parts else np.empty(0, bool)
        told = asked.take(pa.array(join(0, np.int64)))
        found = [told.column("id"), told.column("mark"), met.column("id").take(pa.array(join(1, np.int64))), pa.array(join(2, np.float64), mask=none)]
        return pa.Table.from_arrays(found, ["key", "mark", "vec_id", "score"])

    kinds = [frame.schema["vec_id"].dataType.simpleString() for frame in (queries, vectors)]
    near = left.groupBy("alike", "i", "j").cogroup(right.groupBy("alike", "i", "j")).applyInArrow(score, f"key {kinds[0]}, mark long, vec_id {kinds[1]}, score double")
    # The first n of each class of queries, then the first k of each query.
    order = (F.col("score").desc(), "vec_id")
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("key", "mark").orderBy(*order))).where(F.col("rank") <= n).drop("rank")
    pairs = asking.select(F.col("id").alias("query_id"), "key", "mark").join(first, ["key", "mark"]).drop("key", "mark")
    pairs = pairs.where("query_id <> vec_id") if others else pairs
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def leakage(held_out: DataFrame, train: DataFrame) -> DataFrame:
    """item_id, side, doc_id: rows of `held_out` (item_id, question, context) whose lower-cased, trimmed question or context
    is that of a row of `train` (doc_id, question, context), and the last such, for each side by itself."""
    digest = lambda c: F.md5(F.lower(F.trim(c)))
    sides = F.array(*(F.struct(F.lit(c).alias("side"), digest(c).alias("h")) for c in ("question", "context")))
    build = train.select("doc_id", F.explode(sides).alias("s")).where("s.h is not null").groupBy("s.side", "s.h").agg(F.max("doc_id").alias("doc_id"))
    return held_out.select("item_id", F.explode(sides).alias("s")).select("item_id", "s.side", "s.h").join(build, ["side", "h"]).select("item_id", "side", "doc_id")


def leakage_score(hits: DataFrame, held_out: DataFrame) -> DataFrame:
    """n_hits, score, severe: hits of either side over the rows held out, at most 1, and whether that is over 0.3."""
    total = held_out.agg(F.count("*").alias("n"))
    counted = hits.agg(F.count("*").alias("n_hits")).crossJoin(total)  # one row by one row
    score = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("n_hits") / F.col("n"))).otherwise(F.lit(0.0))
    return counted.select("n_hits", F.round(score, 6).alias("score"), (score > 0.3).alias("severe"))


