"""How filters of a cleaning run act together, in every order they could be applied in.

Every document becomes a mask of the filters it fails, and documents alike in mask, part and labels become one cell with a
count. A part has at most 2 ** 5 masks times 4 labellings, whatever the table holds, so the walk over the orders sees
cells and never documents. The walk visits all permutations by swaps of two neighbours: a swap changes what its two steps
see and nothing before or after, so these two alone are counted anew. What a filter removes is summed up along the walk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, map_batches, materialise

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
CONTINUING = bytes(range(0x80, 0xC0))  #: bytes of a code point after its first


def text_mask(raw: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, A the lowest bit.

    A: under 100 words; B: under 80 % of the words differ; C: over 10 % of the code points are capitals of ASCII; D: a symbol.
    """
    words = raw.split()
    points = len(raw.translate(None, CONTINUING))
    few = len(words) < 100
    alike = 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 10 * points
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | alike << 1 | capitals << 2 | symbols << 3


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, h1, h2, n: rows of `docs` alike in doc_id, lang and text, by two 64-bit hashes of the text, with
    their number."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            masks, first, second = [], [], []
            for text in batch.column(2).to_pylist():
                raw = text or b""
                digest = xxhash.xxh3_128_digest(raw)
                masks.append(text_mask(raw))
                first.append(int.from_bytes(digest[:8], "big", signed=True))
                second.append(int.from_bytes(digest[8:], "big", signed=True))
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "h1", "h2"])

        return step

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    each = map_batches(given, make, f"doc_id {doc_type}, part string, mask int, h1 long, h2 long")
    return each.groupBy("doc_id", "part", "mask", "h1", "h2").agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail, and how many of them the labels mark.

    Filter E, a copy of a text with a smaller doc_id, is told by a join on text and doc_id with each text's least doc_id, so
    the copies of one text are spread over the tasks.
    """
    used: list[str] = []
    rows = materialise(masked(docs), "masks", used)
    first = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.where("doc_id is not null").join(first, ["h1", "h2", "doc_id"], "left").withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + COPY))
    marked = materialise(known.select("doc_id", "part", "mask", "n"), "masks", used)
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # No copy of any text can have a null doc_id, nor is there a label for it.
    nameless = rows.where("doc_id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    every = join_spread(marked, told, ["doc_id"], "left").select("part", "mask", "n", "good", "toxic").unionByName(nameless)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")))


def swaps(n: int) -> Iterator[int]:
    """Positions i at which to swap i and i + 1, one after the other, so that all orders of n things are visited once."""
    if n < 2:
        return
    down, at_end = range(n - 2, -1, -1), True
    inner = swaps(n - 1)
    while True:
        # The last thing moves through all the others, then two of the others change places beside it.
        yield from down if at_end else reversed(down)
        at_end = not at_end
        place = next(inner, None)
        if place is None:
            return
        yield place + (not at_end)


class Cells:
    """Counts by mask of one part, three to a mask: documents, good ones, toxic ones."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.masks = np.arange(len(counts))

    def step(self, before: int, bit: int) -> tuple[int, int, int, int, int]:
        """kept, removed, redundant, good_lost, toxic_lost of the filter `bit` after the filters `before`."""
        fails, gone = self.masks & bit != 0, self.masks & before != 0
        kept = self.counts[~fails & ~gone, 0].sum()
        removed, good, toxic = self.counts[fails & ~gone].sum(axis=0)
        return int(kept), int(removed), int(self.counts[fails & gone, 0].sum()), int(good), int(toxic)


def walk(counts: np.ndarray) -> Iterator[tuple[str, list[tuple[int, int, int, int, int]]]]:
    """Every order of the filters with its steps, from one order to the next by one swap."""
    found = Cells(counts)
    n = int(math.log2(len(counts)))
    order = list(range(n))
    before = [sum(1 << f for f in order[:i]) for i in range(n)]
    steps = [found.step(before[i], 1 << order[i]) for i in range(n)]
    yield "".join(FILTERS[f] for f in order), steps
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        for k in (i, i + 1):
            steps[k] = found.step(before[k], 1 << order[k])
        yield "".join(FILTERS[f] for f in order), steps


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report(part: str, counts: np.ndarray) -> pd.DataFrame:
    """The rows of one part. `shapley` is what a step's filter removes, summed over all orders, at any step."""
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order, steps in walk(counts):
        for k, (kept, removed, redundant, good, toxic) in enumerate(steps):
            total[order[k]] += removed
            rows.append((part, order, k + 1, kept, removed, redundant, int(counts[1 << FILTERS.index(order[k]), 0]), good, toxic))
    return pd.DataFrame([(*r, total[r[1][r[2] - 1]]) for r in rows], columns=[c.split()[0] for c in REPORT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (lang), order of the five filters and step: what the step keeps, removes and finds removed already.

    `docs` has doc_id, text and lang, `labels` doc_id, quality and toxic; other columns are not read. Null text counts as
    empty and null lang as ''. A null doc_id has no label and no copy. Rows of one doc_id and text are copies of none but
    smaller doc_ids; where a doc_id has several labels, any that says so marks it. Repeated rows count each. A part without
    documents has no rows, and an empty table gives an empty result.
    """

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(FILTERS), 3), np.int64)
        counts[rows["mask"].to_numpy()] = rows[["n", "good", "toxic"]].to_numpy()
        return report(rows["part"].iloc[0], counts)

    return cells(docs, labels).groupBy("part").applyInPandas(of_part, REPORT)
