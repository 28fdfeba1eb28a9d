"""Homomorphic multiset hash of a document's paragraphs.

Every paragraph (line) is hashed to a wide vector of 32-bit numbers, and a document is the sum of its paragraphs'
vectors modulo 2 ** 32. The order of paragraphs is of no matter; adding or subtracting a paragraph's vector inserts or
deletes it. The first numbers are uniform (collision resistance); the others sum small signed steps hashed from the
paragraph's word triples, so that the inner product of two fingerprints estimates how much text they share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, map_batches, mix, whole_text

UNIFORM, SKETCH = 16, 224  #: numbers of each kind in a fingerprint
SHINGLE = 3


class Fingerprinter:
    """Fingerprints of texts, as arrays of UNIFORM + SKETCH 32-bit numbers."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def of(self, text: str) -> np.ndarray:
        """The sum over paragraphs; zeros for a text without any."""
        paragraphs = [p for p in text.encode().split(b"\n") if p]
        if not paragraphs:
            return np.zeros(UNIFORM + SKETCH, np.uint32)
        digests = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=4 * UNIFORM).digest() for p in paragraphs]), np.uint32)
        uniform = digests.reshape(-1, UNIFORM).sum(0, dtype=np.uint64).astype(np.uint32)
        words = [p.split() for p in paragraphs]
        sizes = np.array([len(w) for w in words])
        h = self.hashes.of([w for ws in words for w in ws])
        line = np.repeat(np.arange(len(words)), sizes)
        triples = np.empty(0, np.uint64)
        if len(h) >= SHINGLE:
            triples = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:])[line[:-2] == line[2:]]
        short = [xxhash.xxh64_intdigest(b" ".join(w)) for w in words if 0 < len(w) < SHINGLE]
        all_of = np.concatenate([triples, np.array(short, np.uint64)]) if short else triples
        sign = np.where(all_of >> np.uint64(63), 1.0, -1.0)
        sketch = np.bincount((all_of % np.uint64(SKETCH)).astype(np.int64), weights=sign, minlength=SKETCH)
        return np.concatenate([uniform, sketch.astype(np.int64).astype(np.uint32)])


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def insert(fingerprint: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """The fingerprint with a paragraph's (or another document's) added."""
    return fingerprint + paragraph


def delete(fingerprint: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    return fingerprint - paragraph


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints; else the estimated shared text over the larger text, from 0 to 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[UNIFORM:].astype(np.int32).astype(np.float64) for v in (a, b))
    most = max(x @ x, y @ y)
    return float(min(1.0, max(0.0, x @ y / most))) if most else 0.0


SAMPLE = 40_000  #: rows whose ids are looked at to cut the order into ranges, about
SPLIT = 16  #: parts, by a hash of the text, of the rows of one bound (or of no doc_id)


def _bucket(doc_id: Column, bounds: list, order: Column) -> Column:
    """The place of a row's range: rising with doc_id, null first, and for ids that are bounds with `order`.

    Ids between two bounds are one range. An id so frequent that its rows would fill a range by themselves is a bound.
    """

    # A binary search in one constant array, by steps that halve: how many bounds are no greater than the id.
    known = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(known, n + step - 1) <= doc_id, n + step).otherwise(n)) if bounds else F.lit(0)
    # Twice the bounds below the id, and one more if it is a bound.
    own = 2 * found - F.when(F.get(known, found - 1) == doc_id, 1).otherwise(0) if bounds else found
    place = F.when(doc_id.isNull(), F.lit(-1)).otherwise(own)
    part = F.when(place % 2 != 0, (F.shiftright(order, 60) + 8).cast("int")).otherwise(F.lit(0))
    return place * SPLIT + part


def _bounds(ids: DataFrame, buckets: int) -> list:
    """Some quantiles of doc_id, of any type that has an order, from a random sample of about SAMPLE rows. They say which rows
    go through a task together and nothing of the result."""
    n = ids.count()
    some = ids if n <= SAMPLE else ids.sample(SAMPLE / n, seed=1)
    drawn = sorted(r[0] for r in some.where("doc_id is not null").collect())
    return sorted({drawn[(k + 1) * len(drawn) // buckets] for k in range(buckets - 1)}) if drawn else []


def fingerprints(docs: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """For each row of `docs` (doc_id, text) its fingerprint, and how like it are its edited text and the next document.

    Documents are taken by descending doc_id; equal ids by a hash of the text, descending, then by text; null ids last.
    The next after the last is the first. The edited text has the last floor(n / 2) code points replaced by the first as
    many of the next text (all of a shorter one). A single row is its own next. Null text counts as empty. Other columns
    are not read; an empty table gives an empty result.

    The order is cut into some `buckets` ranges at approximate quantiles of doc_id. Each range gets a copy of the row that
    comes after it, is sorted by Spark, and passes once through a task, two texts at a time.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", whole_text().alias("text"))
    given = given.withColumn("order", F.xxhash64("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs.select("doc_id"), buckets)
    rows = given.withColumn("bucket", _bucket(F.col("doc_id"), bounds, F.col("order")))
    # The row that comes first in each range, by its id and hash: at most SPLIT + 1 for each bound come to the driver.
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "order")).alias("head")).collect()
    heads.sort(key=lambda r: -r.bucket)
    ahead = [(r.bucket, heads[k - 1].bucket, r.head.doc_id, r.head.order) for k, r in enumerate(heads)]
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(ahead, f"bucket int, before int, head_id {doc_type}, head_order long"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("order") == F.col("head_order"))
    rows = rows.join(table, "bucket").withColumn("ahead", F.when(is_head, F.col("before")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"))
    copy = F.struct(F.col("ahead").alias("bucket"), F.lit(1).alias("ahead"))
    placed = rows.select("doc_id", "text", "order", F.explode(F.when(F.col("ahead").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("p"))
    placed = placed.select("doc_id", "text", F.col("p.bucket").alias("bucket"), F.col("p.ahead").alias("ahead"), "order")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), F.col("order").desc(), F.col("text").desc()).drop("order")
    schema = f"doc_id {doc_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def make():
        of = Fingerprinter().of
        pending: list = []  # the row whose next has not come yet: bucket, doc_id, text, fingerprint

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, at, ahead in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ahead and not pending:
                    continue  # a second row with the id that comes next
                own = of(text)
                if pending and pending[0] == at:
                    _, before_id, before_text, before_print = pending
                    half = len(before_text) // 2
                    edited = before_text[: len(before_text) - half] + text[:half]
                    other = of(edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((before_id, len(before_text), sha, written(before_print), written(other), likeness(before_print, other), likeness(before_print, own)))
                pending[:] = [] if ahead else [at, doc_id, text, own]
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        return step

    return map_batches(sorted_rows, make, schema)
