"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and Python regex class body. `bytes.split()` splits on the same six bytes.
SPACE = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`.

    Where it is unset, a run in one process (tests) gets a folder of its own; a cluster gets an error, since its machines
    share no temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends there, so a lost executor costs no recomputation.

    The path is appended to `used`, so that `discard` can delete the table when all that reads it has been written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, used: list[str]) -> None:
    """Delete tables that `materialise` wrote."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while used:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(used.pop())
        path.getFileSystem(conf).delete(path, True)


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key from a row's content alone. Repeated rows share it, and it is the same however often it is recomputed."""
    return F.xxhash64(doc_id, text)


def second_key(doc_id: Column, text: Column) -> Column:
    """Another such key, so that with `row_key` rows are told apart by 128 bits."""
    return F.xxhash64(F.lit("second"), text, doc_id)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with state made once for each task by `make`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


BITMAP = 1 << 26  #: bits
PAGE = 1 << 15  #: bits of the bitmap that one row carries to the driver


def bitmap_of(keys: DataFrame) -> Broadcast:
    """A bitmap of BITMAP bits, sent to every task, that has the lowest bits of every key in `keys` (key) set.

    Its pages are made in the tasks: 8 MB in at most BITMAP / PAGE rows come to the driver, however many keys there are.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy() & (BITMAP - 1)
            at.sort()
            first = np.flatnonzero(np.diff(at // PAGE, prepend=-1))
            for page, own in zip((at[first] // PAGE).tolist(), np.split(at % PAGE, first[1:]), strict=True):
                np.bitwise_or.at(bits.setdefault(page, np.zeros(PAGE // 8, np.uint8)), own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([x.tobytes() for x in bits.values()], pa.binary())], ["page", "bits"])

    spark = keys.sparkSession
    page = F.shiftright(F.col("key").bitwiseAND(F.lit(BITMAP - 1)), PAGE.bit_length() - 1)
    bitmap = np.zeros((BITMAP // PAGE, PAGE // 8), np.uint8)
    for number, bits in keys.select("key").repartition(page).mapInArrow(pages, "page int, bits binary").collect():
        bitmap[number] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(bitmap.reshape(-1))


def looked_up(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (BITMAP - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def maybe_in(keys: DataFrame) -> Callable[[str], Column]:
    """A test of a column of keys that holds for all in `keys` (key) and, while these are few, for few others."""
    shared = bitmap_of(keys)

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        return pd.Series(looked_up(shared.value, key.to_numpy()))

    return test


ROW = "_row"


def carried(docs: DataFrame) -> DataFrame:
    """`docs` as one struct column, so that no column of the caller's can clash with a work column; `released` undoes it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW))


def released(rows: DataFrame, **changed: Column) -> DataFrame:
    """The caller's columns, with the `changed` ones in their places."""
    fields = rows.schema[ROW].dataType.names
    # Two steps, so that no changed column can take another's new value for the old one of the same name.
    made = rows.select(ROW, *(value.alias(f"{ROW}_{i}") for i, value in enumerate(changed.values())))
    place = {c: F.col(f"{ROW}_{i}") for i, c in enumerate(changed)}
    return made.select(*((place[c] if c in changed else F.col(ROW).getField(c)).alias(c) for c in fields))


HOT = 1000


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined to `table`, which has one row for each key, so that no key's rows gather in one task.

    Keys of more than 1 / HOT of all rows, fewer than HOT of them, are broadcast with their rows of `table`; the rest is
    shuffled. `rows` is read three times: it should be a written table.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("_n") > total / HOT).drop("_n").withColumn("_hot", F.lit(True)))
    told = rows.join(hot, on, "left")
    few = F.broadcast(hot.join(table, on, how))
    return told.where("_hot").drop("_hot").join(few.drop("_hot"), on).unionByName(told.where("_hot is null").drop("_hot").join(table, on, how))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of SplitMix64, on an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The hash of each `width` successive entries; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, width):
        total *= np.uint64(factor)
        total += hashes[j : n + j]
    return mix(total)
