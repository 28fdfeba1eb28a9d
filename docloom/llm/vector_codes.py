"""Product codes of vectors by Yinyang Lloyd, in integers.

A vector's components become integers and are cut into equal parts; each part position has a codebook that Lloyd rounds
improve. The entries of a codebook are clustered into groups once. Every part keeps an upper bound of the distance to its
entry and, for each group, one lower bound of the distance to the group's other entries. When entries move, the bounds
move by as much; only the groups whose bound no longer clears the upper bound are scanned. Distances that decide are
integers, so ties are ties, and the bounds are rounded to the safe side: the codes are those of plain Lloyd.

The bounds, codes and integers of a round are a written table: a lost executor repeats its own rows of one round alone.
What comes to the driver is codebooks, whose size does not depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, map_batches, materialise

SCALE = 256
MOST = 1 << 24  #: components are smaller than this in magnitude, so that squared distances of a part fit in 64 bits
GROUP_SIZE = 10  #: entries of a group, about
STEPS = 5  #: of clustering entries into groups
SLACK = 1e-9  #: relative, for rounding in sums of bounds and drifts


def finite(vector: Column) -> Column:
    """Whether a vector has components, and all of them are numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def integers(vectors: list[list[float]] | np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of every component."""
    scaled = np.floor(np.asarray(vectors, np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError(f"a component is {MOST // SCALE} or more in magnitude")
    return scaled.astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, d) to entries (k, d), as integers (n, k)."""
    total = np.zeros((len(x), len(entries)), np.int64)
    for p in range(x.shape[1]):
        gap = x[:, p, None] - entries[None, :, p]
        gap *= gap
        total += gap
    return total


def groups_of(codebook: np.ndarray) -> np.ndarray:
    """The group of each entry of a codebook (k, d): a few steps of Lloyd on the entries, begun at evenly spaced ones."""
    n = -(-len(codebook) // GROUP_SIZE)
    means = codebook[np.arange(n) * len(codebook) // n].astype(np.float64)
    group = np.zeros(len(codebook), np.int64)
    for _ in range(STEPS):
        group = ((codebook[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(n):
            if (group == g).any():
                means[g] = codebook[group == g].mean(axis=0)
    return group


def up(x: np.ndarray) -> np.ndarray:
    """Half floats that are no smaller."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float16), np.float16(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Half floats that are no larger."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float16), np.float16(-np.inf))


class Part:
    """One part position's codebook (k, d), its groups, and the bounds of rows against it."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(-(-len(entries) // GROUP_SIZE))]
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64))
        self.drift = moved
        self.group_drift = np.array([moved[m].max() if len(m) else 0.0 for m in self.members])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, upper bound and lower bounds (n, groups) of rows, by a scan of all entries."""
        return self._bounded(squared(x, self.entries))

    def _bounded(self, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(len(distance))
        code = distance.argmin(axis=1)  # the first of the least: ties to the lower index
        nearest = distance[rows, code]
        others = distance.astype(np.float64)
        others[rows, code] = np.inf
        lower = np.stack([others[:, m].min(axis=1, initial=np.inf) for m in self.members], axis=1)
        return code, np.sqrt(nearest.astype(np.float64)), np.sqrt(lower)

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the entries have moved, and how many distances were worked out."""
        code, upper, lower = code.astype(np.int64), upper.astype(np.float64) + self.drift[code], np.maximum(lower.astype(np.float64) - self.group_drift, 0.0)
        # A bound that the upper bound does not clear by more than rounding may hide a nearer or an equal entry.
        hidden = lambda low, high: low <= high * (1 + SLACK) + SLACK
        open_rows = np.flatnonzero(hidden(lower.min(axis=1), upper))
        done = 0
        if len(open_rows):
            old = code[open_rows]
            gap = x[open_rows] - self.entries[old]
            best = (gap * gap).sum(axis=1)
            own = np.sqrt(best.astype(np.float64))
            upper[open_rows] = own
            done += len(open_rows)
            at, low = old.copy(), lower[open_rows]
            failing = hidden(low, own[:, None])
            scanned = []
            for g, m in enumerate(self.members):
                some = np.flatnonzero(failing[:, g])
                if not len(some) or not len(m):
                    continue
                distance = squared(x[open_rows[some]], self.entries[m])
                done += distance.size
                scanned.append((g, m, some, distance))
                near = distance.argmin(axis=1)
                least, index = distance[np.arange(len(some)), near], m[near]
                closer = (least < best[some]) | (least == best[some]) & (index < at[some])
                best[some] = np.where(closer, least, best[some])
                at[some] = np.where(closer, index, at[some])
            # Bounds of the groups scanned, now that the nearest entry is known; the entry left behind bounds its own group.
            for g, m, some, distance in scanned:
                others = np.where(m[None, :] == at[some][:, None], np.inf, distance.astype(np.float64))
                low[some, g] = np.sqrt(others.min(axis=1, initial=np.inf))
            left = at != old
            low[left, self.group[old[left]]] = np.minimum(low[left, self.group[old[left]]], own[left])
            code[open_rows], lower[open_rows], upper[open_rows] = at, low, np.sqrt(best.astype(np.float64))
        return code, upper, lower, done


def _parts(ints: np.ndarray, parts: int) -> np.ndarray:
    return ints.reshape(len(ints), parts, -1)


def _binary(x: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    return pa.array([r.tobytes() for r in x], pa.binary())


def _rows(column: pa.Array, dtype: type) -> np.ndarray:
    """Rows of bytes as an array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _assign(books: list[Part]) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]:
    """State of the first round from vec_id, label, vector."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if not len(batch):
                return None
            ints = integers(np.asarray(batch.column(2).flatten()).reshape(len(batch), -1))
            x = _parts(ints, len(books))
            found = [book.first(x[:, p]) for p, book in enumerate(books)]
            return _state(batch, ints.astype(np.int32), found)

        return step

    return make


def _state(batch: pa.RecordBatch, ints: np.ndarray, found: list) -> pa.RecordBatch:
    codes, upper, lower = (np.stack([f[k] for f in found], axis=1) for k in range(3))
    columns = [batch.column(0), batch.column(1), _binary(ints), _binary(codes.astype(np.uint8)), _binary(up(upper)), _binary(down(lower).reshape(len(ints), -1))]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "ints", "codes", "upper", "lower"])


def _read(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ints, codes, upper, lower = (_rows(batch.column(k), t) for k, t in ((2, np.int32), (3, np.uint8), (4, np.float16), (5, np.float16)))
    return _parts(ints.astype(np.int64), parts), codes, upper, lower.reshape(len(ints), parts, -1)


def _reassign(books: list[Part], last: bool) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]:
    """State of the next round from that of the one before; the code and its error if it is the last."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if not len(batch):
                return None
            x, codes, upper, lower = _read(batch, len(books))
            found = [book.again(x[:, p], codes[:, p], upper[:, p], lower[:, p]) for p, book in enumerate(books)]
            if not last:
                return _state(batch, x.reshape(len(x), -1).astype(np.int32), found)
            code = np.stack([f[0] for f in found], axis=1)
            gaps = x - np.stack([book.entries[code[:, p]] for p, book in enumerate(books)], axis=1)
            error = (gaps * gaps).sum(axis=(1, 2))
            columns = [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in code.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

        return step

    return make


def updated(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks (parts, k, d) with every entry the floor of the mean of its parts; entries without parts stay.

    Each task sends one row for each entry it met, with 64-bit sums, and Spark adds these up: at most parts * k rows come
    to the driver.
    """
    parts, k, d = codebooks.shape

    def sums(batches):
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in batches:
            x, codes = _parts(_rows(batch.column(0), np.int32), parts), _rows(batch.column(1), np.uint8)
            for p in range(parts if len(batch) else 0):
                count[p] += np.bincount(codes[:, p], minlength=k)
                for j in range(d):
                    total[p, :, j] += np.bincount(codes[:, p], weights=x[:, p, j], minlength=k).astype(np.int64)
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    each = state.select("ints", "codes").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(d)))
    new = codebooks.copy()
    for part, entry, n, *total in added.collect():
        new[part, entry] = [t // n for t in total]
    return new


def encode(vectors: DataFrame, *, vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for the rows of `vectors` (vec_id, label, and the `vector` column).

    Rows whose vector is null, empty, or holds a null or non-finite component are left out. All others must have the same
    number of components, a multiple of `parts` (ValueError else, as for components of 65,536 or more in magnitude). A
    codebook begins as the vectors of the `entries` smallest vec_ids, equal ids by their vectors and null ids last; of fewer
    vectors, all. Repeated rows count and are coded each by itself; null labels are one label; other columns are not read;
    an empty table gives an empty result.
    """
    if not 0 < entries <= 256 or rounds < 1:
        raise ValueError("an entry's index is one byte, and there is at least one round")
    spark = vectors.sparkSession
    given = vectors.select("vec_id", "label", F.col(vector).alias("vector")).where(finite(F.col("vector")))
    id_type, label_type = (given.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    final = f"vec_id {id_type}, label {label_type}, code string, error long"
    sizes = given.select(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if sizes[0] is None:
        empty = spark.createDataFrame([], final)
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if sizes[0] != sizes[1] or sizes[0] % parts:
        raise ValueError(f"vectors have {sizes[0]} to {sizes[1]} components; the same multiple of {parts} is needed")
    smallest = given.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    codebooks = np.ascontiguousarray(_parts(integers([r.vector for r in smallest]), parts).swapaxes(0, 1))
    grouped = [groups_of(book) for book in codebooks]
    state_type = f"vec_id {id_type}, label {label_type}, ints binary, codes binary, upper binary, lower binary"
    used: list[str] = []
    before = codebooks
    state = materialise(map_batches(given, _assign([Part(b, g) for b, g in zip(codebooks, grouped, strict=True)]), state_type), "assigned", used)
    for n in range(rounds):
        before, codebooks = codebooks, updated(state, codebooks)
        books = [Part(b, g, old) for b, g, old in zip(codebooks, grouped, before, strict=True)]
        last = n == rounds - 1
        state = materialise(map_batches(state, _reassign(books, last), final if last else state_type), "coded" if last else "assigned", None if last else used)
    discard(spark, used)
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    # Nulls are a label of their own: two columns that are never null stand for the label.
    keyed = state.select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    totals = keyed.groupBy("none", "name").agg(F.sum("error").alias("label_error"))
    return join_spread(keyed, totals, ["none", "name"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
