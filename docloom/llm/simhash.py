"""Near duplicates by SimHash fingerprints and multi-index hashing.

The 64 bits are cut into n segments. Fingerprints that differ in at most four bits differ in at most 4 // n bits of some
segment, so each fingerprint looks up, for every segment, all values of that small Hamming ball in a table of segment
values, and the whole distance of what it finds is verified. Three segments with one bit need few probes; two with two
bits keep the candidates few for very many fingerprints. Different fingerprints are linked, not documents:
copies share a fingerprint and cost nothing. Components come from alternating star contraction of the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, carried, discard, join_spread, map_batches, materialise, maybe_in, released, row_key, second_key, whole_text

BITS = 64


def lower_ascii(raw: bytes) -> bytes:
    """A-Z in lower case; `bytes.lower` changes no other byte."""
    return raw.lower()


def fingerprint(text: str, shingle: int = 4) -> int:
    """The SimHash of a text's word shingles: bit i is 1 if it is set in more than half of their hashes."""
    words = lower_ascii(text.encode()).split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)])
    total, count = np.zeros(BITS, np.int64), len(hashes) // 8
    flat = np.frombuffer(hashes, np.uint8).reshape(count, 8)
    for at in range(0, count, 65_536):
        total += np.unpackbits(flat[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and print (the 64 bits as a signed long) for each row of `docs` (doc_id, text), and any other columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *(batch.column(i) for i in range(2, batch.num_columns))], ["doc_id", "print", *rest])

        return step

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return map_batches(docs.select("doc_id", whole_text().alias("text"), *rest), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long{kinds}")


def segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each of `n` segments."""
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def flips(bits: int, radius: int) -> list[int]:
    """All values of `bits` bits with at most `radius` of them set: the Hamming ball around zero."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def cheapest(prints: int, distance: int) -> int:
    """How many segments need the fewest probes and candidates for so many fingerprints. It changes the cost only.

    Fingerprints that differ in at most `distance` bits differ in at most distance // n bits of one of n segments.
    """

    def cost(n: int) -> float:
        return sum(len(flips(bits, distance // n)) * (1 + prints / 2**bits) for _, bits in segments(n))

    return min([n for n in range(2, distance + 1) if distance // n <= 2] or [distance + 1], key=cost)


def links(prints: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """a, b (a < b): all pairs of different fingerprints in `prints` (print) that differ in at most `distance` bits."""
    n_parts = parts or cheapest(prints.count(), distance)
    cut = segments(n_parts)
    value = lambda a, n: F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << n) - 1))
    key = lambda s, v: F.shiftleft(F.lit(s).cast("long"), 58).bitwiseOR(v)
    table = prints.select(F.col("print").alias("b"), F.explode(F.array(*(key(s, value(a, n)) for s, (a, n) in enumerate(cut)))).alias("key"))
    ball = lambda n: F.array(*(F.lit(x).cast("long") for x in flips(n, distance // n_parts)))

    def around(s: int, a: int, n: int) -> Column:
        return F.transform(ball(n), lambda x: key(s, value(a, n).bitwiseXOR(x)))

    probes = prints.select(F.col("print").alias("a"), F.explode(F.concat(*(around(s, a, n) for s, (a, n) in enumerate(cut)))).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(table, "key").where(near).select("a", "b").distinct()


def components(edges: DataFrame, used: list[str]) -> DataFrame:
    """print, root: the least fingerprint reachable from each one that has an edge (a, b).

    Large-star and small-star rounds, each written to the shared folder, until the edges no longer change. The rows of a
    fingerprint with very many edges are spread over the tasks.
    """
    stars = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "stars", used)
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_spread(stars, least, ["u"]).select(F.col("m").alias("u"), "v").where("u < v").distinct()
        down = materialise(large.select(F.col("v").alias("top"), F.col("u").alias("low")), "stars", used)  # each v with its lower neighbours
        lowest = down.groupBy("top").agg(F.min("low").alias("m"))
        small = join_spread(down, lowest, ["top"]).select(F.explode(F.array(F.struct("m", F.col("low").alias("x")), F.struct("m", F.col("top").alias("x")))).alias("e")).select(F.col("e.m").alias("u"), F.col("e.x").alias("v"))
        stars = materialise(small.where("u < v").distinct(), "stars", used)
        now = state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("v").alias("print"), F.col("u").alias("root"))


def least_by_component(prints: DataFrame, value: Column, distance: int, used: list[str]) -> DataFrame:
    """print, least: for each fingerprint in `prints` (print), the least `value` of all rows that links reach; a written table."""
    each = materialise(prints.groupBy("print").agg(F.min(value).alias("first")), "distinct", used)
    roots = components(links(each.select("print"), distance), used)
    rooted = materialise(each.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root")), "rooted", used)
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return materialise(join_spread(rooted, least, ["root"]).select("print", "least"), "least", used)


def group(docs: DataFrame, *, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The columns of `docs` but text, with print and component_id: the least doc_id that links reach, itself included.

    Null text counts as empty and gets fingerprint zero, which is linked like any other. Null doc_ids are passed over
    for the least; a component of nothing else has component_id null. Repeated rows each give a row. Columns of `docs`
    may not be called print or component_id.
    """
    prints = materialise(with_fingerprints(docs, shingle), "prints")
    named = least_by_component(prints, F.col("doc_id"), distance, [])
    return join_spread(prints, named.withColumnRenamed("least", "component_id"), ["print"])


def near_duplicates(docs: DataFrame, *, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of `docs` (doc_id, text); see `group`."""
    found = group(docs.select("doc_id", "text"), shingle=shingle, distance=distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row, with all columns of `docs`, of each component: the one with the least doc_id, then the least content key.

    Rows are known by two hashes of doc_id and text, so rows of one doc_id, or of none, are told apart; of rows alike in both
    any one stands for all. Null doc_ids come last: such a row stays if its component has no other. Columns of any other
    names keep their values. An empty table gives an empty result.
    """
    used: list[str] = []
    keys = lambda doc_id, text: (row_key(doc_id, text).alias("key"), second_key(doc_id, text).alias("second"))
    prints = materialise(with_fingerprints(docs.select("doc_id", "text", *keys(docs["doc_id"], docs["text"])), shingle), "prints", used)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "second")
    named = least_by_component(prints, order, distance, used).select("print", F.struct("least.key", "least.second").alias("least"))
    mine = F.struct("key", "second")
    found = join_spread(prints, named, ["print"]).groupBy("key", "second").agg(F.count("*").alias("n"), F.bool_or(mine == F.col("least")).alias("stays"))
    # Most rows stay and are alone: only those that a bitmap of the others does not rule out are shuffled.
    others = materialise(found.where("n > 1 or not stays"), "others")
    discard(docs.sparkSession, used)
    marked = carried(docs).select(ROW, *keys(F.col(f"{ROW}.doc_id"), F.col(f"{ROW}.text")))
    marked = marked.withColumn("maybe", maybe_in(others)("key"))
    gone = others.where("not stays").select("key", "second")
    concerned = marked.where("maybe").join(gone.hint("merge"), ["key", "second"], "left_anti").dropDuplicates(["key", "second"])
    return released(marked.where("not maybe").select(ROW).unionByName(concerned.select(ROW)))
