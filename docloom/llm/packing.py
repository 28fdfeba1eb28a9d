"""Packing documents into training sequences of several permitted lengths by variable-capacity best fit.

Documents longer than the longest length are cut into pieces of it. Rows alike in doc_id and length become one with a
count, so the packing depends on what the rows are and not on where they lie. Pieces are dealt to shards of bounded size
by a hash, at most a thousand alike at a time, so that shards pack independently. Within a shard pieces come by falling length. A piece goes to the open bin that it
leaves least room in; if none has room, a bin of the size that costs least for each token it can expect to hold is
opened: the cost of a size is its length plus a fixed cost for each sequence, and the expected content is the piece plus
as much of the room left as smaller pieces to come could fill. At the end every bin is downsized to the least permitted
length that holds its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (2048, 4096, 8192, 16384)
SHARD = 50_000  #: pieces in a shard, about
ALIKE = 1000  #: rows alike that go to one shard together, at most
COST = 64.0  #: of a sequence, in tokens


def pack(pieces: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: float = COST) -> tuple[list[int], list[int], list[int]]:
    """For pieces by falling length: the bin and the offset of each, and the capacity of each bin after downsizing."""
    lengths = sorted(lengths)
    to_come = [0] * (len(pieces) + 1)  # tokens in the pieces from i on
    for i in range(len(pieces) - 1, -1, -1):
        to_come[i] = to_come[i + 1] + pieces[i]
    falling = [-p for p in pieces]
    bins, offsets, room, used = [], [], [], []
    open_at: dict[int, list[int]] = defaultdict(list)  # bins by the room left
    rooms: list[int] = []  # the different rooms, rising

    def put(b: int) -> None:
        if room[b] > 0:
            if not open_at[room[b]]:
                insort(rooms, room[b])
            open_at[room[b]].append(b)

    for i, size in enumerate(pieces):
        k = bisect_left(rooms, size)
        if k < len(rooms):
            b = open_at[rooms[k]].pop()
            if not open_at[rooms[k]]:
                del rooms[k]
        else:
            def price(c: int) -> float:
                fits = bisect_left(falling, size - c, i + 1)  # the first piece to come that the room left can take
                return (c + cost) / max(1, size + min(c - size, to_come[fits]))

            capacity = min((c for c in lengths if c >= size), key=lambda c: (price(c), c))
            b = len(room)
            room.append(capacity)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        room[b] -= size
        put(b)
    return bins, offsets, [next(c for c in lengths if c >= u) for u in used]


def pack_documents(docs: DataFrame, length: Column, *, lengths: Sequence[int] = LENGTHS, cost: float = COST, shard: int = SHARD, alike: int = ALIKE) -> DataFrame:
    """doc_id, piece, piece_start, piece_length, bin, bin_offset, bin_length: one row for each piece of each row of `docs`.

    `length` is the tokens of a row. Null or negative lengths count as 0: such a row is one empty piece at the end of some
    bin. Repeated rows and null doc_ids are packed each by itself; other columns are not read; an empty table gives an
    empty result. The result is the same in whatever order and parts the rows come: ties in length are broken by a hash of
    doc_id, length and piece, and rows alike in these take the same places among them.
    """
    longest = max(lengths)
    sized = docs.select("doc_id", F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    counted = sized.groupBy("doc_id", "size").agg(F.count("*").alias("copies"))
    last = F.greatest(F.ceil(F.col("size") / longest) - 1, F.lit(0))  # the number of the last piece
    total = counted.agg(F.sum(F.col("copies") * (last + 1))).first()[0] or 0
    shards = max(1, math.ceil(total / shard))
    pieces = counted.select("doc_id", "size", "copies", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    parts = pieces.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {alike}"))))
    dealt = parts.select(
        "doc_id", "piece", (F.col("piece").cast("long") * longest).alias("piece_start"),
        F.least(F.lit(longest), F.col("size") - F.col("piece").cast("long") * longest).alias("piece_length"),
        F.least(F.lit(alike), F.col("copies") - F.col("part") * alike).cast("int").alias("copies"),
        F.xxhash64("doc_id", "size", "piece", "part").alias("salt"),
    ).withColumn("shard", F.pmod("salt", F.lit(shards)).cast("int"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, piece int, piece_start long, piece_length long, bin string, bin_offset long, bin_length long"

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["piece_length", "salt"], ascending=[False, True], kind="stable")
        rows = rows.loc[rows.index.repeat(rows["copies"])]
        bins, offsets, capacity = pack(rows["piece_length"].tolist(), lengths, cost)
        out = rows[["doc_id", "piece", "piece_start", "piece_length"]].copy()
        out["bin"] = [f"{s}-{b}" for s, b in zip(rows["shard"], bins, strict=True)]
        out["bin_offset"], out["bin_length"] = offsets, [capacity[b] for b in bins]
        return out

    return dealt.groupBy("shard").applyInPandas(pack_shard, schema)
