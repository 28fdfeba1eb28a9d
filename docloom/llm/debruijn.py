"""Repeated passages, by compaction of a de Bruijn graph of a corpus's word windows, and their removal.

The graph's edges are the windows of 35 words: two that follow one another share 34. Windows are not handled one by one.

1. Successive windows of a document with the same anchor, the leftmost least hash of the 11-word k-mers in a window, make
   a piece. Anchors depend on the words of a window alone, so equal windows have equal anchors wherever they stand, and
   what repeats in full pieces is known from their hashes (128 bits): a dozen windows at a time.
2. Repeated pieces are compacted into nonbranching paths: a piece and the next belong together if every document that
   goes on from the one goes on to the other, and every document that comes to the other comes from the one. Joins find
   these links; each path gets the coordinates of a source, the document where its pieces occur first, and the runs of
   several sources that continue each other are joined by pointer doubling.
3. A document on a path can enter it only at its head or with the document's own first piece, and leave it only at its
   tail or with the document's last. So these two corners, not the pieces between them, are joined with the paths, and
   the source coordinates verify the span: both corners must lie on one diagonal of document and path. All windows of a
   span are repeated.
4. At the edges of a repeated passage pieces reach into what differs. Where an anchor has different pieces, one of each is
   taken back to its text and its windows are compared by their hashes (128 bits).

What the spans and these windows cover is removed.

Bitmaps of fixed size, sent to every task, keep anchors met once and documents without repeats out of the shuffles. Where
there is so much that they fill up, more is shuffled and the result is the same.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WordHashes, bitmap_of, carried, discard, join_spread, looked_up, map_batches, materialise, maybe_in, mix, released, row_key, whole_text

K = 11  #: words in a k-mer
CHUNK = 60_000  #: words that are hashed together, or one longer text
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@functools.cache
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd factor and of its inverse, modulo 2 ** 64."""
    powers = []
    for f in (factor, pow(factor, -1, 1 << 64)):
        steps = np.full(size, f, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps))
    return powers[0], powers[1]


class Ranges:
    """Hashes of any ranges of a row of words, from running sums."""

    def __init__(self, hashes: np.ndarray, factor: int):
        size = 1 << max(16, len(hashes).bit_length())
        power, self.inverse = _powers(factor, size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)])])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.inverse[low])


def _words(text: str) -> list[bytes]:
    return text.encode().split()


def _chunks(texts: list[str]) -> Iterator[tuple[range, list[bytes], np.ndarray]]:
    """Successive texts together: which they are, their words, and how many each has."""
    first, words, sizes = 0, [], []
    for i, text in enumerate(texts):
        own = _words(text)
        if words and len(words) + len(own) > CHUNK:
            yield range(first, i), words, np.array(sizes)
            first, words, sizes = i, [], []
        words += own
        sizes.append(len(own))
    if sizes:
        yield range(first, len(texts)), words, np.array(sizes)


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each `span` successive k-mers the place of the leftmost least one."""
    at, done = np.arange(len(grams)), 1
    while done < span:
        step = min(done, span - done)
        left, right = at[:-step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        done += step
    return at


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


PARTS = ("anchor", "piece", "checked", "width")


def pieces(docs: DataFrame, window: int) -> DataFrame:
    """key, parts: for each row of `docs` (key, text) with a window its pieces in order, the first from the first word on.

    A part is its anchor's k-mer, two hashes of its words, and how many windows it has. Its words reach `window` - 1 words
    into the next part.
    """
    span = window - K + 1

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, found, counts = batch.column(1).to_pylist(), [], np.zeros(batch.num_rows, np.int64)
            for own, words, sizes in _chunks(texts):
                if len(words) < window:
                    continue
                h = hashes.of(words)
                one, two = Ranges(h, FACTORS[0]), Ranges(mix(h + np.uint64(1)), FACTORS[1])
                places = np.arange(len(h) - K + 2)
                grams = one.of(places[:-1], places[:-1] + K)
                at = anchors(grams, span)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                whole = text_of[: len(at)] == text_of[window - 1 :]
                cut = np.ones(len(at), bool)
                cut[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (text_of[1 : len(at)] != text_of[: len(at) - 1])
                low = np.flatnonzero(cut)
                width = np.diff(np.append(low, len(at)))
                low, width = low[whole[low]], width[whole[low]]
                high = low + width + window - 1
                found.append((grams[at[low]], one.of(low, high), two.of(low, high), width))
                counts[own.start : own.stop] = np.bincount(text_of[low], minlength=len(sizes))
            some = np.flatnonzero(counts)
            columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64) for i in range(4)]
            values = [*(pa.array(c.view(np.int64)) for c in columns[:3]), pa.array(columns[3].astype(np.int32))]
            offsets = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, PARTS))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), parts], ["key", "parts"])

        return step

    return map_batches(docs, make, "key long, parts array<struct<anchor:long,piece:long,checked:long,width:int>>")


PLACED = "anchor long, piece long, checked long, width int, key long, start int, before long, after long"


def placed(parts: DataFrame, column: str, some: Broadcast, corners: bool = False) -> DataFrame:
    """A row for each part whose `column` the bitmap `some` may hold (and, for `corners`, for each first and last part):
    the part, its document and first word, and the pieces before and after it in the document (null at its ends)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            own = {name: flat.field(name).to_numpy() for name in PARTS}
            sizes, n = np.diff(offsets), len(flat)
            first, last = np.zeros(n, bool), np.zeros(n, bool)
            first[offsets[:-1]], last[offsets[1:] - 1] = True, True
            upto = np.cumsum(own["width"]) - own["width"]
            start = upto - np.repeat(upto[offsets[:-1]], sizes)
            at = np.flatnonzero(looked_up(some.value, own[column]) | (corners & (first | last)))
            beside = [pa.array(np.roll(own["piece"], by)[at], mask=end[at]) for by, end in ((1, first), (-1, last))]
            keys = np.repeat(batch.column(0).to_numpy(), sizes)[at]
            columns = [*(pa.array(own[name][at]) for name in PARTS), pa.array(keys), pa.array(start[at].astype(np.int32)), *beside]
            return pa.RecordBatch.from_arrays(columns, [*PARTS, "key", "start", "before", "after"])

        return step

    return map_batches(parts, make, PLACED)


def distinct_pieces(parts: DataFrame) -> DataFrame:
    """anchor, piece, checked, width, n, source (key, start), before, after: the different pieces with anchors met twice or more.

    `before` is the one piece that comes before it wherever any does, null if there are none or several; so is `after`.
    """
    anchor = parts.select(F.explode("parts.anchor").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    rows = placed(parts, "anchor", bitmap_of(anchor.where("n > 1")))
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    source = F.min(F.struct("key", "start")).alias("source")
    return rows.groupBy("anchor", "piece", "checked", "width").agg(F.count("*").alias("n"), source, only("before"), only("after"))


def compact(distinct: DataFrame, used: list[str]) -> DataFrame:
    """piece, checked, path (key, start), offset, corner: the repeated pieces on their nonbranching paths.

    A path is called by the source coordinates of its first piece; `corner` marks its first and last.
    """
    again = distinct.where("n > 1").select("piece", "checked", "width", "source", "before", "after")
    behind = again.select(F.col("piece").alias("before"), F.col("after").alias("its_after"), F.col("source").alias("its_source"), F.col("width").alias("its_width"))
    ahead = again.select(F.col("piece").alias("after"), F.col("before").alias("its_before"))
    # A link needs each to be the only neighbour of the other; a piece that follows itself is no path.
    tied = again.join(behind.where("before <> its_after"), (again["before"] == behind["before"]) & (again["piece"] == behind["its_after"]), "left").drop(behind["before"])
    tied = tied.join(ahead.where("after <> its_before"), (tied["after"] == ahead["after"]) & (tied["piece"] == ahead["its_before"]), "left").drop(ahead["after"])
    follows = F.col("its_source").isNotNull()
    within = follows & (F.col("its_source.key") == F.col("source.key")) & (F.col("its_source.start") + F.col("its_width") == F.col("source.start"))
    in_source = Window.partitionBy("source.key").orderBy("source.start")
    head = F.last(F.when(~F.coalesce(within, F.lit(False)), F.col("source.start")), ignorenulls=True).over(in_source)
    runs = tied.select(
        "piece", "checked", "width", "source", "its_source", follows.alias("follows"), F.col("its_before").isNotNull().alias("goes_on"),
        F.struct(F.col("source.key").alias("key"), head.alias("start")).alias("run"),
    )
    runs = materialise(runs, "runs", used)
    # The first piece of a run that follows the last of another continues its path.
    firsts = runs.where("follows and source.start = run.start").select("run", "its_source")
    lasts = runs.select(F.col("source").alias("its_source"), F.col("run").alias("head"), (F.col("source.start") - F.col("run.start") + F.col("width")).cast("long").alias("offset"))
    glue = materialise(firsts.join(lasts, "its_source").select("run", "head", "offset"), "glue", used)
    on = runs.join(doubled(glue, used), "run", "left")
    cut = F.col("on_cycle")  # the runs of a circle of paths stay apart
    along = F.col("source.start") - F.col("run.start")
    return on.select(
        "piece", "checked", F.coalesce("head", "run").alias("path"), (along + F.coalesce("offset", F.lit(0))).cast("long").alias("offset"),
        (~F.col("follows") | ~F.col("goes_on") | F.coalesce(cut, F.lit(False))).alias("corner"),
    )


def doubled(glue: DataFrame, used: list[str]) -> DataFrame:
    """run, head, offset, on_cycle: the first run of the path that each run of `glue` (run, head, offset) continues, by
    pointer doubling; each run of a circle is its own.

    A pointer that has reached a first run leaves the rounds. After as many rounds as a path through all runs could need,
    what still moves goes round a circle.
    """
    moving, done, reach = glue, [], 1
    n = glue.count()
    while n and reach <= 2 * n:
        ahead = moving.select(F.col("run").alias("head"), F.col("head").alias("further"), F.col("offset").alias("more"))
        for d in done:
            ahead = ahead.unionByName(d.select(F.col("run").alias("head"), F.col("head").alias("further"), F.col("offset").alias("more")))
        stepped = moving.join(ahead, "head", "left").select("run", F.coalesce("further", "head").alias("head"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("further").isNotNull().alias("moved"))
        stepped = materialise(stepped, "glue", used)
        done.append(stepped.where("not moved").drop("moved"))
        moving = stepped.where("moved").drop("moved")
        if moving.isEmpty():
            break
        reach *= 2
    ends = [d.withColumn("on_cycle", F.lit(False)) for d in done]
    circles = moving.select("run", F.col("run").alias("head"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("on_cycle"))
    return functools.reduce(DataFrame.unionByName, ends, circles)


def spans(parts: DataFrame, paths: DataFrame, window: int, used: list[str]) -> DataFrame:
    """key, low, high: the word ranges of documents that lie on a path."""
    at = placed(parts, "piece", bitmap_of(paths.where("corner").select(F.col("piece").alias("key"))), corners=True)
    at = materialise(at.select("piece", "checked", "key", "start", "width"), "corners", used)
    on = join_spread(at, paths.drop("corner"), ["piece", "checked"])
    sides = on.groupBy("key", "path", (F.col("start") - F.col("offset")).alias("diagonal"))
    return sides.agg(F.min("start").alias("low"), (F.max(F.col("start") + F.col("width")) + (window - 1)).alias("high")).select("key", "low", "high")


def edges(distinct: DataFrame) -> DataFrame:
    """key, ranges: one place (start, width, single) of each piece whose anchor has different pieces, by document.

    `single` marks pieces that occur once: windows of others are in spans already.
    """
    several = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    asked = join_spread(distinct, several, ["anchor"])
    return asked.groupBy(F.col("source.key").alias("key")).agg(F.collect_list(F.struct("source.start", "width", (F.col("n") == 1).alias("single"))).alias("ranges"))


def windows(docs: DataFrame, window: int) -> DataFrame:
    """one, two, state, key, start: a row for every window of `docs` (key, text, ranges) in its ranges.

    Windows that are alike within a batch are known to repeat: one of them stands for all (state 1) and the others (2) go
    wherever their number sends them, so that a window of very many documents makes few rows of one group. State 0 is a
    window met once so far. Windows of pieces that are not single have a null start.
    """

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
            keys, ranges = batch.column(0).to_numpy(), batch.column(2)
            bounds, flat = ranges.offsets.to_numpy() - ranges.offsets[0].as_py(), ranges.flatten()
            starts, widths, single = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for own, words, sizes in _chunks(batch.column(1).to_pylist()):
                h = hashes.of(words)
                one, two = Ranges(h, FACTORS[0]), Ranges(mix(h + np.uint64(1)), FACTORS[1])
                asked = slice(bounds[own.start], bounds[own.stop])
                many = np.diff(bounds[own.start : own.stop + 1])
                begin = np.repeat(np.cumsum(sizes) - sizes, many)
                width = widths[asked]
                within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                start = np.repeat(starts[asked], width) + within
                at = np.repeat(begin, width) + start
                key = np.repeat(np.repeat(keys[own.start : own.stop], many), width)
                found.append((one.of(at, at + window), two.of(at, at + window), key, start, np.repeat(single[asked], width)))
            first, second, key, start, alone = (np.concatenate(c) for c in zip(*found, strict=True))
            both = np.empty(len(first), [("one", np.uint64), ("two", np.uint64)])
            both["one"], both["two"] = first, second
            _, lead, back, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
            state = (n > 1)[back].astype(np.int8)
            other = np.ones(len(first), bool)
            other[lead] = False
            # A leader that is not single is known to repeat, but what is told of its group stays with it.
            state[other] = 2
            first[other] = mix(first[other] ^ mix(key[other].view(np.uint64) * np.uint64(31) + start[other].astype(np.uint64)))
            keep = ~other | alone
            columns = [pa.array(first[keep].view(np.int64)), pa.array(second[keep].view(np.int64)), pa.array(state[keep]), pa.array(key[keep])]
            return pa.RecordBatch.from_arrays([*columns, pa.array(start[keep].astype(np.int32), mask=~alone[keep])], ["one", "two", "state", "key", "start"])

        return step

    return map_batches(docs, make, "one long, two long, state byte, key long, start int")


def _runs(ranges: DataFrame) -> DataFrame:
    """key, runs: the union of the ranges (low, high) of a document, as low, high, low, high, ..."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs = []
            for own in batch.column(1):
                low, high = (own.values.field(i).to_numpy() for i in range(2))
                order = np.argsort(low, kind="stable")
                low, most = low[order], np.maximum.accumulate(high[order])
                cut = np.flatnonzero(low[1:] > most[:-1]) + 1
                runs.append(np.stack([low[np.append(0, cut)], most[np.append(cut - 1, len(low) - 1)]], 1).ravel())
            return pa.RecordBatch.from_arrays([batch.column(0), _lists(runs, pa.int32())], ["key", "runs"])

        return step

    return map_batches(ranges, make, "key long, runs array<int>")


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """key, runs: what the windows of `docs` (key, text) whose word sequence starts twice or more cover, by document."""
    used: list[str] = []
    parts = materialise(pieces(docs, window), "parts", used)
    distinct = materialise(distinct_pieces(parts), "pieces", used)
    paths = materialise(compact(distinct, used), "paths", used)
    on_path = spans(parts, paths, window, used)
    ranges = materialise(edges(distinct), "edges", used)
    concerned = docs.where(maybe_in(ranges)("key"))
    # Joins with texts are by a shuffle at every size, so that they need the same share of disk at every size.
    found = windows(concerned.join(ranges.hint("merge"), "key").select("key", "text", "ranges"), window)
    n = F.sum(F.when(F.col("state") < 2, 1).otherwise(0)).over(Window.partitionBy("one", "two"))
    often = found.withColumn("n", n).where("start is not null and (n > 1 or state > 0)").select("key", F.col("start").alias("low"), (F.col("start") + window).alias("high"))
    both = on_path.unionByName(often).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    runs = materialise(_runs(both), "repeats")
    discard(docs.sparkSession, used)
    return runs


def mark_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows of `docs` as one struct, with `text` (null as empty) and `runs`: the covered word ranges, null if there are none.

    Rows are known by a hash of doc_id and text. Rows alike in both share it: each of them counts as an occurrence, so
    whatever windows they have are repeated, and all get the same ranges.
    """
    text = whole_text(f"{ROW}.text")
    keyed = carried(docs).withColumn("key", row_key(F.col(f"{ROW}.doc_id"), text))
    runs = repeated_runs(keyed.select("key", text.alias("text")), window)
    keyed = keyed.withColumn("maybe", maybe_in(runs)("key"))
    clear = keyed.where(~F.col("maybe")).withColumn("runs", F.lit(None).cast("array<int>"))
    joined = keyed.where("maybe").join(runs.hint("merge"), "key", "left")
    return clear.unionByName(joined).select(ROW, text.alias("text"), "runs")


def _kept(words: list[bytes], runs: list[int] | None) -> list[bytes]:
    if runs is None or not len(runs):
        return words
    kept, at = [], 0
    for low, high in zip(runs[::2], runs[1::2], strict=True):
        kept += words[at:low]
        at = high
    return kept + words[at:]


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of `docs` (doc_id, text).

    Null and empty texts have no words; a text of fewer than `window` words loses none. Repeated rows count as
    occurrences of each other. Other columns are not read; an empty table gives an empty result.
    """
    marked = mark_repeats(docs.select("doc_id", "text"), window).select(f"{ROW}.doc_id", "text", "runs")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, gone, hashes = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _words(text)
                kept = _kept(words, runs)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

        return step

    return map_batches(marked, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows and columns of `docs`, with repeated passages taken out of `text`.

    A text that loses words becomes its kept words joined by one space, and may become empty; others are unchanged, null
    too. `n_chars`, if there is such a column, is counted anew for texts that lost words. Columns of any other names keep
    their values. An empty table gives an empty result.
    """
    marked = mark_repeats(docs, window)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return texts.combine(runs, lambda text, own: b" ".join(_kept(_words(text), own)).decode())

    lost = F.col("runs").isNotNull()
    shorter = marked.withColumn("kept", F.when(lost, cut("text", "runs")))
    columns = {"text": F.when(lost, F.col("kept")).otherwise(F.col(f"{ROW}.text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(lost, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"{ROW}.n_chars"))
    return released(shorter, **columns)
