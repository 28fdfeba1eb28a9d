"""Chunks of a document, extractive summaries and key phrases. Each text is worked on in its own row: no text is shuffled
unless others have its doc_id and their phrases are counted together."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

Length = Callable[[str], int]
BUCKETS = 65_536  #: of doc_ids, of which some may come again
PIECE = 1_000_000  #: characters of the texts that are worked on together, about: what a task's Python holds

# Separators in the order in which they are tried, stop words, and first words that key phrases may not have.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
STOP_WORDS = set(
    "the a an is are was were be been being have has had do does did will would could should may might must and or but in on at to for of with by from as this that these those it".split()
)
PHRASE_STARTS = {"the", "of", "in", "to", "and", "for"}
WORD = re.compile(r"\b[a-zA-Z]{3,}\b")


def split_recursively(text: str, separators: list[str], size: int, overlap: int, length: Length = len) -> list[str]:
    """Pieces by the first separator that occurs; those too long by `length` are split by the later ones and come first, the
    rest is merged. The overlap is in characters."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    pieces = text.split(separator) if separator else list(text)
    out, small = [], []
    for piece in pieces:
        if small:
            small[-1] += separator
        if length(piece) < size or not finer:
            small.append(piece)
        else:
            out += split_recursively(piece, finer, size, overlap, length)
    buffer = ""
    for piece in small:
        if buffer and length(buffer) + length(piece) > size:
            out.append(buffer)
            buffer = buffer[-overlap:] if overlap else ""
        buffer += piece
    return [*out, buffer] if buffer else out


def split_sentences(text: str, size: int, overlap: int, length: Length = len) -> list[str]:
    """Whole sentences up to `size` by `length`; a longer one is alone. The last sentences that fit in `overlap` are said again."""
    out, held, used = [], [], 0
    for sentence in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", text))):
        if length(sentence) > size:
            out += [" ".join(held)] if held else []
            out.append(sentence)
            held, used = [], 0
            continue
        if held and used + length(sentence) + 1 > size:
            out.append(" ".join(held))
            first, used = len(held), 0
            while first and used + length(held[first - 1]) <= overlap:
                first -= 1
                used += length(held[first])
            held = held[first:]
        held.append(sentence)
        used += length(sentence) + 1
    return [*out, " ".join(held)] if held else out


def placed(pieces: list[str]) -> list[tuple[int, int, int, str]]:
    """(index, start, end, content) of pieces that are not blank; places add up piece lengths, overlaps included."""
    out, at = [], 0
    for piece in pieces:
        if piece.strip():
            out.append((len(out), at, at + len(piece), piece.strip()))
            at += len(piece)
    return out


def chunks(docs: DataFrame, *, size: int = 1000, overlap: int = 200, by_sentence: bool = False) -> DataFrame:
    """doc_id, chunk_index, start_char, end_char, content. Null and blank texts have no chunk."""

    def cut(text: str) -> list[tuple[int, int, int, str]]:
        return placed(split_sentences(text, size, overlap) if by_sentence else split_recursively(text, SEPARATORS, size, overlap)) if text else []

    return _each(docs.select("doc_id", "text"), cut, "chunk_index long, start_char long, end_char long, content string")


def _each(docs: DataFrame, work: Callable[[str | None], list[tuple]], columns: str) -> DataFrame:
    """doc_id and `columns` of the rows that `work` makes of each text of `docs` (doc_id, text).

    Texts are taken out of a batch one by one, and rows go out when they hold about PIECE characters, so that Python's
    memory does not grow with the batch or the table.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def out() -> pa.RecordBatch:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["doc_id", *types.names])

            for i, value in enumerate(batch.column(1)):
                made = work(value.as_py())
                at += [i] * len(made)
                rows += made
                held += sum(len(x) for row in made for x in row if isinstance(x, str))
                if held >= PIECE:
                    yield out()
                    at, rows, held = [], [], 0
            if rows:
                yield out()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def chunk_function(*, size: int = 1000, overlap: int = 200, by_sentence: bool = False, length: Length = len) -> UserDefinedTableFunction:
    """A table function of a text: its chunks, measured by the caller's `length`, row by row as they are taken.

    For `lateralJoin`, or for SQL under the name that `spark.udtf.register` gives it. Null and blank texts have no chunk.
    """

    class Cut:
        def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
            if text:
                pieces = split_sentences(text, size, overlap, length) if by_sentence else split_recursively(text, SEPARATORS, size, overlap, length)
                yield from placed(pieces)

    return F.udtf(Cut, returnType="chunk_index long, start_char long, end_char long, content string")


def chunks_by(docs: DataFrame, length: Length, *, size: int = 1000, overlap: int = 200, by_sentence: bool = False) -> DataFrame:
    """doc_id, chunk_index, start_char, end_char, content of `docs` (doc_id, text), with sizes by the caller's `length`."""
    cut = chunk_function(size=size, overlap=overlap, by_sentence=by_sentence, length=length)
    return docs.select("doc_id", "text").lateralJoin(cut(F.col("text").outer())).select("doc_id", "chunk_index", "start_char", "end_char", "content")


def word_count(text: str) -> int:
    return len(text.split())


def summaries_of(text: str, sizes: Iterable[int], focus: tuple[str, ...] = ()) -> dict[int, str]:
    """For each of `sizes` so many of the best sentences in text order; the text itself where it has no more sentences of over 20
    characters. Sentences are scored once for all sizes."""
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if len(s.strip()) > 20]
    made = dict.fromkeys(sizes, text)
    fewer = [n for n in made if n < len(found)]
    if not fewer:
        return made
    counts = Counter(w for w in WORD.findall(text.lower()) if w not in STOP_WORDS)
    top = max(counts.values(), default=1)

    def score(i: int) -> float:
        lower = found[i].lower()
        words = WORD.findall(lower)
        mean = sum(counts[w] / top for w in words) / len(words) if words else 0.0
        return mean * 1.5 ** sum(f.lower() in lower for f in focus) * (1 + 0.1 * (1 - i / len(found)))

    best = sorted(range(len(found)), key=score, reverse=True)
    return made | {n: " ".join(found[i] for i in sorted(best[:n])) for n in fewer}


def summary_of(text: str, most: int, focus: tuple[str, ...] = ()) -> str:
    """The `most` best sentences in text order; the text itself if it has no more sentences of over 20 characters."""
    return summaries_of(text, [most], focus)[most]


def frequent_pairs(words: list[str], most: int, among: int) -> list[tuple[str, int]]:
    """Pairs of neighbouring words said more than once, of the `among` most frequent pairs, and how often; ties by first place."""
    top = Counter(zip(words, words[1:], strict=False)).most_common(among)
    return [(f"{a} {b}", n) for (a, b), n in top if n > 1 and a not in PHRASE_STARTS][:most]


def phrases_of(text: str, most: int) -> list[str]:
    """Pairs of neighbouring words said more than once, of the 20 most frequent pairs."""
    return [phrase for phrase, _ in frequent_pairs(WORD.findall(text.lower()), most, 20)]


def summaries(docs: DataFrame, *, most: int = 5, focus: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, summary, key_phrases and ratio: characters of the summary over those of the text; null texts count as empty."""

    @F.pandas_udf("summary string, key_phrases array<string>")
    def shorten(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"summary": [summary_of(t, most, focus) for t in text], "key_phrases": [phrases_of(t, 5) for t in text]})

    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("s", shorten("text"))
    ratio = F.when(F.length("text") > 0, F.round(F.length("s.summary") / F.length("text"), 6)).otherwise(F.lit(1.0))
    return made.select("doc_id", "s.summary", "s.key_phrases", ratio.alias("ratio"))


# Sentences of a summary by its length; the last number is the most of any summary where the caller gives no other.
LENGTHS = {"brief": 2, "short": 5, "medium": 10, "long": 20, "comprehensive": 30}
MOST_SENTENCES = 10


def summary_levels(docs: DataFrame, levels: Mapping[str, int] = LENGTHS, *, focus: tuple[str, ...] = (), most: int = MOST_SENTENCES) -> DataFrame:
    """doc_id, level, summary, words, ratio: a summary of each length of each of `docs` (doc_id, text), and its words over those
    of the text. No summary has more than `most` sentences. Null texts count as empty."""
    sizes = {level: min(n, most) for level, n in levels.items()}

    def shorten(text: str) -> list[tuple[str, str, int, float]]:
        made = {n: (s, len(s.split())) for n, s in summaries_of(text, sizes.values(), focus).items()}
        all_words = len(text.split())
        return [(level, *made[n], round(made[n][1] / all_words, 6) if all_words else 0.0) for level, n in sizes.items()]

    return _each(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), shorten, "level string, summary string, words long, ratio double")


def key_phrases(docs: DataFrame, *, most: int = 5, among: int = 20) -> DataFrame:
    """doc_id, rank, phrase, n: pairs of successive words of three ASCII letters or more that a text of `docs` (doc_id, text)
    has twice or more: the first `most` of the `among` most frequent that do not begin with a function word; ties by first place.

    A text is counted in its own row. Only texts whose doc_id may come again are counted together by a shuffle: doc_ids are
    dealt to BUCKETS, and of those with an equal pair the numbers alone go to the tasks.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(bucket.alias("_bucket")).distinct()
    dealt = docs.select("doc_id", "text", bucket.alias("_bucket"))

    def count(words: str | None) -> list[tuple[int, str, int]]:
        return [(i + 1, phrase, n) for i, (phrase, n) in enumerate(frequent_pairs(words.split(), most, among))] if words else []

    alone = dealt.join(F.broadcast(again), "_bucket", "left_anti").select("doc_id", F.array_join(_words(), " ").alias("text"))
    return _each(alone, count, "rank int, phrase string, n long").unionByName(_shared_phrases(dealt.join(F.broadcast(again), "_bucket", "left_semi"), most, among))


def _words() -> Column:
    """The words of `text` of three ASCII letters or more."""
    return F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{3,}$"))


def _shared_phrases(docs: DataFrame, most: int, among: int) -> DataFrame:
    """`key_phrases` where texts share a doc_id: all their pairs are counted together."""
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    each = docs.select("doc_id", _words().alias("w")).where(F.size("w") > 1).select("doc_id", F.posexplode(pairs).alias("i", "phrase")).where("phrase is not null")
    counts = each.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.min("i").alias("first")).where("n > 1")
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first"))).where(F.col("r") <= among)
    telling = ranked.where(~F.split_part("phrase", F.lit(" "), F.lit(1)).isin(*sorted(PHRASE_STARTS)))
    return telling.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("r"))).where(F.col("rank") <= most).select("doc_id", "rank", "phrase", "n")
