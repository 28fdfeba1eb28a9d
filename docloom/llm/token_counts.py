"""Token counts of texts, from the number of pieces of each distinct pre-token.

A tokenizer never merges over the edges of its pre-tokens, so a text has as many tokens as its pre-tokens have pieces. The
first pass counts each pre-token over all texts; the model then cuts every distinct one once. The second pass counts the
pre-tokens of each document and joins them to that dictionary: the most frequent, bounded in number, are sent to the tasks,
and the rest, none of which is frequent, is joined by a shuffle. No ids are made.

Texts are cut into pre-tokens by the tokenizer's own normaliser and pre-tokenizer. Both treat what stands between ASCII
white space by itself, so words are counted first and each different one is cut once.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import mul

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters
from .common import discard, materialise

FREQUENT = 200_000  #: pre-tokens that are sent to the tasks, at most
LONG = 64  #: characters beyond which a pre-token is known by its hash
SPECIAL = "\0"  #: the pre-token that stands for a special token; ASCII white space apart, none begins with it (see `cut`)


class PreTokens:
    """Cuts words into the pre-tokens of a tokenizer file, and pre-tokens into pieces.

    Most words are letters of Latin-1 with at most one mark after them. Of a tokenizer that puts these in lower case and
    parts the mark from the letters, no more need be asked; whether it does is found out with every letter and mark.
    """

    MARKS = ",.!?;:"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            added = [t["content"] for t in json.load(file)["added_tokens"]]
        tokenizer = Tokenizer.from_file(path)
        self.normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.pre_tokenise = tokenizer.pre_tokenizer.pre_tokenize_str
        self.tokenise = tokenizer.model.tokenize
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.characters = dict(enumerate(byte_characters()))
        letters = [c for c in map(chr, range(0x100)) if c.isalpha()]
        probes = [w for c in letters for w in (c, f"a{c}", f"{c}a", f"Z{c}{c}e")] + [f"aB{m}" for m in self.MARKS] + ["".join(letters)]
        self.plainly = all(self._simple(w) == self._asked(w) for w in probes)

    def cut(self, word: bytes) -> tuple[str, ...]:
        """The pre-tokens of a word (UTF-8); SPECIAL for a special token.

        The pre-tokenizer writes bytes as printable characters, so no pre-token holds a control character.
        """
        if self.plainly and word.isalpha():  # of ASCII letters, as bytes have it
            return (word.lower().decode("ascii"),)
        text = word.decode("utf-8", "replace")
        return self.plainly and self._simple(text) or self._asked(text)

    def _simple(self, word: str) -> tuple[str, ...] | None:
        body, mark = (word[:-1], (word[-1],)) if word[-1] in self.MARKS else (word, ())
        if not body.isalpha() or max(body) > "\xff":
            return None
        low = body.lower()
        return (low if low.isascii() else low.encode().decode("latin-1").translate(self.characters), *mark)

    def _asked(self, text: str) -> tuple[str, ...]:
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [*self._plain(text[at : m.start()]), SPECIAL]
            at = m.end()
        return tuple(parts + self._plain(text[at:]))

    def _plain(self, text: str) -> list[str]:
        return [piece for piece, _ in self.pre_tokenise(self.normalise(text))] if text else []

    def of(self, words: Counter[bytes]) -> Counter[str]:
        """How often each pre-token is in words."""
        found: Counter[str] = Counter()
        for word, n in words.items():
            for p in self.cut(word):
                found[p] += n
        return found

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token == SPECIAL else len(self.tokenise(pre_token))


def key_of(pre_token: str) -> str:
    """A pre-token's name in joins: itself, or its 128-bit hash if it is long."""
    return pre_token if len(pre_token) <= LONG else f"{SPECIAL}{xxhash.xxh3_128_hexdigest(pre_token.encode())}"


def frequencies(texts: DataFrame, path: str, most: int = 200_000) -> DataFrame:
    """pre_token, n: how often each pre-token is in all of `texts` (text, binary). A task adds up the words it met before it
    cuts them, about `most` different ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = PreTokens(path), Counter()

        def out() -> pa.RecordBatch:
            total = own.of(words)
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pre_token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update((text or b"").split())
                if len(words) >= most:
                    yield out()
        if words:
            yield out()

    return texts.mapInArrow(run, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))


def dictionary(counted: DataFrame, path: str) -> DataFrame:
    """key, n, pieces of each pre-token of `counted` (pre_token, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, names), pa.string()), batch.column(1), pa.array(map(own.pieces, names), pa.int64())], ["key", "n", "pieces"])

    return counted.mapInArrow(run, "key string, n long, pieces long")


def _least_frequent(known: DataFrame, most: int) -> int:
    """How often a pre-token must be met to be sent to the tasks, so that at most `most` are.

    Pre-tokens are counted by their frequency on a scale of eight steps to the doubling: a few hundred numbers come to the
    driver. Of those left out none is met more often than about one in `most` of all.
    """
    step = F.floor(F.log2("n") * 8)
    steps = known.groupBy(step.alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("size")).collect()
    least, sent = 1 + max((r.least for r in steps), default=0) * 2, 0
    for r in sorted(steps, key=lambda r: -r.step):
        sent += r["size"]
        if sent > most:
            break
        least = r.least
    return least


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > `limit`) for each row of `docs` (doc_id, text).

    `path` is a tokenizer file of the `tokenizers` library whose normaliser and pre-tokenizer do not look beyond ASCII white
    space, and which drops it or marks word ends. Special tokens inside texts count one, as that library has it by default;
    none is added. Null and empty texts have no tokens. Texts of any length are counted whole, bytes that are no UTF-8 as
    U+FFFD. Repeated rows and null doc_ids give a row each; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    used: list[str] = []
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    known = materialise(dictionary(frequencies(texts.select("text"), path), path), "pieces", used)
    least = _least_frequent(known, frequent)
    shared = spark.sparkContext.broadcast({r.key: r.pieces for r in known.where(F.col("n") >= least).select("key", "pieces").toLocalIterator()})
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    summed = materialise(_summed(texts, path, lambda: shared.value, doc_type).withColumn("row", F.monotonically_increasing_id()), "counted", used)
    # Rows were numbered as they were written: the numbers stay as they are.
    rest = summed.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.n")
    found = rest.join(known.where(F.col("n") < least).select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("sure") + F.coalesce("more", F.lit(0))
    counts = materialise(summed.drop("rare").join(found, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens")), "tokens")
    discard(spark, used)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


class Sizes(dict):
    """Pieces of words (UTF-8) all of whose pre-tokens are frequent. Others count 0 and are noted down."""

    REMEMBERED = 400_000

    def __init__(self, path: str, known: dict[str, int]):
        super().__init__()
        self.own, self.known, self.new = PreTokens(path), known, []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        return 0

    def of(self, text: bytes) -> tuple[int, Counter[str]]:
        """The pieces of a text's frequent pre-tokens, and how often it has each of the others."""
        words, rare = Counter(text.split()), Counter()
        total = sum(map(mul, map(self.__getitem__, words), words.values()))
        if len(self) > self.REMEMBERED:
            self.clear()
        for word in self.new:
            n, pieces, sure = words[word], 0, True
            for p in self.own.cut(word):
                key = key_of(p)
                size = self.known.get(key)
                if size is None:
                    rare[key] += n
                    sure = False
                else:
                    pieces += size
            total += n * pieces
            if sure:
                self[word] = pieces
        self.new.clear()
        return total, rare


def _summed(texts: DataFrame, path: str, frequent: Callable[[], dict[str, int]], doc_type: str) -> DataFrame:
    """doc_id, n_bytes, sure, rare: the pieces of each text's frequent pre-tokens, and how often it has each of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sizes(path, frequent())
        for batch in batches:
            texts = [text or b"" for text in batch.column(1).to_pylist()]
            found = [own.of(text) for text in texts]
            rare = [[{"key": key, "n": n} for key, n in others.items()] for _, others in found]
            columns = [pa.array(map(len, texts), pa.int64()), pa.array([total for total, _ in found], pa.int64()), pa.array(rare, pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "sure", "rare"])

    return texts.mapInArrow(run, f"doc_id {doc_type}, n_bytes long, sure long, rare array<struct<key:string,n:long>>")
