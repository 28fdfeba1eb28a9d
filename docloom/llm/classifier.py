"""Supervised subword embeddings for document quality.

A document is the average of learned vectors: one for each word, each character n-gram inside a word, and each pair of
successive words, all hashed into one table. A softmax over the average gives the classes. Training is stochastic
gradient descent in numpy over a bounded sample of labelled rows; scoring runs on every document in Spark. The output
layer is linear, so each table row is reduced to one number before scoring and a text needs only sums of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix, whole_text


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17  #: rows of the vector table
    width: int = 10  #: numbers in a vector
    shortest: int = 3  #: characters in an n-gram, with the word's edges marked
    longest: int = 4
    sample: int = 1200  #: labelled rows of each class that are learnt from, at most
    rounds: int = 4
    rate: float = 0.5
    seed: int = 11


class Vocabulary(dict):
    """Numbers of the words met, with each word's hash and the table rows of the word and its character n-grams."""

    def __init__(self, settings: Settings):
        super().__init__()
        self.settings, self.new = settings, []
        self.hashes = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def learn(self) -> tuple[np.ndarray, np.ndarray]:
        """The table rows of the words met since the last call, one word after the other, and how many each has."""
        s, new = self.settings, self.new
        self.new = []
        own = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in new), np.uint64, len(new))
        self.hashes = np.concatenate([self.hashes, own])
        marked = [f"<{w.decode('utf-8', 'replace')}>" for w in new]
        sizes = np.array([len(m) for m in marked], np.int64)
        letters = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(new)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # letters from here to the word's end
        rows, of_word = [own], [np.arange(len(new))]
        for n in range(s.shortest, s.longest + 1):
            at = np.flatnonzero(left >= n)
            total = np.full(len(at), n, np.uint64)
            for k in range(n):
                total = total * np.uint64(0x100000001B3) + letters[at + k]
            rows.append(mix(total))
            of_word.append(word[at])
        order = np.argsort(np.concatenate(of_word), kind="stable")
        counts = np.bincount(np.concatenate(of_word), minlength=len(new))
        return (np.concatenate(rows) % np.uint64(s.buckets)).astype(np.int64)[order], counts

    def pairs(self, numbers: np.ndarray) -> np.ndarray:
        """Table rows of the pairs of successive words."""
        h = self.hashes[numbers]
        return (mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(self.settings.buckets)).astype(np.int64)


def text_rows(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the table rows that it uses, and how often."""
    known = Vocabulary(settings)
    numbers = [known.numbers(t.encode().split()) for t in texts]
    rows, counts = known.learn()
    ends = np.cumsum(counts)
    of_word = np.split(rows, ends[:-1]) if len(counts) else []
    found = []
    for own in numbers:
        every = [of_word[i] for i in own] + [known.pairs(own)]
        found.append(np.unique(np.concatenate(every), return_counts=True))
    return found


class Scorer:
    """Scores of texts, from one number for each row of the table."""

    REMEMBERED = 400_000
    CHUNK = 50_000  #: words

    def __init__(self, weight: np.ndarray, base: float, prior: float, settings: Settings):
        self.weight, self.base, self.prior, self.settings = weight, base, prior, settings
        self.forget()

    def forget(self) -> None:
        self.known = Vocabulary(self.settings)
        self.sums, self.counts = np.empty(0), np.empty(0, np.int64)

    def of(self, texts: list[str]) -> np.ndarray:
        out, words, sizes = [], [], []
        for text in texts:
            own = text.encode().split()
            words += own
            sizes.append(len(own))
            if len(words) > self.CHUNK:
                out.append(self._of(words, np.array(sizes)))
                words, sizes = [], []
        out.append(self._of(words, np.array(sizes, np.int64)))
        return np.concatenate(out)

    def _of(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        if len(self.known) > self.REMEMBERED:
            self.forget()
        numbers = self.known.numbers(words)
        if self.known.new:
            rows, counts = self.known.learn()
            ends = np.cumsum(counts)
            running = np.concatenate([[0.0], np.cumsum(self.weight[rows])])
            self.sums = np.concatenate([self.sums, running[ends] - running[ends - counts]])
            self.counts = np.concatenate([self.counts, counts])
        text = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(text, self.sums[numbers], len(sizes))
        n = np.bincount(text, self.counts[numbers], len(sizes))
        if len(numbers) > 1:
            inside = text[1:] == text[:-1]
            pairs = self.weight[self.known.pairs(numbers)[inside]]
            total += np.bincount(text[1:][inside], pairs, len(sizes))
            n += np.bincount(text[1:][inside], minlength=len(sizes))
        score = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.base, -60, 60)))
        return np.where(sizes > 0, score, self.prior)


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vector table, the output matrix and its offsets, by gradient descent over one text after another."""
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1 / settings.width, 1 / settings.width, (settings.buckets, settings.width)).astype(np.float32)
    out, offset = np.zeros((settings.width, 2), np.float32), np.zeros(2, np.float32)
    seen = text_rows(texts, settings)
    steps, total = 0, max(1, settings.rounds * len(texts))
    for _ in range(settings.rounds):
        for i in rng.permutation(len(texts)):
            rows, counts = seen[i]
            rate = settings.rate * (1 - steps / total)
            steps += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ table[rows]
            z = mean @ out + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            offset -= rate * p
            # A word's share of the step shrinks with the text, so the step is scaled up to the text's own size.
            table[rows] -= rate * np.minimum(1, share * len(rows))[:, None] * back[None, :]
    return table, out, offset


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, settings: Settings) -> tuple[list[str], list[int], float]:
    """Texts and labels of at most `sample` rows of each class, chosen by a hash of doc_id, and the share of label 1.

    Only rows outside `held_out` with a label 0 or 1 count; a doc_id with several labels takes the least, and one with
    several texts the first in order. So at most 2 * `sample` rows come to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.min("quality").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    chosen = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(settings.seed)), "doc_id").limit(settings.sample) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows of two numbers
    rows = docs.select("doc_id", whole_text().alias("text")).join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r[0])
    return [r[2] for r in rows], [int(r[1]) for r in rows], share if share is not None else 0.5


def score(docs: DataFrame, labels: DataFrame, *, folds: int = 5, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text), learnt from `labels` (doc_id, quality).

    Rows whose crc32(doc_id as text) mod `folds` is 0 are held out of training. Without any usable label, or for a text
    without words, the score is the share of label 1 among the labels (0.5 if there are none). A null doc_id is not held
    out; null labels count for nothing. Repeated rows each give a row; other columns are never read.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    texts, y, share = training_rows(docs, labels, held_out, settings)
    ones = sum(y)
    if 0 < ones < len(y):
        table, out, offset = train(texts, y, settings)
        weight = (table @ (out[:, 1] - out[:, 0])).astype(np.float64)
        # The sample holds the classes in other shares than the labels do.
        base = float(offset[1] - offset[0]) + np.log(share / (1 - share)) - np.log(ones / (len(y) - ones))
    else:
        weight, base = np.zeros(settings.buckets), np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    prior = float(share)
    model = docs.sparkSession.sparkContext.broadcast(weight.astype(np.float32))

    def make():
        scorer = Scorer(model.value.astype(np.float64), base, prior, settings)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = scorer.of(batch.column(2).to_pylist())
            predicted = pa.array((scores >= threshold).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"])

        return step

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", held_out.alias("held_out"), whole_text().alias("text")), make, f"doc_id {doc_type}, held_out boolean, score double, predicted int")
