"""Byte-level BPE by sentencepiece: the model is serialised here, straight from a rank file.

Every token's bytes are written as printable characters, one for each byte, and become a piece whose score is minus its
rank. Sentencepiece merges the neighbours whose union scores highest, leftmost first, which is the lowest-rank merge of
byte-level BPE. Normalisation is the identity, and no dummy prefix or white-space escape is applied. Piece ids are the
ranks; the unknown piece comes after them. A pre-token that is itself a token gets its rank at once, as rank-file
encoders do. Decoding looks up each id's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain, filterfalse, islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, whole_text


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank. Ranks must be 0, 1, 2, ... without gaps."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"ranks in {path} have gaps")
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (field 1), trainer spec (2) of type BPE, normaliser spec (3) `identity`."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    off = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Sizes(dict):
    """Numbers of tokens of parts; parts that are not known count 0 and are noted down as often as they are asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        return 0


class ByteBpe:
    """Encoder and decoder for one process.

    A space before a non-space always begins a pre-token, so a text without runs of white space is cut there and each
    piece is looked up among those seen before (up to a bound); any other text is split by the pattern as a whole.
    """

    REMEMBERED = 500_000

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.table = dict(enumerate(byte_characters()))
        self.names = list(map(str, range(len(self.tokens))))
        self.by_name = dict(zip(self.names, self.tokens, strict=True))
        self.seen: dict[str, str] = {}
        self.sizes = Sizes()

    def _learn(self, parts: list[str], split: list[list[str]]) -> None:
        """Remember the ids of parts, given their pre-tokens. What is no token itself is merged, all in one call."""
        ranks, names = self.ranks, self.names
        ids: dict[str, str] = {}
        mapped = []
        for word in {w for words in split for w in words}:
            raw = word.encode("utf-8")
            rank = ranks.get(raw)
            if rank is not None:
                ids[word] = names[rank]
            else:
                ids[word] = ""
                mapped.append(self._mapped(word, raw))
        merged = iter(self.model.encode(mapped, num_threads=1) if mapped else ())
        for word, known in ids.items():
            if not known:
                ids[word] = ",".join([names[i] for i in next(merged)])
        self.seen.update((part, ids[words[0]] if len(words) == 1 else ",".join([ids[w] for w in words])) for part, words in zip(parts, split, strict=True))

    def _pre_tokens(self, part: str) -> list[str]:
        """Of a part that follows a space; letters with at most one mark after them need no pattern."""
        if part.isalpha():
            return [" " + part]
        if part[-1] in ",.!?" and part[:-1].isalpha():
            return [" " + part[:-1], part[-1]]
        return self.split(" " + part)

    def joined_all(self, texts: list[str]) -> list[str]:
        """For each text its ids in decimal, joined by commas. What is new in the texts is encoded in one call."""
        seen = self.seen
        if len(seen) > self.REMEMBERED:
            seen.clear()
        cut = [text.split(" ") for text in texts]
        new: set[str] = set()
        for parts in cut:
            new.update(filterfalse(seen.__contains__, parts[1:]))
        parts = [p for p in new if p and not p[0].isspace()]
        self._learn(parts, [self._pre_tokens(p) for p in parts])
        return [self._joined(text, parts) for text, parts in zip(texts, cut, strict=True)]

    def _joined(self, text: str, parts: list[str]) -> str:
        try:
            out = list(map(self.seen.__getitem__, parts[1:]))
            first = self.split(parts[0])
        except KeyError:  # a run of white space
            out, first = [], self.split(text)
        head = []
        for word in first:
            rank = self.ranks.get(raw := word.encode("utf-8"))
            head += [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(self.table))
        return ",".join([*map(str, head), *out])

    def _mapped(self, word: str, raw: bytes) -> str:
        return "\u0120" + word[1:] if word[0] == " " and raw[1:].isalnum() else raw.decode("latin-1").translate(self.table)

    def _count(self, parts: list[str]) -> None:
        """Remember how many tokens parts that follow a space have. What is no token itself is merged, all in one call."""
        ranks, owners, merged = self.ranks, [], []
        sizes = dict.fromkeys(parts, 0)
        for part in parts:
            if part.isalpha():
                words = (" " + part,)
            elif part[-1] in ",.!?" and part[:-1].isalpha():
                sizes[part] = 1
                words = (" " + part[:-1],)
            else:
                words = self.split(" " + part)
            for word in words:
                raw = word.encode("utf-8")
                if raw in ranks:
                    sizes[part] += 1
                else:
                    owners.append(part)
                    merged.append(self._mapped(word, raw))
        for part, pieces in zip(owners, self.model.encode(merged, num_threads=1) if merged else (), strict=True):
            sizes[part] += len(pieces)
        self.sizes.update(sizes)

    def _plain_count(self, text: str) -> int:
        words = [w.encode("utf-8") for w in self.split(text)]
        return sum([1 if raw in self.ranks else len(self.model.encode(raw.decode("latin-1").translate(self.table))) for raw in words])

    def counts(self, texts: list[str]) -> list[int]:
        """How many tokens each text has. What is new in the texts is encoded in one call."""
        sizes = self.sizes
        if len(sizes) > self.REMEMBERED:
            sizes.clear()
        new, out, waiting = sizes.new, [], []
        for i, text in enumerate(texts):
            parts, before = text.split(" "), len(new)
            n = sum(map(sizes.__getitem__, islice(parts, 1, None)))
            out.append(n + self._plain_count(parts[0]))
            if len(new) > before:
                waiting.append((i, before, len(new)))
        parts = set(new)
        runs = {p for p in parts if not p or p[0].isspace()}  # a run of white space in the text
        self._count(list(parts - runs))
        for i, low, high in waiting:
            own = new[low:high]
            if runs and not runs.isdisjoint(own):
                out[i] = self._plain_count(texts[i])
            else:
                out[i] += sum(map(sizes.__getitem__, own))
        new.clear()
        return out

    def joined(self, text: str) -> str:
        return self.joined_all([text])[0]

    def encode(self, text: str) -> list[int]:
        joined = self.joined(text)
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def decode_names(self, names: list[str]) -> bytes:
        """The bytes of ids given in decimal."""
        return b"".join(map(self.by_name.__getitem__, names))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Null text counts as empty: no tokens, hashes of the empty string. Texts of any length are encoded whole. Repeated
    rows and null doc_ids give a row each; other columns are not read. An empty table gives an empty result.
    """

    def make():
        bpe, sha = ByteBpe(path, pattern), hashlib.sha256

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, decoded, kept = [], [], [], []
            texts = batch.column(1).to_pylist()
            for joined in chain.from_iterable(bpe.joined_all(texts[at : at + 256]) for at in range(0, len(texts), 256)):
                names = joined.split(",") if joined else []
                counts.append(len(names))
                hashes.append(sha(joined.encode()).hexdigest())
                decoded.append(sha(bpe.decode_names(names)).hexdigest())
                if with_ids:
                    kept.append([int(i) for i in names])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names_out.append("ids")
            return pa.RecordBatch.from_arrays(columns, names_out)

        return step

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select("doc_id", whole_text().alias("text")), make, schema)


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens for each row of `docs` (doc_id, text); null text has none. Other columns are not read."""

    def make():
        bpe = ByteBpe(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            counts = list(chain.from_iterable(bpe.counts(texts[at : at + 256]) for at in range(0, len(texts), 256)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

        return step

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", whole_text().alias("text")), make, f"doc_id {doc_type}, n_tokens long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The inverse of `encode_documents(..., with_ids=True)`: doc_id and text (bytes that are no UTF-8 become U+FFFD; null ids give '')."""

    def make():
        tokens = read_ranks(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [b"".join([tokens[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    doc_type = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", F.col("ids")), make, f"doc_id {doc_type}, text string")
