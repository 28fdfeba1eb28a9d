"""Personal data, plain and disguised, with spans in the source text.

Disguises are undone by transducers that keep, for every character they write, the span of source characters it came
from: homoglyphs become the ASCII character they imitate, spelled digits become digits, and "at" and "dot" in brackets
or between spaces in an address become their signs. The identifiers are then found in the normalised text, and each
match maps back to the source span from its first to its last character.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, whole_text

KINDS = ["email", "ip", "card", "phone"]

# Fixed patterns of the base kinds. An address is found by its sign and extended to the left, which is the leftmost match.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole or not at all, so that a long one is looked at once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like the ASCII letters below them, in the same order.
LOOKALIKES = "АВЕКМНОРСТХаеорсхуіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ٠١٢٣٤٥٦٧٨٩"
IMITATED = "ABEKMHOPCTXaeopcxyijsdqwABEZHIKMNOPTYXovp0123456789"
# Spelled digits.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
ONE_SPELLED = re.compile(rf"(?<![^\W_]){_WORD}(?![^\W_])", re.I)
#: Spelled and plain digits in a row.
RUN = re.compile(rf"(?<![^\W_])(?:{_WORD}(?![^\W_])|[0-9]+)(?:[\x20,.-]{{1,2}}(?:{_WORD}(?![^\W_])|[0-9]+))*", re.I)
DIGIT_TOKEN = re.compile(rf"({_WORD})(?![^\W_])|[0-9]+", re.I)
PLUS = re.compile(r"(?<![^\W_])plus\x20+(?=[0-9])", re.I)
BRACKETED = re.compile(r"\x20?[\[({<]\x20?(?:(at|arroba|arobase)|(dot|punkt|point|punto)|(@)|(\.))\x20?[\])}>]\x20?", re.I)
SPACED_DOT = re.compile(r"(?<=[A-Za-z0-9_%+-])\x20(?:dot|punkt|point|punto)\x20(?=[A-Za-z0-9])", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])\x20(?:(at)|arroba|arobase)\x20(?=[A-Za-z0-9-])", re.I)
#: An address with its signs written between underscores.
UNDERSCORED = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z0-9.+-]+)_at_([A-Za-z0-9-]+(?:_dot_[A-Za-z0-9-]+)+)(?![A-Za-z0-9_])", re.I)
#: The ideographic full stop inside a name in ASCII.
IDEOGRAPHIC_DOT = re.compile(r"(?<=[A-Za-z0-9])[\u3002\uff61](?=[a-z0-9])")
SOFT_HYPHEN = "\u00ad"
#: What stands before the name of a mailbox where an address is given: a word for mail or for writing, and small words.
CUE = re.compile(
    r"(?<![^\W_])(?:e-?mails?|mails?|mailto|contact|write|reach|address|forward|courriel|adresse|contactez|[ée]crire|[ée]crivez|kontakt|schreib\w*|schick\w*|correo|escrib\w*|contacto)"
    r"(?:\x20?[:=]\x20?|\x20(?:(?:to|is|a|à|zu|an|es|est|ist|unter|the|al|von|de)\x20){0,2})\Z",
    re.I,
)
# Fixed list of words that are no mailbox's name even there: "write me at example.com".
NO_NAME = frozenset("me us him her them you it all one more here now out moi nous lui leur mir uns ihm ihr ihnen nos le les este ellos".split())
#: A host that ends in letters.
HOST = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds by kind, then start; matches that fail a check are dropped and not retried."""
    out, done = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL_CHARACTERS:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


class Mapped:
    """A text under change, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace text[start:end] by each edit's characters, every one of which stands for all that is replaced."""
        pieces, first, last, at = [], [], [], 0
        for start, end, new in edits:
            pieces += [self.text[at:start], new]
            first += self.first[at:start] + [self.first[start]] * len(new)
            last += self.last[at:start] + [self.last[end - 1]] * len(new)
            at = end
        self.text = "".join([*pieces, self.text[at:]])
        self.first, self.last = first + self.first[at:], last + self.last[at:]


_LOOKS = dict(zip(LOOKALIKES, IMITATED, strict=True))


@functools.cache
def plain(character: str) -> str:
    """The ASCII characters that a character imitates; itself if it imitates none."""
    if character in _LOOKS:
        return _LOOKS[character]
    if character == SOFT_HYPHEN:
        return ""
    if character < "ɐ":
        return character
    if unicodedata.category(character) == "Cf":
        return ""
    folded = unicodedata.normalize("NFKC", character)
    return folded if folded.isascii() and len(folded) == 1 else character


def imitates(character: str) -> bool:
    return (character >= "ɐ" or character == SOFT_HYPHEN) and plain(character) != character


def folded(text: str) -> str:
    """The text in lower case, as `re.I` sees it."""
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


def disguised(text: str) -> bool:
    """Whether any step of `normalise` has something to undo in the text as it is; if none has, none ever will."""
    if not text.isascii() and (any(map(imitates, set(text))) or IDEOGRAPHIC_DOT.search(text)):
        return True
    low = folded(text)
    return (
        (" dot " in low or " punkt " in low or " point " in low or " punto " in low) and SPACED_DOT.search(text) is not None
        or ("plus " in low and PLUS.search(text) is not None)
        or ((" at " in low or " arroba " in low or " arobase " in low) and bool(_at_edits(text)))
        or ("_at_" in low and UNDERSCORED.search(text) is not None)
        or BRACKETED.search(text) is not None
        or (any(w in low for w in DIGITS) and ONE_SPELLED.search(text) is not None)
    )


def _digit_edits(text: str, fuse: bool) -> tuple[list[tuple[int, int, str]], bool]:
    """Edits that write spelled digits as digits, and whether any two stay apart that `fuse` would join.

    Digits spelled one after the other are joined in runs that hold three after another digit, or everywhere by `fuse`.
    Other separators in a run become one space if they are none that a number may have.
    """
    edits, apart = [], False
    for run in RUN.finditer(text):
        tokens = list(DIGIT_TOKEN.finditer(text, *run.span()))
        spelled = [t[1] is not None for t in tokens]
        if not any(spelled):
            continue
        join = fuse or any(all(spelled[k : k + 3]) for k in range(1, len(tokens) - 2))
        for k, t in enumerate(tokens):
            if spelled[k]:
                edits.append((*t.span(), DIGITS[folded(t[0])]))
            if k + 1 < len(tokens) and (spelled[k] or spelled[k + 1]):
                start, end = t.end(), tokens[k + 1].start()
                between = text[start:end]
                if "." in between:
                    continue
                both = spelled[k] and spelled[k + 1]
                if both and join:
                    edits.append((start, end, ""))
                    continue
                apart |= both
                if between not in (" ", "-"):
                    edits.append((start, end, " "))
    return edits, apart


def _underscore_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that write "_at_" and "_dot_" in an address as their signs."""
    edits = []
    for m in UNDERSCORED.finditer(text):
        edits.append((m.end(1), m.start(2), "@"))
        edits += [(*d.span(), ".") for d in re.compile("_dot_", re.I).finditer(text, *m.span(2))]
    return edits


def _is_mailbox(text: str, start: int, end: int, after: int) -> bool:
    """Whether text[start:end], before an "at" whose host ends at `after`, is the name of a mailbox, by what it looks like and
    what stands around it."""
    name = text[start:end].strip(".")
    if not any(c.isalpha() for c in name):
        return False
    # Words have no digits, underscores or plus signs, and no dots between parts of which one is longer than a letter or two.
    if any(c in "0123456789_%+" for c in name) or "." in name and max(map(len, name.split("."))) > 2:
        return True
    if name.lower() in NO_NAME:
        return False
    if CUE.search(text, max(0, start - 60), start):
        return True
    return text[max(0, start - 1) : start] == "<" and text[after : after + 1] == ">"


def _at_edits(text: str, undone: Callable[[int], bool] = lambda i: False) -> list[tuple[int, int, str]]:
    """Edits that write a spaced "at" before a host as its sign.

    Prose says "we met at example.com" too, so an "at" needs evidence: a dot of the host that was disguised in any way, which
    `undone` says of a place; or a name that no word looks like, one that a word for mail or writing leads to, or an address
    in angle brackets, where the host is no "www." site. Other languages' words for the sign
    are never prose before a host.
    """
    edits = []
    for s in SPACED_AT.finditer(text):
        host = HOST.match(text, s.end())
        if host is None:
            continue
        if s[1]:
            start = s.start()
            while start and text[start - 1] in LOCAL_CHARACTERS:
                start -= 1
            dots = (i for i in range(*host.span()) if text[i] == ".")
            given = not host[0].lower().startswith("www.") and _is_mailbox(text, start, s.start(), host.end())
            if not given and not any(map(undone, dots)):
                continue
        edits.append((*s.span(), "@"))
    return edits


def normalise(text: str, *, fuse: bool = False) -> tuple[Mapped, bool]:
    """Homoglyphs, then spelled digits, then disguised signs; and whether `fuse` would join more digits."""
    m = Mapped(text)
    m.rewrite([(i, i + 1, plain(c)) for i, c in enumerate(m.text) if imitates(c)])
    m.rewrite([(*d.span(), ".") for d in IDEOGRAPHIC_DOT.finditer(m.text)])
    edits, apart = _digit_edits(m.text, fuse)
    m.rewrite(edits)
    m.rewrite([(*p.span(), "+") for p in PLUS.finditer(m.text)])
    m.rewrite([(*b.span(), "@" if b[1] or b[3] else ".") for b in BRACKETED.finditer(m.text)])
    m.rewrite([(*d.span(), ".") for d in SPACED_DOT.finditer(m.text)])
    m.rewrite(_underscore_edits(m.text))
    m.rewrite(_at_edits(m.text, lambda i: text[m.first[i] : m.last[i]] != "."))
    return m, apart


def find_all(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those and the disguised ones that no base span holds, where each kind's do not overlap; each
    by kind, then start.

    Where digits were left apart, numbers are looked for with all spelled digits joined first: "one nine two dot ..." is
    a number, while "five six@..." is no name of both words.
    """
    base = find(text)
    if not disguised(text):
        return base, base
    more: list[tuple[int, int, int]] = []

    def add(m: Mapped, kinds: tuple[int, ...]) -> None:
        for kind, start, end in find(m.text) if m.text != text else ():
            a, b = m.first[start], m.last[end - 1]
            if kind in kinds and not any(x <= a and b <= y for _, x, y in base) and not any(k == kind and x < b and a < y for k, x, y in more):
                more.append((kind, a, b))

    m, apart = normalise(text)
    if apart:
        add(normalise(text, fuse=True)[0], (1, 2, 3))
    add(m, (0, 1, 2, 3))
    return base, sorted(base + more)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of `docs` (doc_id, text).

    Null text counts as empty: no spans. Texts of any length are scanned whole. Repeated rows and null doc_ids each give
    a row; other columns are not read; an empty table gives an empty result.
    """

    def make():
        def write(found: list[tuple[int, int, int]]) -> str:
            return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in found])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, every = find_all(text)
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in base))
                hashes.append(hashlib.sha256(write(base).encode()).hexdigest())
                spans.append(write(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return step

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return map_batches(docs.select("doc_id", whole_text().alias("text")), make, schema)
