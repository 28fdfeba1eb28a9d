"""Personal data in texts: spans by fixed patterns, and redaction. Spans and replacement happen in the text's own row."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds, patterns and confidences, in the order that settles ties. All but names are found in either case.
PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.95),
    ("SSN", r"\b\d{9}\b", 0.7),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 0.95),
    ("CREDIT_CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", 0.85),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.98),
    ("PHONE", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.90),
    ("PHONE", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.85),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.90),
    ("DATE_OF_BIRTH", r"\b(?:dob|date\s+of\s+birth|birthdate)[:\s]+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", 0.95),
    ("DATE_OF_BIRTH", r"\b(?:born|birthday)[:\s]+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", 0.90),
    ("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b", 0.75),
    ("DRIVERS_LICENSE", r"\b(?:DL|driver\'?s?\s*license)[:\s#]*[A-Z0-9-]{5,15}\b", 0.85),
    ("BANK_ACCOUNT", r"\b(?:account|acct)[:\s#]*\d{8,17}\b", 0.85),
    ("BANK_ACCOUNT", r"\b(?:routing)[:\s#]*\d{9}\b", 0.90),
    ("ADDRESS", r"\b\d+\s+[A-Za-z]+(?:\s+[A-Za-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\.?\b", 0.80),
]
NAME = ("NAME", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 0.85)
COMPILED = [(k, re.compile(p, re.IGNORECASE), c) for k, p, c in PATTERNS] + [(NAME[0], re.compile(NAME[1]), NAME[2])]
#: What a text must hold for a kind to be in it at all. A text is asked once for each of these before its patterns are tried.
THREE_DIGITS = re.compile(r"\d{3}")
GATES = {
    **dict.fromkeys(("SSN", "CREDIT_CARD", "PHONE", "PASSPORT", "BANK_ACCOUNT"), THREE_DIGITS),
    "EMAIL": re.compile("@"),
    "IP_ADDRESS": re.compile(r"\d\.\d"),
    "DATE_OF_BIRTH": re.compile(r"\d[-/]\d"),
    "DRIVERS_LICENSE": re.compile(r"DL|driver", re.IGNORECASE),
    "ADDRESS": re.compile(r"\d\s"),
    "NAME": re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\.\s"),
}
SPANS = "array<struct<pii_type:string,start_pos:long,end_pos:long,confidence:double,original:string>>"


def _holds(kind: str, found: str) -> bool:
    if kind == "CREDIT_CARD":
        digits = [int(c) for c in found if c.isdigit()]
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "IP_ADDRESS" or all(int(p) <= 255 for p in found.split("."))


def spans_of(text: str, kinds: frozenset[str] | None = None, custom: tuple[str, ...] = ()) -> list[tuple[str, int, int, float, str]]:
    """Spans that do not overlap: by start, then confidence; one that begins before the last kept one ends is left out.

    Only of `kinds`, if they are given, and of the caller's own patterns, in either case, as kind CUSTOM.
    """
    wanted = [x for x in COMPILED if kinds is None or x[0] in kinds] + [("CUSTOM", re.compile(p, re.IGNORECASE), 0.8) for p in custom]
    open_gates = {gate for gate in set(GATES.values()) if gate.search(text)}
    found = [(k, m.start(), m.end(), c, m[0]) for k, p, c in wanted if k not in GATES or GATES[k] in open_gates for m in p.finditer(text) if _holds(k, m[0])]
    kept, end = [], 0
    for span in sorted(found, key=lambda s: (s[1], -s[3])):
        if span[1] >= end:
            kept.append(span)
            end = span[2]
    return kept


def _replacement(kind: str, found: str, style: str) -> str:
    if style == "partial":
        return "*" * max(0, len(found) - 4) + found[-4:]
    if style == "hash":
        return f"[{kind}:{hashlib.sha256(found.encode()).hexdigest()[:8]}]"
    return {"category": f"<{kind}>", "remove": ""}.get(style, f"[{kind}]")


def detect(docs: DataFrame, *, kinds: Sequence[str] | None = None, custom: Sequence[str] = ()) -> DataFrame:
    """doc_id, pii_type, start_pos, end_pos, confidence, original: every span of every text, none for null texts."""
    only, own = None if kinds is None else frozenset(kinds), tuple(custom)

    @F.pandas_udf(SPANS)
    def find(text: pd.Series) -> pd.Series:
        return text.map(lambda t: spans_of(t, only, own) if t else [])

    return docs.select("doc_id", F.inline(find("text")))


def redact(docs: DataFrame, style: str = "mask", *, kinds: Sequence[str] | None = None, custom: Sequence[str] = ()) -> DataFrame:
    """doc_id, text with each span replaced, and n_spans. Styles: mask, partial, hash, category, remove. Null texts stay null."""
    only, own = None if kinds is None else frozenset(kinds), tuple(custom)

    @F.pandas_udf("text string, n_spans long")
    def replace(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            spans = spans_of(t, only, own) if t else []
            for kind, start, end, _, found in reversed(spans):
                t = t[:start] + _replacement(kind, found, style) + t[end:]
            out.append((t, len(spans)))
        return pd.DataFrame(out, columns=["text", "n_spans"])

    return docs.select("doc_id", replace("text").alias("r")).select("doc_id", "r.text", "r.n_spans")


def report(spans: DataFrame) -> DataFrame:
    """pii_type, n, n_high (confidence 0.9 or more), n_low (under 0.8)."""
    return spans.groupBy("pii_type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("n_high"), F.count_if(F.col("confidence") < 0.8).alias("n_low"))
