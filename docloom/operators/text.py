"""Text predicates and projections: guardrails, routing, validity, hashes, entities and mock embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: phrases of prompt injection, in the order in which they are tried.
INJECTION = [
    r"ignore\s+(previous|all|above)\s+instructions?",
    r"disregard\s+(previous|all|above)",
    r"you\s+are\s+now\s+",
    r"pretend\s+you\s+are",
    r"act\s+as\s+if\s+you",
    r"jailbreak",
    r"DAN\s*mode",
]
# Fixed patterns of entity and guardrail kinds.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
CARD = r"[0-9]{16}"


def first_injection(text: Column) -> Column:
    """Number of the first injection pattern that the text holds, from 1; null if none."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(INJECTION, 1)))


def capital_share(text: Column) -> Column:
    """Upper-case letters A-Z over all characters; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.length(text)).otherwise(F.lit(0.0))


def is_spam(text: Column) -> Column:
    """A word that makes up over half of more than 10 words, or over 70 % capitals in more than 20 characters."""
    words = F.array_remove(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), "")
    most = F.aggregate(F.sort_array(words), F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most")), _longest_run, lambda a: a["most"])
    return ((F.size(words) > 10) & (most > 0.5 * F.size(words))) | ((F.length(text) > 20) & (capital_share(text) > 0.7))


def _longest_run(acc: Column, word: Column) -> Column:
    n = F.when(acc["w"] == word, acc["n"] + 1).otherwise(F.lit(1))
    return F.struct(word.alias("w"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))


def luhn_cards(docs: DataFrame) -> DataFrame:
    """doc_id, n_cards, n_valid: 16-digit numbers of a document, and those whose check digit is right."""
    cards = F.regexp_extract_all("text", F.lit(CARD), F.lit(0))
    return docs.select("doc_id", cards.alias("c")).where(F.size("c") > 0).select("doc_id", F.size("c").cast("long").alias("n_cards"), F.expr("size(filter(c, x -> luhn_check(x)))").cast("long").alias("n_valid"))


def mock_embedding(text: Column, dimension: int = 16) -> Column:
    """SHA-256 bytes, repeated up to the dimension, as (b - 128) / 128."""
    digest = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.conv(F.substring(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") - 128) / 128.0)


def normalised(text: Column) -> Column:
    """Runs of spaces and tabs become one space, three or more newlines two, and the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """The text cut at sentence ends, trimmed, empty ones left out."""
    return F.array_remove(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), "")


def ended_sentences(text: Column, longer: int = 0) -> Column:
    """The text cut after sentence ends, which stay; only sentences of more than `longer` characters."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > longer)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
