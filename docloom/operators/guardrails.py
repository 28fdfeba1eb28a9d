"""Guardrails of texts that come in and go out: spam, injection, and personal data found and masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import text as texts

# Fixed patterns of personal data, in the order in which they are looked for and masked.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}\b",
    "ssn": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
#: The same patterns with what a mask keeps in groups, and the mask. Of networks nothing is kept but the length.
MASKS = {
    "email": (r"\b([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", "$1***@$2"),
    "phone": (r"\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?([0-9]{4})\b", "***-***-$1"),
    "ssn": (r"\b\d{3}[-]?\d{2}[-]?(\d{4})\b", "***-**-$1"),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}(\d{4})\b", "****-****-****-$1"),
}
REPETITION, CAPITALS = "Excessive repetition detected", "Excessive capitalization detected"


def stars(text: Column, pattern: str) -> Column:
    """The text with every match replaced by as many stars as it has characters."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.concat(gap, F.repeat(F.lit("*"), F.coalesce(F.length(hit), F.lit(0)))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def masked(text: Column) -> Column:
    """The text with all personal data masked, kind after kind."""
    for pattern, mask in MASKS.values():
        text = F.regexp_replace(text, pattern, mask)
    return stars(text, PATTERNS["ip_address"])


def has_pii(text: Column) -> Column:
    digits = "|".join(p for k, p in PATTERNS.items() if k != "email")
    return (text.contains("@") & text.rlike(PATTERNS["email"])) | text.rlike(digits)


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, type, value, masked: every match of each pattern of `docs` (doc_id, text). Kinds may overlap."""

    def of(kind: str) -> Column:
        hits = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        mask = (lambda v: F.regexp_replace(v, *MASKS[kind])) if kind in MASKS else (lambda v: F.repeat(F.lit("*"), F.length(v)))
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), mask(v).alias("masked")))

    return docs.select("doc_id", F.explode(F.flatten(F.array(*map(of, PATTERNS)))).alias("f")).select("doc_id", "f.*")


def spam(text: Column) -> Column:
    """Why the text is spam: one word is over half of more than 10, or over 70 % of more than 20 characters are capitals; else null."""
    words = F.array_remove(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), "")
    # A word that is over half of all stands in the middle of the sorted words.
    middle = F.element_at(F.sort_array(words), (F.size(words) / 2).cast("int") + 1)
    repeated = 2 * (F.size(words) - F.size(F.array_remove(words, middle))) > F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return F.when((F.size(words) > 10) & repeated, REPETITION).when((F.length(text) > 20) & (capitals > 0.7 * F.length(text)), CAPITALS)


def check_input(docs: DataFrame, *, longest: int = 10_000, strict: bool = False) -> DataFrame:
    """doc_id, category, valid, filtered: the first that holds of too long, blank, injection, spam, personal data, safe.

    Spam is valid unless `strict`, and has no filtered text; personal data is masked; a null text counts as blank.
    """
    text = F.coalesce("text", F.lit(""))
    injected = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in texts.INJECTION))
    category = (
        F.when(F.length(text) > longest, "long")
        .when(F.trim(text) == "", "blank")
        .when(injected, "injection")
        .when(spam(text).isNotNull(), "spam")
        .when(has_pii(text), "pii")
        .otherwise("safe")
    )
    judged = docs.select("doc_id", text.alias("text"), category.alias("category"))
    valid = F.col("category").isin("pii", "safe", *([] if strict else ["spam"]))
    filtered = F.when(F.col("category") == "pii", masked(F.col("text"))).when(F.col("category") == "safe", F.col("text"))
    return judged.select("doc_id", "category", valid.alias("valid"), filtered.alias("filtered"))


def check_output(docs: DataFrame, *, longest: int = 50_000, suffix: str = "... [truncated]") -> DataFrame:
    """doc_id, category, filtered: too long a text is cut and marked; else personal data is masked; null as empty."""
    text = F.coalesce("text", F.lit(""))
    long = F.length(text) > longest
    category = F.when(~long & has_pii(text), "pii").otherwise("safe")
    filtered = F.when(long, F.concat(F.left(text, F.lit(longest)), F.lit(suffix))).otherwise(masked(text))
    return docs.select("doc_id", category.alias("category"), filtered.alias("filtered"))


def check_context(chunks: DataFrame) -> DataFrame:
    """group_id, rank, text: every chunk of `chunks` (group_id, rank, text) masked; null texts stay null.

    `windows.contexts` puts these rows in the order of their contexts.
    """
    return chunks.select("group_id", "rank", masked(F.col("text")).alias("text"))
