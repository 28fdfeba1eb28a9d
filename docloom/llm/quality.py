"""Quality rules as weak supervision, by DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes are counted by pattern over all documents;
there are at most 3 ** rules patterns, whatever the input. Expectation-maximisation over these counts estimates without
labels how often each rule votes either way on good and on bad documents, and a document's verdict is its posterior
probability of being good, instead of having to pass every rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE, carried, materialise, released, whole_text

WINDOW = 8  # words
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Fixed list of frequent function words in English, French, German and Spanish.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "or", "an", "not",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "qui", "dans", "pour", "pas", "du", "au", "sur", "est", "il", "ne",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "ein", "eine", "nicht", "auf", "für", "im", "dem", "auch", "als", "es",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "para", "no", "su", "al", "lo", "como", "más", "pero", "sus", "ha", "me",
]


def measures(rows: DataFrame) -> DataFrame:
    """`rows` (text, not null), with `words`, `lines` and the five measures of the text.

    Windows of words are told apart by a 64-bit hash within one text. Only texts in which some window repeats go on to
    the count of covered words: each repeated window covers its words, and overlaps count once.
    """
    blank = " \t\n\x0b\f\r"
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, blank, "")) > 0)
    windows = F.expr(f"transform(sequence(0, n_words - {WINDOW}), i -> xxhash64(slice(words, i + 1, {WINDOW})))")
    none = F.array().cast("array<bigint>")
    ranked = F.expr("sort_array(transform(windows, (h, i) -> struct(h as h, i as i)))")
    repeated = F.expr("filter(transform(ranked, (x, k) -> if((k > 0 and ranked[k - 1].h = x.h) or (k < size(ranked) - 1 and ranked[k + 1].h = x.h), x.i, -1)), i -> i >= 0)")
    covered = F.expr(f"aggregate(starts, struct(0L as n, -{WINDOW} as last), (a, i) -> struct(a.n + least({WINDOW}, i - a.last) as n, i as last), a -> a.n)")
    return (
        rows.withColumn("words", F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, blank, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("lines", lines)
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(none))
        .withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
        .withColumn("ranked", F.when(F.col("again"), ranked))
        .withColumn("starts", F.when(F.col("again"), F.sort_array(repeated)))
        .withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(F.lit(0)).cast("long"))
        .drop("windows", "again", "ranked", "starts")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Each rule: its name, the measure it looks at, where that votes bad, and where it votes good.
def rules() -> list[tuple[str, Column, Column]]:
    """Name, bad and good of each rule; it abstains where neither holds."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size("lines"), F.lit(1))
    mean, symbols, repeats = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_repeat_words") / n
    letters, capitals = F.col("n_letters") / chars, F.col("n_capitals") / chars
    ended, twice, different = F.col("n_ended") / n_lines, F.col("n_dup_lines") / n_lines, F.col("n_distinct") / n
    known = F.col("n_function_words")
    return [
        ("length", n < 30, n >= 50),
        ("mean_word", (mean < 3) | (mean > 10), (mean >= 3.5) & (mean <= 8)),
        ("symbols", symbols > 0.1, symbols < 0.02),
        ("letters", letters < 0.75, letters >= 0.9),
        ("function_words", (known < 2) & (n >= 30), known >= 4),
        ("line_ends", ended < 0.2, ended >= 0.6),
        ("dup_lines", twice > 0.3, twice < 0.1),
        ("repeats", repeats > 0.2, repeats < 0.1),
        ("capitals", capitals > 0.4, capitals < 0.15),
        ("variety", different < 0.1, different > 0.3),
    ]


def votes() -> Column:
    """The votes of all rules as an array; a text without words gets bad votes alone."""
    return F.array(*(F.when(bad | (F.col("n_words") == 0), -1).when(good, 1).otherwise(0) for _, bad, good in rules()))


Ratios = list[dict[int, float]]


def expectation(patterns: Sequence[tuple[tuple[int, ...], int]], odds: float, ratios: Ratios) -> list[float]:
    """The probability of being good for each vote pattern."""
    total = lambda v: odds + sum(r[x] for r, x in zip(ratios, v, strict=True))
    return [1 / (1 + math.exp(-max(-700.0, min(700.0, total(v))))) for v, _ in patterns]


def maximisation(patterns: Sequence[tuple[tuple[int, ...], int]], belief: Sequence[float], prior: float) -> tuple[float, Ratios]:
    """Log odds of being good, and each rule's log-likelihood ratio of each vote, from beliefs.

    Counts are smoothed by a few documents of either class, as many as `prior` says, on which rules mostly are right.
    """
    good = sum(n * b for (_, n), b in zip(patterns, belief, strict=True)) + 10 * prior
    bad = sum(n * (1 - b) for (_, n), b in zip(patterns, belief, strict=True)) + 10 * (1 - prior)
    ratios: Ratios = []
    for j in range(len(patterns[0][0])):
        on_good, on_bad = {-1: 0.5, 0: 1.0, 1: 1.5}, {-1: 1.5, 0: 1.0, 1: 0.5}
        for (v, n), b in zip(patterns, belief, strict=True):
            on_good[v[j]] += n * b
            on_bad[v[j]] += n * (1 - b)
        a, z = sum(on_good.values()), sum(on_bad.values())
        ratios.append({x: math.log(on_good[x] / a) - math.log(on_bad[x] / z) for x in (-1, 0, 1)})
    return math.log(good / bad), ratios


def dependent(patterns: Sequence[tuple[tuple[int, ...], int]], belief: Sequence[float], most: float = 0.9) -> set[int]:
    """Rules whose votes within the class believed bad go along with an earlier rule's, to be left out."""
    k, out = len(patterns[0][0]), set()
    weights = [n * (1 - b) for (_, n), b in zip(patterns, belief, strict=True)]
    total = sum(weights)
    if total <= 0:
        return out
    mean = [sum(w * v[j] for (v, _), w in zip(patterns, weights, strict=True)) / total for j in range(k)]
    moment = lambda i, j: sum(w * (v[i] - mean[i]) * (v[j] - mean[j]) for (v, _), w in zip(patterns, weights, strict=True)) / total
    spread = [moment(j, j) for j in range(k)]
    for j in range(k):
        if any(i not in out and spread[i] * spread[j] > 1e-12 and moment(i, j) ** 2 > most * most * spread[i] * spread[j] for i in range(j)):
            out.add(j)
    return out


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], *, prior: float = 0.85, rounds: int = 200) -> tuple[float, Ratios]:
    """Log odds of being good before any vote, and for each rule the log-likelihood ratio of each vote.

    Expectation-maximisation from the belief that a document is good if more rules vote good than three times those that
    vote bad. Rules that only repeat an earlier one among bad documents are then left out (ratios of 0), since the
    probability takes rules as independent, and the rest is estimated again.
    """
    patterns = [p for p in patterns if p[1] > 0]
    if not patterns:
        return math.log(prior / (1 - prior)), []
    k = len(patterns[0][0])
    out: set[int] = set()
    for _ in range(2):
        belief = [0.95 if sum(x > 0 for x in v) > 3 * sum(x < 0 for x in v) else 0.05 for v, _ in patterns]
        for _ in range(rounds):
            odds, ratios = maximisation(patterns, belief, prior)
            ratios = [{-1: 0.0, 0: 0.0, 1: 0.0} if j in out else r for j, r in enumerate(ratios)]
            fresh = expectation(patterns, odds, ratios)
            moved, belief = max(abs(a - b) for a, b in zip(fresh, belief, strict=True)), fresh
            if moved < 1e-7:
                break
        if out or not (out := dependent(patterns, belief)):
            break
    return odds, [ratios[j] for j in range(k)]


def voted(rows: DataFrame) -> DataFrame:
    """`rows` (text) with the measures and `votes`."""
    text = F.col("text")
    known = F.array(*map(F.lit, FUNCTION_WORDS))
    more = (
        measures(rows)
        .withColumn("n_capitals", F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")))
        .withColumn("n_letters", F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", "")))
        .withColumn("n_ended", F.size(F.filter("lines", lambda line: F.rtrim(line).substr(F.lit(-1), F.lit(1)).isin(*".!?:;\"'…”»)"))))
        .withColumn("different", F.array_distinct("words"))
        .withColumn("n_distinct", F.size("different"))
        .withColumn("n_function_words", F.size(F.array_intersect("different", known)))
    )
    return more.withColumn("votes", votes())


def posterior(vote: Column, odds: float, ratios: Ratios) -> Column:
    """The probability of being good, from an array of votes."""
    parts = [F.when(vote[j] == -1, F.lit(r[-1])).when(vote[j] == 1, F.lit(r[1])).otherwise(F.lit(r[0])) for j, r in enumerate(ratios)]
    return 1 / (1 + F.exp(-(F.lit(odds) + reduce(lambda a, b: a + b, parts, F.lit(0.0)))))


def fit(table: DataFrame) -> tuple[float, Ratios]:
    """Estimate from all rows of a table with `votes`. At most 3 ** rules patterns come to the driver, in practice some hundred."""
    return estimate(sorted((tuple(r[0]), r[1]) for r in table.groupBy("votes").count().collect()))


def judge(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior for each row.

    Null and empty texts have no words: all counts 0, base_failed, not kept. Repeated rows each give a row; columns of
    `docs` other than doc_id and text are not read. The measures are written once to the shared folder, so the texts are
    read once.
    """
    table = voted(docs.select("doc_id", whole_text().alias("text"))).select("doc_id", *MEASURES, base_failed().alias("base_failed"), "votes")
    table = materialise(table, "quality")
    odds, ratios = fit(table)
    p = posterior(F.col("votes"), odds, ratios)
    return table.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (p >= threshold)).alias("kept"), p.alias("posterior"))


def keep_good(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The rows and columns of `docs` that the verdict keeps, null keys and repeated rows included.

    Columns of any names keep their values. The rows that do not fail the base limits are written once with their votes,
    so that the texts are measured once; their estimate counts the votes of the others too.
    """
    rows = voted(carried(docs).withColumn("text", whole_text(f"{ROW}.text")))
    table = materialise(rows.select(F.when(~base_failed(), F.col(ROW)).alias(ROW), "votes"), "quality")
    odds, ratios = fit(table)
    good = posterior(F.col("votes"), odds, ratios) >= threshold
    return released(table.where(F.col(ROW).isNotNull() & good))
