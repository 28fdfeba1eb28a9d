"""Scores of answers and of retrieval, as columns over arrays or as joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.stats import grade

# Words of a question that say nothing about its subject.
QUESTION_WORDS = ["the", "a", "an", "is", "are", "was", "were", "what", "how", "why", "when", "where"]


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\x0B]+"), "")


def faithfulness(answer: Column, context: Column) -> Column:
    """Different words of the answer that the context has, over all of its different words; 0 if there are none."""
    said = F.array_distinct(tokens(answer))
    return F.when(F.size(said) > 0, F.size(F.array_intersect(said, tokens(context))) / F.size(said)).otherwise(F.lit(0.0))


def relevancy(query: Column, answer: Column) -> Column:
    """Different words of the query, without question words, that the answer has; 0.5 if only question words are asked, 0 if a side is empty."""
    asked = F.array_except(tokens(query), F.array(*map(F.lit, QUESTION_WORDS)))
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(answer))) / F.size(asked)).otherwise(F.lit(0.5))
    return F.when((F.coalesce(query, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == ""), F.lit(0.0)).otherwise(share)


def bleu(pairs: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """`key` and bleu: unigram precision times the brevity penalty. Word counts of both sides meet in one grouping."""
    of_side = lambda column, side: F.transform(tokens(F.col(column)), lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    words = F.concat(of_side(reference, 0), of_side(hypothesis, 1))
    counts = pairs.select(key, F.explode_outer(words).alias("t")).groupBy(key, "t.w").agg(F.count_if(F.col("t.side") == 0).alias("r"), F.count_if(F.col("t.side") == 1).alias("h"))
    total = counts.groupBy(key).agg(F.sum("r").alias("r"), F.sum("h").alias("h"), F.sum(F.least("r", "h")).alias("both"))
    penalty = F.when(F.col("h") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return total.select(key, F.when(F.col("h") > 0, F.round(penalty * F.col("both") / F.col("h"), 6)).otherwise(F.lit(0.0)).alias("bleu"))


def precision_at(retrieved: Column, truth: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), truth)) / F.lit(k)


def recall_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Null where nothing is true, so that means leave such samples out."""
    return F.when(F.size(truth) > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), truth)) / F.size(truth))


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    first = F.array_position(F.transform(retrieved, lambda x: F.array_contains(truth, x)), F.lit(True))
    return F.when(first > 0, 1 / first).otherwise(F.lit(0.0))


def ndcg(retrieved: Column, truth: Column, scores: Column) -> Column:
    """Gains are the given scores, else 1 for a true one; the ideal has as many ones as are true, so that it may exceed 1."""
    gain = F.transform(retrieved, lambda x, i: F.coalesce(F.get(scores, i), F.array_contains(truth, x).cast("double")) / F.log2(i + 2))
    ideal = F.transform(truth, lambda x, i: 1 / F.log2(i + 2))
    add = lambda a, x: a + x
    return F.when(F.size(truth) > 0, F.aggregate(gain, F.lit(0.0), add) / F.aggregate(ideal, F.lit(0.0), add))


def ideal_gains(sizes: DataFrame, block: int = 100_000) -> DataFrame:
    """others, ideal: the sum of 1 / log2(i + 1) for i from 1 to each of `sizes` (others), in blocks of a bounded size."""
    blocks = sizes.select("others", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(others - 1) div {block}"))).alias("b"))
    ranks = F.sequence(F.col("b") * block + 1, F.least(F.col("others"), (F.col("b") + 1) * block))
    each = blocks.select("others", F.aggregate(ranks, F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)).alias("gain"))
    return each.groupBy("others").agg(F.sum("gain").alias("ideal"))


def retrieval_by_label(hits: DataFrame, labelled: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """query_id, p1, r1, p3, r3, ..., reciprocal_rank, ndcg, context_precision for ranked `hits` (query_id, vec_id, rank,
    score), where rows of the same label in `labelled` (vec_id, label) are true; queries without any are left out.

    Gains are the scores and the ideal has a 1 for each true row, so that ndcg may exceed 1. Labels are compared and
    counted, so no list of true rows is ever built; the ideal is one number for each different size of a label.
    """
    names = labelled.select("vec_id", "label")
    sizes = names.groupBy("label").agg((F.count("*") - 1).alias("others")).where("others > 0")
    ideal = ideal_gains(sizes.select("others").distinct())
    asked = names.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    judged = hits.join(names, "vec_id").join(asked, "query_id").withColumn("hit", F.col("label") == F.col("asked"))
    within = lambda k: F.count_if(F.col("hit") & (F.col("rank") <= k))
    scored = judged.groupBy("query_id", "asked").agg(
        *(within(k).alias(f"h{k}") for k in ks), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.col("score") / F.log2(F.col("rank") + 1)).alias("gain"), F.avg(F.col("hit").cast("int")).alias("share")
    )
    return scored.join(sizes.withColumnRenamed("label", "asked"), "asked").join(ideal, "others").select(
        "query_id", *(F.round(F.col(f"h{k}") / k, 6).alias(f"p{k}") for k in ks), *(F.round(F.col(f"h{k}") / F.col("others"), 6).alias(f"r{k}") for k in ks),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.col("gain") / F.col("ideal"), 6).alias("ndcg"), F.round("share", 6).alias("context_precision"),
    )


def overall(retrieval: DataFrame, generation: DataFrame, latency: DataFrame) -> DataFrame:
    """score, grade, issues, insights from the means of retrieval (reciprocal_rank, ndcg, context_precision, p1) and generation
    (faithfulness, relevancy) and one row of latencies (p50, p95)."""
    mean = lambda frame, *names: frame.agg(*(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names))
    one = mean(retrieval, "reciprocal_rank", "ndcg", "context_precision", "p1").crossJoin(mean(generation, "faithfulness", "relevancy")).crossJoin(latency)  # rows of one
    c = F.col
    score = 0.25 * (c("reciprocal_rank") + c("ndcg")) / 2 + 0.35 * (c("faithfulness") + c("relevancy")) / 2 + 0.25 * c("context_precision") + 0.15 * (1 - F.least(F.lit(1.0), c("p50") / 5))
    issues = [
        F.when(c("reciprocal_rank") < 0.5, "Low MRR indicates relevant documents not ranked highly"),
        F.when(c("faithfulness") < 0.6, "Low faithfulness - answers may not be grounded in context"),
        F.when(c("p95") > 3.0, "High P95 latency may impact user experience"),
        F.when(c("relevancy") < 0.5, "Answers may not be relevant to user queries"),
    ]
    insights = [
        F.when(c("score") > 0.8, "Overall system performance is excellent").when(c("score") > 0.6, "System performs adequately with room for improvement").otherwise("System needs significant improvements"),
        F.when(c("p1") > 0.8, "Top-1 retrieval is highly accurate"),
        F.when(c("faithfulness") > c("relevancy"), "Consider improving query understanding for better relevancy"),
    ]
    listed = lambda texts: F.array_join(F.array_compact(F.array(*texts)), " | ")
    rated = one.withColumn("score", score)
    return rated.select(F.round("score", 6).alias("score"), grade(c("score")).alias("grade"), listed(issues).alias("issues"), listed(insights).alias("insights"))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. One bit for each word of `b`: additions of whole rows instead of a table."""
    places: dict[str, int] = {}
    for i, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for word in a:
        met = row & places.get(word, 0)
        row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


def rouge_of(reference: str | None, hypothesis: str | None) -> float:
    """F1 of the longest common subsequence of lower-cased words; 0 if a side is null or has no words."""
    a, b = (reference or "").lower().split(), (hypothesis or "").lower().split()
    return 2 * longest_common(a, b) / (len(a) + len(b)) if a and b else 0.0


def rouge_l(reference: Column, hypothesis: Column) -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rouge_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score(reference, hypothesis)


def judged(query: Column, expected: Column, answer: Column) -> list[Column]:
    """relevance, accuracy, completeness and coherence by rule, for use where no model judges.

    Accuracy is 0.5 if an answer is missing, completeness counts words up to 50, coherence is taken to be 0.8.
    """
    given = (F.coalesce(expected, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "")
    return [
        relevancy(query, answer).alias("relevance"),
        F.when(given, rouge_l(expected, answer)).otherwise(F.lit(0.5)).alias("accuracy"),
        F.least(F.lit(1.0), F.size(tokens(answer)) / 50).alias("completeness"),
        F.lit(0.8).alias("coherence"),
    ]


def cost(texts: DataFrame, label: str, *, per_thousand: float = 0.002) -> DataFrame:
    """`label`, n, mean_tokens (1.3 for each word) and mean_cost; null texts have no words."""
    n = 1.3 * F.size(tokens(F.col("text")))
    return texts.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_tokens"), F.round(F.avg(n) / 1000 * per_thousand, 9).alias("mean_cost"))


def compared(before: DataFrame, after: DataFrame, *, margin: float = 5.0) -> DataFrame:
    """metric, baseline, enhanced, change (percent; null unless the baseline is above 0) and verdict of two tables (metric, value)."""
    change = F.when(F.col("baseline") > 0, F.round((F.col("enhanced") - F.col("baseline")) / F.col("baseline") * 100, 6))
    both = before.select("metric", F.col("value").alias("baseline")).join(after.select("metric", F.col("value").alias("enhanced")), "metric")
    verdict = F.when(F.col("change") > margin, "better").when(F.col("change") < -margin, "worse").otherwise("same")
    return both.withColumn("change", change).withColumn("verdict", verdict)


def dataset_quality(rows: DataFrame, *, split: str, category: str, question: Column, text: Column) -> DataFrame:
    """For each split: n, completeness, diversity of words, balance of categories, share of different questions, overall.

    Words, categories and questions are counted by (split, value) first, so that no split is gathered in one task.
    """
    each = rows.select(F.col(split).alias("split"), F.col(category).alias("category"), question.alias("question"), text.alias("text"))
    seen = each.select("split", F.explode(tokens(F.col("text"))).alias("word")).groupBy("split", "word").agg(F.count("*").alias("k")).groupBy("split")
    words = seen.agg(F.least(F.lit(1.0), 2 * F.count("*") / F.sum("k")).alias("diversity"))
    kinds = each.groupBy("split", "category").agg(F.count("*").alias("k")).groupBy("split")
    balance = F.when(F.count("*") <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop("k") / F.avg("k")))
    asked = each.groupBy("split", "question").agg(F.count("*").alias("k"), F.count_if(F.trim("text") != "").alias("full")).groupBy("split")
    base = asked.agg(F.sum("k").alias("n"), (F.sum("full") / F.sum("k")).alias("completeness"), (F.count("question") / F.sum("k")).alias("unique_ratio"))
    found = base.join(words, "split", "left").join(kinds.agg(balance.alias("balance")), "split").fillna(0.0, ["diversity"])
    parts = ["completeness", "diversity", "balance", "unique_ratio"]
    overall = sum(w * F.col(c) for w, c in zip((0.3, 0.25, 0.25, 0.2), parts, strict=True))
    return found.select("split", "n", *(F.round(c, 6).alias(c) for c in parts), F.round(overall, 6).alias("overall"))
