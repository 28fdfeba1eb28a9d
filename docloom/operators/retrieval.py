"""The chain from a ranked list of chunks to the context of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.evaluation import tokens


def context(found: DataFrame, *, most: int = 4000) -> DataFrame:
    """query_id, total_chunks, avg_score, context: the ranked chunks of each query (query_id, rank, score, content) joined by
    blank lines: whole while they fit, 2 for a separator; the first that does not fit is cut if over 100 characters are
    left, and the rest is left out. The fold is over the few chunks of one query."""
    chunks = F.sort_array(F.collect_list(F.struct("rank", "content")))["content"]
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, chunk: Column) -> Column:
        left = F.lit(most) - acc["used"]
        fits = F.length(chunk) <= left
        piece = F.when(fits, F.array(chunk)).when(left > 100, F.array(F.concat(chunk.substr(F.lit(1), left), F.lit("...")))).otherwise(F.array().cast("array<string>"))
        nothing = acc["full"]
        return F.struct(
            F.when(nothing | ~fits, acc["used"]).otherwise(acc["used"] + F.length(chunk) + 2).alias("used"), (nothing | ~fits).alias("full"), F.when(nothing, acc["parts"]).otherwise(F.concat(acc["parts"], piece)).alias("parts")
        )

    joined = F.aggregate("chunks", start, add, lambda acc: F.array_join(acc["parts"], "\n\n"))
    return found.groupBy("query_id").agg(F.count("*").alias("total_chunks"), F.round(F.avg("score"), 6).alias("avg_score"), chunks.alias("chunks")).select("query_id", "total_chunks", "avg_score", joined.alias("context"))


def final_score(rerank: Column, initial: Column) -> Column:
    """The rerank score where it is above 0, else the first one."""
    return F.when(rerank > 0, rerank).otherwise(initial)


def reranked(chunks: DataFrame, *, most: int | None = None) -> DataFrame:
    """`chunks` (query_id, vec_id, score) with their rank by falling score. Without a model nothing is cut, whatever is asked for."""
    ranked = chunks.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def first_seen(found: DataFrame, *, most: int = 5) -> DataFrame:
    """query_id, vec_id, score, rank: of chunks found by several forms of a query (query_id, form, rank, vec_id, score) the
    first of each, the best `most` of them by that score."""
    once = found.groupBy("query_id", "vec_id").agg(F.min_by("score", F.struct("form", "rank")).alias("score"))
    return reranked(once, most=most)


def source_list(chunks: DataFrame, *, most: int = 5) -> DataFrame:
    """query_id, context: the best chunks (query_id, vec_id, score, content) of each query under numbered headings with scores;
    null contents are left out, and a query with no other has a null context.

    The score is rounded by its binary value, as C and Python print it: 0.1235 is a little less than its decimals and gives
    0.123. `format_string` rounds the decimals and would give 0.124.
    """
    top = reranked(chunks, most=most)
    # `format_number` takes the double just above 0.0005 for a tie with 0.
    least = F.abs("score").between(0.0005, 0.001)
    score = F.call_function("format_number", F.when(least, 0.001 * F.signum("score")).otherwise(F.col("score")), F.lit("0.000"))
    entry = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] (score: "), score, F.lit(")\n"), "content")
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e"))))["e"], "\n\n")
    return top.groupBy("query_id").agg(F.when(F.count("content") > 0, joined).alias("context"))


def compressed(chunks: DataFrame, *, most: int = 8000) -> DataFrame:
    """query_id, n_sentences, context: sentences of the chunks (query_id, query, rank, score, content) by the share of the
    query's words in them plus half the chunk's score, best first, until the first that does not fit."""
    asked = F.array_distinct(tokens(F.col("query")))
    lines = chunks.select("query_id", "rank", "score", asked.alias("asked"), F.posexplode(F.split("content", r"(?<=[.!?])\s+")).alias("place", "sentence")).where(F.trim("sentence") != "")
    overlap = F.size(F.array_intersect("asked", F.array_distinct(tokens(F.col("sentence")))))
    rated = lines.withColumn("value", F.round(overlap / F.greatest(F.size("asked"), F.lit(1)) + 0.5 * F.col("score"), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("value").desc(), "rank", "place")
    upto = F.sum(F.length("sentence") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    # The running sum rises, so what fits stands before all that does not.
    kept = rated.select("query_id", "sentence", upto.alias("upto"), F.row_number().over(order).alias("at")).where(F.col("upto") <= most)
    return kept.groupBy("query_id").agg(F.count("*").alias("n_sentences"), F.array_join(F.sort_array(F.collect_list(F.struct("at", "sentence")))["sentence"], " ").alias("context"))
