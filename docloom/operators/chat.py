"""One plan from a message to the prompt of its answer: guardrail, retrieval, context, history, prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import guardrails, retrieval, vector_index
from docloom.operators.agents import rag_prompt

#: What a message that may not be answered gets instead, by what was found.
REFUSALS = {
    "long": "The message is too long.",
    "blank": "The message is empty.",
    "injection": "The message cannot be processed.",
    "spam": "The message looks like spam.",
}


def newest_questions(messages: DataFrame) -> DataFrame:
    """conv_id, turn, text: the newest message of the user in each conversation of `messages` (conv_id, turn, role, text).

    An aggregate, so a conversation of any length is no task's work alone.
    """
    asked = messages.where("role = 'user' and conv_id is not null")
    return asked.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m")).select("conv_id", "m.turn", "m.text")


def histories(messages: DataFrame, questions: DataFrame, last: int) -> DataFrame:
    """conv_id, n_history, history: the `last` messages before each of `questions` (conv_id, turn) as lines "Role: text".

    Spark keeps only the first `last` rows of each conversation in a task before it sorts them.
    """
    before = messages.join(questions.select("conv_id", F.col("turn").alias("asked")), "conv_id").where(F.col("turn") < F.col("asked"))
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    kept = before.select("conv_id", "turn", "role", "text", newest.alias("r")).where(F.col("r") <= last)
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))["line"]
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_history"), F.array_join(lines, "\n").alias("history"))


def chat_context(messages: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], *, k: int = 5, last: int = 10, most: int = 4000, least_score: float | None = None, strict: bool = False) -> DataFrame:
    """conv_id, turn, category, question, n_sources, context, n_history, history, prompt, refusal: for the newest question of
    each conversation what an answer is asked for with, or why it is not.

    `messages` has conv_id, turn, role and text, `chunks` vec_id, content and embedding, and `embed` makes the vector of a
    question. A question that the guardrail refuses has no question, context or prompt; personal data in others is masked
    before anything is looked up. Scores below `least_score` count as not found. A question without sources has a prompt with
    an empty context; conversations without a question have no row.
    """
    questions = newest_questions(messages)
    checked = guardrails.check_input(questions.select(F.col("conv_id").alias("doc_id"), "text"), strict=strict).select(F.col("doc_id").alias("conv_id"), "category", F.col("filtered").alias("question"))
    asked = checked.where("question is not null").select(F.col("conv_id").alias("vec_id"), embed(F.col("question")).alias("embedding"))
    # Questions and chunks are numbered each for themselves: a question is no chunk that it should not find.
    pairs = vector_index.exact(chunks.select("vec_id", "embedding"), asked, k, others=False)
    found = pairs if least_score is None else pairs.where(F.col("score") >= least_score)
    told = found.join(chunks.select("vec_id", "content"), "vec_id")
    context = retrieval.context(told, most=most).select(F.col("query_id").alias("conv_id"), F.col("total_chunks").alias("n_sources"), "context")
    joined = questions.select("conv_id", "turn").join(checked, "conv_id").join(context, "conv_id", "left").join(histories(messages, questions, last), "conv_id", "left")
    good = F.col("question").isNotNull()
    sources, said = F.coalesce("context", F.lit("")), F.coalesce("history", F.lit(""))
    prompt = F.concat(F.when(said != "", F.concat(said, F.lit("\n\n"))).otherwise(F.lit("")), rag_prompt(F.col("question"), sources))
    refusal = F.coalesce(*(F.when(F.col("category") == c, F.lit(text)) for c, text in REFUSALS.items()))
    return joined.select(
        "conv_id", "turn", "category", "question", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.when(good, sources).alias("context"),
        F.coalesce("n_history", F.lit(0)).alias("n_history"), said.alias("history"), F.when(good, prompt).alias("prompt"), F.when(~good, refusal).alias("refusal"),
    )
