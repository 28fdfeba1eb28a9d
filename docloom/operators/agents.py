"""Routing, query expansion, response checks and training formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases that mark a kind of question, in the order in which kinds and phrases are tried.
ROUTES = {
    "factual": ["what is", "who is", "when", "where", "define"],
    "analytical": ["analyze", "compare", "explain why", "evaluate"],
    "procedural": ["how to", "steps to", "process for"],
    "summarization": ["summarize", "overview", "brief"],
}
# Synonyms for query expansion.
SYNONYMS = {
    "show": ["display", "present", "list"],
    "find": ["search", "locate", "get"],
    "explain": ["describe", "elaborate", "clarify"],
    "summary": ["overview", "brief", "synopsis"],
    "details": ["information", "specifics", "data"],
    "create": ["generate", "make", "build"],
}


def route(query: Column) -> Column:
    """Kind of question: the first with a phrase in the lower-cased query, else general."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return F.coalesce(*(F.when(low.rlike("|".join(phrases)), F.lit(kind)) for kind, phrases in ROUTES.items()), F.lit("general"))


def steps(kind: Column) -> Column:
    """The agents that answer this kind of question, in order."""
    fixed = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(kind == "analytical", fixed("retriever", "reranker", "synthesizer", "validator", "reflector"))
        .when(kind == "summarization", fixed("retriever", "synthesizer"))
        .otherwise(fixed("retriever", "reranker", "synthesizer"))
    )


def expanded(query: Column, most: int = 5) -> Column:
    """The query, then its lower-cased form with each known word replaced by each synonym; at most five in all."""
    low = F.lower(query)
    known = F.create_map(*(x for w, s in SYNONYMS.items() for x in (F.lit(w), F.array(*map(F.lit, s)))))
    made = F.flatten(F.transform(F.split(low, r"[ \t\n\r\f\x0B]+"), lambda w: F.transform(F.coalesce(F.try_element_at(known, w), F.array().cast("array<string>")), lambda s: F.replace(low, w, s))))
    return F.slice(F.concat(F.array(query), made), 1, most)


def checked_responses(messages: DataFrame, confidence: float = 0.85) -> DataFrame:
    """For every assistant message (conv_id, turn, role, text): score, the share of four checks that hold, and the confidence.

    Longer than 10, longer than 50, shorter than 5,000 characters, and holding the first 20 characters of the message before
    it (not if that is null). Confidence rises by 0.1 if all hold, else it falls by 0.2.
    """
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    answers = messages.withColumn("before", before).where("role = 'assistant'")
    n = F.length(F.coalesce("text", F.lit("")))
    checks = [n > 10, n > 50, n < 5000, F.coalesce(F.contains("text", F.left("before", F.lit(20))), F.lit(False))]
    score = sum((c.cast("int") for c in checks), F.lit(0)) / 4
    rated = answers.withColumn("score", score)
    return rated.select("conv_id", "turn", "score", F.round(F.when(F.col("score") == 1, F.least(F.lit(1.0), F.lit(confidence + 0.1))).otherwise(F.greatest(F.lit(0.0), F.lit(confidence - 0.2))), 6).alias("confidence"))


def sections(text: Column) -> Column:
    """A text cut at blank lines, before headers and before numbered lines; trimmed, blank ones left out."""
    cut = F.array(F.coalesce(text, F.lit("")))
    for pattern in (r"\n\n+", r"\n(?=[A-Z][a-z]+:)", r"\n(?=[0-9]+\.)"):
        cut = F.flatten(F.transform(cut, lambda s: F.split(s, pattern)))  # noqa: B023 (called at once)
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def completion(question: Column, answer: Column) -> Column:
    """A training example as one text: the question, a blank line and the answer."""
    return F.concat(question, F.lit("\n\n"), answer)


def rag_prompt(question: Column, context: Column) -> Column:
    """The prompt of an answer from a context."""
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def frames(messages: DataFrame, *, words: int = 5) -> DataFrame:
    """conv_id, turn, place, event, data: each message as a stream of a start, chunks of so many words, and an end that tells
    how many chunks and characters there were."""
    cut = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+"), "")
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"), F.lit(words))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice("w", i, words), " "))
    frame = lambda event, data: F.struct(F.lit(event).alias("event"), data.alias("data"))
    end = F.concat(F.size("c").cast("string"), F.lit(" chunks, "), F.length(F.array_join("c", " ")).cast("string"), F.lit(" characters"))
    every = F.concat(F.array(frame("start", F.lit(""))), F.transform("c", lambda c: frame("chunk", c)), F.array(frame("end", end)))
    cut_up = messages.select("conv_id", "turn", cut.alias("w")).select("conv_id", "turn", chunks.alias("c"))
    return cut_up.select("conv_id", "turn", F.posexplode(every).alias("place", "f")).select("conv_id", "turn", "place", "f.event", "f.data")


def instruction(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), question, F.lit("\n\n### Response:\n"), answer)


def chat(question: Column, answer: Column, system: str | None = None) -> Column:
    """Messages of a training example: an optional system message, the user's and the assistant's."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(*([said("system", F.lit(system))] if system else []), said("user", question), said("assistant", answer))


def reviewed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, remarks, again: what to mend in each assistant message, and whether to try again.

    A message is grounded if it has the first 20 characters of the one before; it is brief below 100 characters; confidence is
    low where a check of `checked_responses` fails. A null text is an empty one.
    """
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    told = messages.select("conv_id", "turn", "role", "text", before.alias("before")).where("role = 'assistant'")
    grounded, length = F.coalesce(F.contains("text", F.left("before", F.lit(20))), F.lit(False)), F.length(F.coalesce("text", F.lit("")))
    low = ~(grounded & (length > 50) & (length < 5000))
    remarks = F.array_compact(F.array(F.when(~grounded, "ungrounded"), F.when(length < 100, "brief"), F.when(low, "low_confidence")))
    return told.select("conv_id", "turn", F.array_join(remarks, ",").alias("remarks"), low.alias("again"))


def prompt(messages: DataFrame, *, last: int = 10) -> DataFrame:
    """conv_id, prompt: the `last` messages before the newest of each conversation as lines `Role: text`; none for a lone message."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    kept = messages.select("conv_id", "turn", line.alias("line"), F.row_number().over(newest).alias("r")).where(F.col("r").between(2, last + 1))
    lines = F.sort_array(F.collect_list(F.struct("turn", "line")))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def parsed_reply(reply: Column, fields: list[str], *, most: int = 200) -> list[Column]:
    """`parsed`, the fields of a JSON reply as strings, and `fallback`: the reply's first characters where it is not JSON."""
    good = F.coalesce(F.try_parse_json(reply).isNotNull(), F.lit(False))
    return [good.alias("parsed"), *(F.when(good, F.get_json_object(reply, f"$.{f}")).alias(f) for f in fields), F.when(~good, F.left(reply, F.lit(most))).alias("fallback")]


def topics(text: Column, most: int = 20) -> Column:
    """Capitalised words of three letters or more without surrounding punctuation, and quoted phrases: the first `most` by order. Null for a null text."""
    bare = F.transform(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: F.btrim(w, F.lit(".,!?;:()\"'")))
    names = F.filter(bare, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}"))
    return F.slice(F.sort_array(F.array_distinct(F.concat(names, F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))))), 1, most)


def result(reply: Column) -> Column:
    """The result of a document as structs of extraction, analysis and confidence, from a JSON object; what it lacks is empty or 0."""
    of = lambda key: F.coalesce(F.get_json_object(reply, f"$.{key}"), F.lit(""))
    number = lambda key: F.coalesce(F.get_json_object(reply, f"$.{key}").cast("double"), F.lit(0.0))
    return F.struct(
        F.struct(of("content").alias("raw_text"), of("tables").alias("tables")).alias("extraction"),
        F.struct(of("summary").alias("summary"), of("classification").alias("classification")).alias("analysis"),
        F.struct((number("k") / 100).alias("extraction_confidence"), number("confidence").alias("analysis_confidence")).alias("confidence_scores"),
    )


def workflow(messages: DataFrame) -> DataFrame:
    """conv_id, turn, kind, n_steps, answered, confidence, iterate: for every user message the route it takes, and what the
    synthesizer, the validator (analytical questions only) and the reflector make of the assistant's next message."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ahead = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    asked = ahead.where("role = 'user'").select("conv_id", "turn", "text", route(F.col("text")).alias("kind"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"))
    n = F.length("response")
    sound = (n > 10) & (n > 50) & (n < 5000) & F.contains("response", F.left("text", F.lit(20)))
    checked = F.col("kind") == "analytical"
    answered = F.col("response").isNotNull()
    confidence = F.round(F.when(~answered, 0.0).when(~checked, 0.85).when(sound, 0.95).otherwise(0.65), 6)
    return asked.select("conv_id", "turn", "kind", F.size(steps(F.col("kind"))).alias("n_steps"), answered.alias("answered"), confidence.alias("confidence"), (checked & answered & (confidence < 0.7)).alias("iterate"))
