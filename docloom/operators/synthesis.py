"""Question and answer pairs made of documents, and checks of datasets of them. Every choice is by a hash of seed and id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import agents
from docloom.operators.stats import grade

# Shares of difficulties, question types, and the templates of each.
DIFFICULTIES = {"easy": 0.4, "medium": 0.4, "hard": 0.2}
TYPES = ["factual", "inferential", "analytical"]
TEMPLATES = {
    "factual": [
        "What is {topic}?",
        "Who is responsible for {topic}?",
        "When did {event} occur?",
        "Where is {location} located?",
        "What are the key features of {topic}?",
    ],
    "inferential": [
        "Why might {topic} be important?",
        "What can be inferred about {topic}?",
        "How does {topic} relate to {other_topic}?",
        "What implications does {topic} have?",
    ],
    "analytical": [
        "Analyze the relationship between {topic1} and {topic2}.",
        "What are the advantages and disadvantages of {topic}?",
        "Compare and contrast {topic1} with {topic2}.",
    ],
}
EDGE_CASES = [
    "What if there is no information about {topic}?",
    "How to handle incomplete data regarding {topic}?",
    "What happens when {topic} is null or empty?",
    "Edge case: {topic} with special characters",
    "Boundary condition: minimum/maximum values for {topic}",
]
NEGATIVES = [
    "This question cannot be answered from the given context.",
    "The provided context does not contain information about {topic}.",
    "Insufficient data to determine {answer}.",
]
PARAPHRASES = {
    "What is": "Can you explain",
    "How does": "In what way does",
    "Why is": "What is the reason that",
    "When did": "At what time did",
    "Who is": "Which person is",
}
QUESTIONS = ["Based on the document, explain: ", "What information is provided about: ", "Summarize the following from the document: ", "Extract key details regarding: "]
EDGE_ANSWER = "Edge case handling: When dealing with {topic}, the system should gracefully handle missing or malformed data."


def draw(key: Column, what: str, seed: str = "42") -> Column:
    """A number from 0 to 2 ** 32 - 1 for what is drawn: the first 32 bits of MD5 over seed, what and key."""
    return F.conv(F.left(F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), key.cast("string"))), F.lit(8)), 16, 10).cast("long")


def drawn(options: Sequence[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options) + 1).cast("int"))


def filled(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def questions(docs: DataFrame) -> DataFrame:
    """doc_id, difficulty, question_type, topic, question, category, text: one question about each of `docs` (doc_id, text, lang)."""
    key = F.col("doc_id")
    unit = draw(key, "difficulty") / 2**32
    level, upto = F.lit(None).cast("string"), 1.0
    for name, share in reversed(DIFFICULTIES.items()):
        level = F.when(unit < round(upto, 9), F.lit(name)).otherwise(level)  # the widest bound is asked last
        upto -= share
    picked = docs.select("doc_id", "text", F.col("lang").alias("category"), agents.topics(F.col("text")).alias("topics"), level.alias("difficulty"), drawn(TYPES, draw(key, "type")).alias("question_type"))
    n = F.size("topics")
    of = lambda what, none: F.when(n > 0, F.element_at("topics", (draw(key, what) % F.greatest(n, F.lit(1)) + 1).cast("int"))).otherwise(F.lit(none))
    template = F.lit(None).cast("string")
    for kind, options in TEMPLATES.items():
        template = F.when(F.col("question_type") == kind, drawn(options, draw(key, "template"))).otherwise(template)
    topic = of("topic", "the topic")
    second = lambda none: F.when(n > 1, of("second", none)).otherwise(F.lit(none))
    question = filled(template, topic=topic, topic1=topic, topic2=second("related concept"), event=topic, location=topic, other_topic=second("another aspect"))
    return picked.select("doc_id", "difficulty", "question_type", topic.alias("topic"), question.alias("question"), "category", "text")


def answers(asked: DataFrame, *, most: int = 500, context: int = 1000) -> DataFrame:
    """`asked` (text, topic) with answer, the first sentence that holds the topic, and context, all that do while they fit."""
    sentences = F.split("text", r"[.!?]+")
    telling = F.filter(sentences, lambda s: F.contains(F.lower(s), F.lower("topic")))
    first = F.left(F.trim(F.element_at("telling", 1)), F.lit(most))
    canned = F.concat(F.lit("Based on the provided context, "), "topic", F.lit(" refers to relevant information in the document."))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, s: Column) -> Column:
        fits = acc["n"] + F.length(s) <= context
        return F.struct(F.when(fits, acc["n"] + F.length(s)).otherwise(acc["n"]).alias("n"), F.when(fits, F.concat(acc["kept"], F.array(F.trim(s)))).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate("telling", start, add, lambda acc: acc["kept"])
    told = asked.withColumn("telling", telling).withColumn("kept", kept)
    about = F.when(F.size("kept") > 0, F.concat(F.array_join("kept", ". "), F.lit("."))).otherwise(F.left("text", F.lit(context)))
    return told.withColumn("answer", F.when(F.size("telling") > 0, first).otherwise(canned)).withColumn("context", about).drop("telling", "kept")


def edge_cases(asked: DataFrame, *, one_in: int = 10) -> DataFrame:
    """doc_id, question, answer: edge questions about the topics of the tenth of `asked` with the least hashes."""
    chosen = asked.where(draw(F.col("doc_id"), "edge") < 2**32 // one_in)
    pattern = drawn(EDGE_CASES, draw(F.col("doc_id"), "pattern"))
    return chosen.select("doc_id", filled(pattern, topic=F.col("topic")).alias("question"), filled(F.lit(EDGE_ANSWER), topic=F.col("topic")).alias("answer"))


def negatives(pairs: DataFrame, *, parts: int = 64, largest: int = 50_000) -> DataFrame:
    """doc_id, question, answer, other_id, context: every question beside the context of another pair: the next in order of
    a hash, in a circle within each part of the pairs; a part of one pair gives none. There are `parts` parts, or as many as
    keep them at about `largest` pairs."""
    parts = max(parts, -(-pairs.count() // largest))
    order = F.md5(F.concat(F.lit("42|negative|"), F.col("doc_id").cast("string")))
    part = F.pmod(F.col("doc_id"), F.lit(parts))
    window = Window.partitionBy("part").orderBy("order", "doc_id")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = pairs.withColumn("part", part).withColumn("order", order)
    ahead = lambda c: F.coalesce(F.lead(c).over(window), F.first(c).over(whole))
    reply = filled(drawn(NEGATIVES, draw(F.col("doc_id"), "reply")), topic=F.col("topic"), answer=F.lit("the requested information"))
    beside = placed.select("doc_id", "question", reply.alias("answer"), ahead("doc_id").alias("other_id"), ahead("context").alias("context"))
    return beside.where("other_id <> doc_id")


def paraphrases(asked: DataFrame, *, copies: int = 2) -> DataFrame:
    """doc_id, copy, question: the question with the first known phrase it holds put otherwise, as often as asked for; none
    for a question that holds none."""
    new = F.lit(None).cast("string")
    for phrase, other in reversed(list(PARAPHRASES.items())):
        new = F.when(F.contains(F.lower("question"), F.lit(phrase.lower())), F.regexp_replace("question", f"(?i){phrase}", other)).otherwise(new)
    changed = asked.select("doc_id", "question", new.alias("new")).where("new <> question")
    return changed.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), F.col("new").alias("question"))


def counted(pairs: DataFrame) -> DataFrame:
    """field, value, n, question_length, answer_length: pairs by difficulty and by type and in all, and mean lengths."""
    rows = pairs.groupingSets([[F.col("difficulty")], [F.col("question_type")], []], "difficulty", "question_type").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg(F.length("question")), 6).alias("question_length"), F.round(F.avg(F.length("answer")), 6).alias("answer_length")
    )
    field = F.when(F.col("g") == 1, "difficulty").when(F.col("g") == 2, "question_type").otherwise("all")
    return rows.select(field.alias("field"), F.coalesce("difficulty", "question_type", F.lit("all")).alias("value"), "n", "question_length", "answer_length")


def split(rows: DataFrame, key: str, *, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """`rows` with split: train, validation or test by a hash of `key`, each row by itself, so that shares are about as asked for."""
    unit = draw(F.col(key), "split") / 2**32
    return rows.withColumn("split", F.when(unit < train, "train").when(unit < train + validation, "validation").otherwise("test"))


def split_quality(pairs: DataFrame) -> DataFrame:
    """split, n, completeness, diversity, balance, unique_questions, overall of `pairs` (split, question, answer, context, category)."""
    filled_in = F.avg(F.when((F.trim("question") != "") & (F.trim("answer") != "") & (F.trim("context") != ""), 1.0).otherwise(0.0))
    base = pairs.groupBy("split").agg(F.count("*").alias("n"), filled_in.alias("completeness"), (F.count_distinct("question") / F.count("*")).alias("unique_questions"))
    words = pairs.select("split", F.explode(F.array_remove(F.split(F.lower(F.concat_ws(" ", "question", "answer")), r"\s+"), "")).alias("w"))
    diverse = words.groupBy("split").agg(F.least(F.lit(1.0), 2 * F.count_distinct("w") / F.count("*")).alias("diversity"))
    sizes = pairs.groupBy("split", "category").agg(F.count("*").alias("n"))
    balance = sizes.groupBy("split").agg(F.greatest(F.lit(0.0), 1 - F.stddev_pop("n") / F.avg("n")).alias("balance"))
    joined = base.join(diverse, "split", "left").join(balance, "split").select("split", "n", "completeness", F.coalesce("diversity", F.lit(0.0)).alias("diversity"), "balance", "unique_questions")
    overall = 0.3 * F.col("completeness") + 0.25 * F.col("diversity") + 0.25 * F.col("balance") + 0.2 * F.col("unique_questions")
    return joined.withColumn("overall", overall)


def validated(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """n_issues, n_warnings, valid, grade of a dataset by its splits' quality and the leaks (`hits`) into its training set.

    Issues: an empty split, leakage above 0.3, a completeness below 0.8. Warnings: some leakage, a difficulty or type three
    times as frequent as another in training, a diversity below 0.5 there. An issue is grade F; a warning costs 0.05.
    """
    quality = split_quality(pairs)
    of = lambda name, c, none: F.coalesce(F.max(F.when(F.col("split") == name, F.col(c))), F.lit(none))
    sides = quality.agg(
        F.avg("overall").alias("mean"), F.count_if(F.col("completeness") < 0.8).alias("low"), F.count("*").alias("present"), F.sum(F.when(F.col("split") != "train", F.col("n")).otherwise(0)).alias("held_out"), of("train", "diversity", 1.0).alias("diversity")
    )
    training = pairs.where(F.col("split") == "train")
    spread = lambda c: training.groupBy(c).agg(F.count("*").alias("n")).agg((F.max("n") > 3 * F.min("n")).alias(f"skew_{c}"))
    one = sides.crossJoin(hits.agg(F.count("*").alias("hits"))).crossJoin(spread("difficulty")).crossJoin(spread("question_type"))  # rows of one
    leak = F.when(F.col("held_out") > 0, F.least(F.lit(1.0), F.col("hits") / F.col("held_out"))).otherwise(F.lit(0.0))
    ones = lambda *tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    issues = (3 - F.col("present")) + F.col("low") + ones(leak > 0.3)
    warnings = ones((leak > 0) & (leak <= 0.3), F.col("skew_difficulty"), F.col("skew_question_type"), F.col("diversity") < 0.5)
    judged = one.select(issues.cast("long").alias("n_issues"), warnings.cast("long").alias("n_warnings"), "mean")
    mark = F.when(F.col("n_issues") > 0, "F").otherwise(grade(F.greatest(F.lit(0.0), F.col("mean") - 0.05 * F.col("n_warnings"))))
    return judged.select("n_issues", "n_warnings", (F.col("n_issues") == 0).alias("valid"), mark.alias("grade"))


def section_questions(docs: DataFrame, *, most: int = 5, shortest: int = 10, longest: int = 4096) -> DataFrame:
    """doc_id, place, question, answer: a question for each of a text's first sections that are of valid length."""
    each = docs.select("doc_id", F.posexplode(F.slice(agents.sections(F.col("text")), 1, most)).alias("place", "answer"))
    topic = F.concat(F.array_join(F.slice(F.array_remove(F.split("answer", r"\s+"), ""), 1, 10), " "), F.lit("..."))
    prefix = drawn(QUESTIONS, draw(F.concat_ws(":", "doc_id", "place"), "prefix"))
    return each.where(F.length("answer").between(shortest, longest)).select("doc_id", "place", F.concat(prefix, F.lit("\n\n"), topic).alias("question"), "answer")


def shares(pairs: DataFrame) -> DataFrame:
    """split, n, question_length, answer_length, context_length, share: sizes and mean lengths of a dataset's splits."""
    mean = [F.round(F.avg(F.length(c)), 6).alias(f"{c}_length") for c in ("question", "answer", "context")]
    sizes = pairs.groupBy("split").agg(F.count("*").alias("n"), *mean)
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return sizes.withColumn("share", F.round(F.col("n") / total, 6))
