"""Prompt templates: named texts with {variables}, and examples for training that are made from them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIABLE = re.compile(r"\{(\w+)\}")
# The templates that are there from the start.
TEMPLATES = {
    "rag_qa": "Use the context below to answer the question.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "rag_summarize": "Summarize the following content concisely:\n\n{context}\n\nSummary:",
    "document_analysis": "Analyze this document and extract key information:\n\nDocument: {filename}\nContent:\n{context}\n\nProvide:\n1. Summary\n2. Key Points\n3. Important Entities\n4. Document Type",
}
NO_HISTORY = "No previous conversation."
LONGEST_INPUT, LONGEST_OUTPUT = 4096, 2048


class Registry:
    """Templates by name; a new one under an old name takes its place."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES):
        self.templates = dict(templates)

    def register(self, name: str, template: str) -> None:
        self.templates[name] = template

    def variables(self, name: str) -> list[str]:
        """The variables of a template in the order of their first places."""
        if name not in self.templates:
            raise KeyError(f"no template {name}")
        return list(dict.fromkeys(VARIABLE.findall(self.templates[name])))

    def build(self, name: str, **given: Column) -> Column:
        """The template with columns in the places of its variables; a null one is empty. Variables that are not given are
        an error before anything runs."""
        missing = [v for v in self.variables(name) if v not in given]
        if missing:
            raise ValueError(f"template {name} lacks {', '.join(missing)}")
        parts, at, text = [], 0, self.templates[name]
        for m in VARIABLE.finditer(text):
            parts += [F.lit(text[at : m.start()]), F.coalesce(given[m[1]].cast("string"), F.lit(""))]
            at = m.end()
        return F.concat(*parts, F.lit(text[at:]))

    def missing(self, name: str, given: Column) -> Column:
        """The variables of a template that a map of names to values lacks, in order; of a null map, all."""
        return F.array_except(F.array(*map(F.lit, self.variables(name))), F.coalesce(F.map_keys(given), F.array().cast("array<string>")))


def joined_context(chunks: Column, *, separator: str = "\n\n---\n\n", most: int = 4000) -> Column:
    """Chunks as one text, cut with "..." beyond `most` characters; none give an empty text."""
    text = F.array_join(F.coalesce(chunks, F.array().cast("array<string>")), separator)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def valid(question: Column, answer: Column) -> Column:
    """Whether a training example has an input of 10 to 4,096 characters and an output of 5 to 2,048, neither blank."""
    inside = F.length(question).between(10, LONGEST_INPUT) & F.length(answer).between(5, LONGEST_OUTPUT)
    return F.coalesce(inside & (F.trim(question) != "") & (F.trim(answer) != ""), F.lit(False))


def summarization_examples(docs: DataFrame, summary: Column) -> DataFrame:
    """doc_id, input, output: a request to sum up the first 4,096 characters of each of `docs` (doc_id, text), and its summary.
    Null texts are empty."""
    text = F.left(F.coalesce("text", F.lit("")), F.lit(LONGEST_INPUT))
    return docs.select("doc_id", F.concat(F.lit("Summarize the following document:\n\n"), text).alias("input"), summary.alias("output"))


def extraction_examples(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, type, input, output: for each kind of entity in a document a request to extract them and the answer in JSON.

    `found` has doc_id, type, start_pos and hit. Entities come by their places; characters beyond ASCII stay as they are.
    Examples that are not `valid` are left out.
    """
    listed = found.groupBy("doc_id", "type").agg(F.sort_array(F.collect_list(F.struct("start_pos", "hit")))["hit"].alias("hits"))  # of one document
    quoted = F.transform("hits", lambda h: F.regexp_replace(F.to_json(F.array(h)), r"^\[|\]$", ""))
    answer = F.concat(F.lit('{\n  "'), "type", F.lit('": [\n    '), F.array_join(quoted, ",\n    "), F.lit("\n  ]\n}"))
    request = F.concat(F.lit("Extract all "), "type", F.lit(" from the following document:\n\n"), F.left("text", F.lit(LONGEST_INPUT)))
    made = listed.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "type", request.alias("input"), answer.alias("output"))
    return made.where(valid(F.col("input"), F.col("output")))
