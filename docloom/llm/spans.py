"""Character spans of regular expressions, by DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,stop:int,hit:string>>"
BLOCK = 128  #: matches that are placed together


def find(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, stop, hit>>, in code points.

    `split` gives the text between matches, so a match begins after the pieces and matches before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    step = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.from_json(F.lit("[]"), SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def add(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        after = first + F.length(x["hit"])
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), after.alias("stop"), x["hit"].alias("hit"))
        return F.struct(after.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    # An array that grows by one is copied each time, so matches are placed within blocks and the blocks one after another.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(step, b * BLOCK + 1, BLOCK), start, add))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def follow(acc: Column, block: Column) -> Column:
        moved = F.transform(
            block["found"],
            lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + acc["at"]).alias("stop"), s["hit"].alias("hit")),
        )
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    return F.when(text.rlike(pattern), F.flatten(F.aggregate(blocks, begin, follow, lambda acc: acc["found"]))).otherwise(none)


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:stop, comma-joined, in the given order."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def together(*arrays: Column) -> Column:
    """All spans by start, then kind."""
    return F.sort_array(reduce(lambda a, b: F.concat(a, b), arrays))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span replaced by `mask`; overlapping and touching spans become one mask. Spans are by start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = (s["start"] > acc["at"]) | (F.size(acc["out"]) == 0)
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
