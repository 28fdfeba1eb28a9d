"""Places of regular-expression matches, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, hit>> of the leftmost non-overlapping matches, in characters.

    `split` gives what stands between matches, so a match begins after the pieces and matches before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    steps = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,hit:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit")))).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda acc: acc["found"])).otherwise(none)
