"""Text lines of unlike rows: CSV lines that are short, long or broken, and JSON objects each with keys of its own.

Both are profiled as long rows (column, value) in one pass, whatever the number of columns. Values are counted by column
and value first, so a value that is in every row is no hot key.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_rows(lines: DataFrame, header: str, *, separator: str = ",") -> DataFrame:
    """`_problem` and the header's columns as strings, for each of `lines` (line); null and blank lines are no rows.

    Fields that a short line lacks are null, and so are empty ones; fields beyond the header are left out. `_problem` is
    "short", "long", "broken" (a quote is left open; Spark's permissive parser says what its fields are) or null. Names that
    a header has twice are told apart by a number. A field does not run over several lines.
    """
    names: list[str] = []
    for name in next(csv.reader([header], delimiter=separator)):
        names.append(name if name not in names else f"{name}_{len(names)}")
    quoteless = F.regexp_replace("line", r'"(?:[^"]|"")*"', "")
    fields = F.regexp_count(quoteless, F.lit(re.escape(separator))) + 1
    problem = F.when(F.contains(quoteless, F.lit('"')), "broken").when(fields < len(names), "short").when(fields > len(names), "long")
    # One field more than the header's takes what is beyond them, so that the parser has no line to refuse.
    schema = ", ".join(f"`{i}` string" for i in range(len(names) + 1))
    parsed = F.from_csv("line", schema, {"sep": separator, "mode": "PERMISSIVE", "escape": '"'})
    rows = lines.where(F.trim("line") != "").select(problem.alias("_problem"), parsed.alias("c"))
    return rows.select("_problem", *(F.col("c")[str(i)].alias(name) for i, name in enumerate(names)))


def problems(rows: DataFrame) -> DataFrame:
    """problem, n: how many of `csv_rows` are good, short, long or broken."""
    return rows.groupBy(F.coalesce("_problem", F.lit("good")).alias("problem")).agg(F.count("*").alias("n"))


def _profiled(absent: Column) -> list[Column]:
    """Columns of a profile of rows (column, value, n), where n rows have that value."""
    n, kept = F.col("n"), F.when(~absent, F.col("value"))
    return [
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(absent, n)), F.lit(0)).alias("nulls"),
        F.count(kept).alias("different"),
        F.min(kept).alias("least"),
        F.max(kept).alias("most"),
    ]


def profile_csv(rows: DataFrame) -> DataFrame:
    """column_name, total, nulls, different, least, most, completeness, uniqueness of the columns of `csv_rows`.

    Null, empty and "null" fields count as null. A table without rows has no columns to tell of.
    """
    names = [c for c in rows.columns if c != "_problem"]
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in names))).alias("e")).select("e.*")
    counted = each.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    absent = F.col("value").isNull() | F.col("value").isin("", "null")
    return _shares(counted.groupBy("column_name").agg(*_profiled(absent)))


def _shares(profile: DataFrame) -> DataFrame:
    there = F.col("total") - F.col("nulls")
    complete = F.when(F.col("total") > 0, there / F.col("total")).otherwise(0.0)
    unique = F.when(there > 0, F.col("different") / there).otherwise(0.0)
    return profile.withColumns({"completeness": F.round(complete, 6), "uniqueness": F.round(unique, 6)})


def json_objects(lines: DataFrame) -> DataFrame:
    """object: the JSON objects of `lines` (line) as variants, one for each line that is an object and for each object in a
    line that is a list. Lines that are no JSON, or neither of these, have none."""
    spark = lines.sparkSession
    parsed = lines.select(F.try_parse_json("line").alias("v")).where("v is not null")
    listed = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    members = parsed.where(listed).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("object"))
    every = parsed.where(~listed).select(F.col("v").alias("object")).unionByName(members)
    return every.where(F.startswith(F.schema_of_variant("object"), F.lit("OBJECT")))


def profile_json(lines: DataFrame) -> DataFrame:
    """column_name, total, nulls, different, least, most, types, completeness, uniqueness: the union of the keys of all JSON
    objects in `lines` (line).

    An object without a key counts as a null there, as do null, empty and "null" values. `types` are the types that a key
    has, in order.
    """
    spark = lines.sparkSession
    objects = json_objects(lines)
    each = objects.lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).select("key", "value")
    typed = each.select(F.col("key").alias("column_name"), F.schema_of_variant("value").alias("type"), F.col("value").cast("string").alias("value"))
    counted = typed.groupBy("column_name", "type", "value").agg(F.count("*").alias("n"))
    absent = F.col("value").isNull() | F.col("value").isin("", "null")
    types = F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types")  # of a fixed number
    present = counted.groupBy("column_name").agg(*_profiled(absent), types)
    rows = objects.agg(F.count("*").alias("rows"))  # one row
    whole = present.crossJoin(rows).withColumn("nulls", F.col("nulls") + F.col("rows") - F.col("total")).withColumn("total", F.col("rows")).drop("rows")
    return _shares(whole)
