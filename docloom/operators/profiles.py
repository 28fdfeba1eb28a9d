"""Types and quality of tables, compared and summed up over several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.stats import grade, profile_columns

# Fixed patterns: what counts as a number, and how dates and addresses begin.
NUMBER = r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
BOOLEANS = ["true", "false", "yes", "no", "1", "0"]
# Fixed weights of the four sides of quality.
COMPLETENESS, CONSISTENCY, ACCURACY, VALIDITY = 0.3, 0.25, 0.25, 0.2


def column_types(table: DataFrame, key: str, *, looked_at: int = 100) -> DataFrame:
    """column_name, data_type of the columns of `table`, by the first non-null values in order of `key`.

    Each column is one search for its first values, which reads that column and the key and sorts nothing whole.
    """

    def of(column: str) -> DataFrame:
        value = F.col(column).cast("string")
        first = table.select(key, value.alias("v")).where("v is not null and v not in ('', 'null')").orderBy(key).limit(looked_at)
        share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
        v = F.col("v")
        kind = (
            F.when(F.count("*") == 0, "unknown")
            .when(share(v.rlike(NUMBER)) > 0.8, "numeric")
            .when(share(F.lower(v).isin(*BOOLEANS)) > 0.8, "boolean")
            .when(share(v.rlike(DATE)) > 0.5, "date")
            .when(share(v.rlike(EMAIL)) > 0.5, "email")
            .otherwise("string")
        )
        return first.agg(kind.alias("data_type")).select(F.lit(column).alias("column_name"), "data_type")

    return reduce(DataFrame.unionByName, map(of, table.columns))


def quality(table: DataFrame, key: str, name: str) -> DataFrame:
    """name, n_rows, n_columns, completeness, consistency, validity, accuracy, overall, grade: one row for a table."""
    columns = profile_columns(table).join(column_types(table, key), "column_name")
    completeness = F.avg("completeness")
    known = F.avg(F.when(F.col("data_type") == "unknown", 0.5).otherwise(0.9))
    sides = columns.agg(F.max("total").alias("n_rows"), F.count("*").alias("n_columns"), completeness.alias("completeness"), known.alias("consistency"), (0.9 * completeness + 0.1).alias("validity"))
    overall = COMPLETENESS * F.col("completeness") + CONSISTENCY * F.col("consistency") + ACCURACY * F.lit(0.7) + VALIDITY * F.col("validity")
    rounded = [F.round(c, 6).alias(c) for c in ("completeness", "consistency", "validity")]
    return sides.select(F.lit(name).alias("name"), "n_rows", "n_columns", *rounded, F.lit(0.7).alias("accuracy"), F.round(overall, 6).alias("overall"), grade(overall).alias("grade"))


def compared(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both names, and the differences of two qualities of one row each."""
    a, b = (q.select(*(F.col(c).alias(f"{c}_{x}") for c in q.columns)) for q, x in ((one, "a"), (other, "b")))
    less = lambda c: F.col(f"{c}_a") - F.col(f"{c}_b")
    both = a.crossJoin(b)  # one row by one row
    return both.select("name_a", "name_b", *(F.round(less(c), 6).alias(f"{c}_diff") for c in ("completeness", "consistency", "overall")), *(less(c).alias(f"{c}_diff") for c in ("n_rows", "n_columns")))


def summed_up(qualities: DataFrame) -> DataFrame:
    """How many tables, their mean quality, all rows, and how many are excellent, good, fair and poor."""
    overall: Column = F.col("overall")
    return qualities.agg(
        F.count("*").alias("n_sources"), F.round(F.avg(overall), 6).alias("average_quality"), F.sum("n_rows").alias("total_rows"),
        F.count_if(overall >= 0.9).alias("excellent"), F.count_if((overall >= 0.8) & (overall < 0.9)).alias("good"),
        F.count_if((overall >= 0.7) & (overall < 0.8)).alias("fair"), F.count_if(overall < 0.7).alias("poor"),
    )


def json_profile(rows: DataFrame, column: str) -> DataFrame:
    """key, n, n_null, n_different: the keys of the JSON objects in a column, their null values and different ones.

    Texts that are no JSON object have no keys.
    """
    parsed = rows.select(F.from_json(column, "map<string,string>").alias("m"))
    each = parsed.select(F.explode("m").alias("key", "value"))
    absent = F.col("value").isNull() | F.col("value").isin("", "null")
    return each.groupBy("key").agg(F.count("*").alias("n"), F.count_if(absent).alias("n_null"), F.count_distinct(F.when(~absent, F.col("value"))).alias("n_different"))
