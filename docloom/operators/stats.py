"""Profiles, counters, histograms and rates as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in seconds.
LATENCY = [0.1, 0.5, 1, 2.5, 5, 10, 30, 60, 120]


def grade(score: Column) -> Column:
    """A from 0.9, B from 0.8, C from 0.7, D from 0.6, else F."""
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def profile_columns(table: DataFrame) -> DataFrame:
    """column_name, total, nulls, different values, and completeness and uniqueness of each column, in one pass.

    Null, '' and 'null' count as null. Values are compared as strings.
    """
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in table.columns]
    long = table.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    absent = F.col("value").isNull() | F.col("value").isin("", "null")
    counts = long.groupBy("column_name").agg(F.count("*").alias("total"), F.count_if(absent).alias("nulls"), F.count_distinct(F.when(~absent, F.col("value"))).alias("different"))
    present = F.col("total") - F.col("nulls")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return counts.select("column_name", "total", "nulls", "different", ratio(present, F.col("total")).alias("completeness"), ratio(F.col("different"), present).alias("uniqueness"))


def numeric_profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, least, most, mean and sample deviation of numeric columns, in one pass."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    long = table.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return long.groupBy("column_name").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("deviation"))


def histogram(events: DataFrame, value: str, label: str, bounds: list[float]) -> DataFrame:
    """label, le, n: cumulative counts of values up to each bound, and in all."""
    pairs = [F.struct(F.lit(f"{b:g}").alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    counts = events.groupBy(label).agg(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n"))).alias("b"))
    return counts.select(label, F.explode("b").alias("b")).select(label, "b.le", "b.n")


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def indexed_quantiles(events: DataFrame, value: str, label: str) -> DataFrame:
    """p50, p95 and p99 as the value at index floor(n * q) of the sorted positive values, by label, and 1 / mean.

    Values are counted first, each different one once, and these counts are cut into ranges at approximate quantiles of
    each label; only the range that holds an index is ranked, so no label's values gather in one task.
    """
    positive = events.where(F.col(value) > 0).select(label, F.col(value).alias("v"))
    bounds = positive.groupBy(label).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile_approx("v", F.array(*(F.lit(i / 64) for i in range(1, 64))), 10_000).alias("bounds"))
    counts = positive.groupBy(label, "v").agg(F.count("*").alias("c")).join(F.broadcast(bounds.select(label, "bounds")), label)  # a row for each label
    ranged = counts.withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")
    sizes = ranged.groupBy(label, "range").agg(F.sum("c").alias("size"))
    before = F.sum("size").over(Window.partitionBy(label).orderBy("range")) - F.col("size")
    placed = sizes.withColumn("before", before).join(bounds.select(label, "n", "mean"), label)
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1).alias("i")) for p, q in QUANTILES.items())))
    asked = placed.select(label, "range", "before", "size", "mean", wanted.alias("w")).where("w.i >= before and w.i < before + size")
    upto = F.sum("c").over(Window.partitionBy(label, "range").orderBy("v"))
    ranked = ranged.join(F.broadcast(asked.select(label, "range").distinct()), [label, "range"], "left_semi").withColumn("upto", upto)  # three ranges for each label at most
    found = ranked.join(asked, [label, "range"]).where("w.i < before + upto and w.i >= before + upto - c")
    return found.groupBy(label).agg(*(F.max(F.when(F.col("w.p") == p, F.col("v"))).alias(p) for p in QUANTILES), F.round(1 / F.max("mean"), 6).alias("throughput"))


def bucket_quantile(counts: DataFrame, groups: list[str], q: float) -> DataFrame:
    """The groups and value: the quantile of cumulative bucket counts (le, n; le null for the last, unbounded one), by linear
    interpolation inside the bucket that holds it; the greatest bound if that is the unbounded one."""
    order = Window.partitionBy(*groups).orderBy(F.col("le").asc_nulls_last())
    total = F.max("n").over(Window.partitionBy(*groups))
    known = counts.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("rank", F.lit(q) * total)
    held = known.where((F.col("n") >= F.col("rank")) & (F.col("before") < F.col("rank")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before"))
    return held.select(*groups, F.round(F.when(F.col("le").isNull(), F.col("low")).otherwise(inside), 6).alias("value"))


def over_limit(events: DataFrame, limit: int, width: str = "1 minute") -> DataFrame:
    """Users and windows of time with more than `limit` events."""
    return events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tn, fp, fn, tp, accuracy, precision and recall; a ratio over nothing is 0."""
    count = lambda t, p: F.count_if((truth == t) & (predicted == p))
    c = rows.agg(count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    return c.select("tn", "fp", "fn", "tp", ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def counts_by(table: DataFrame, *sets: str) -> DataFrame:
    """field, value, n for several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in sets))
    return table.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n")).select("field", "value", "n")


def sizes_by(table: DataFrame, size: str, mean: str, *sets: str) -> DataFrame:
    """field, value, n, total, mean quality of each value of several columns, and of all rows, in one pass."""
    pairs = F.array(F.struct(F.lit("all").alias("field"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in sets))
    rows = table.select(size, mean, F.explode(pairs).alias("p")).groupBy("p.field", "p.value")
    return rows.agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("total_chars"), F.round(F.avg(mean), 6).alias("mean_quality")).select("field", "value", "n", "total_chars", "mean_quality")
