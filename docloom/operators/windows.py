"""Conversation windows, context filling, stratified splits and cache intervals, by Spark window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_messages(messages: DataFrame, *, last: int = 10, tokens: int = 4000) -> DataFrame:
    """The newest messages of each conversation (conv_id, turn, role, text): at most `last`, while their characters fit
    in 4 * tokens. The running sum never falls, so the first message that does not fit ends the window."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    ranked = messages.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= last)
    running = F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("chars", running).where(F.col("chars") <= 4 * tokens).select("conv_id", "turn", "role", F.col("chars").cast("long").alias("chars"))


def session_summary(messages: DataFrame) -> DataFrame:
    """Messages, first and last turn, and messages by each role, of every conversation."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant")
    )


def combine_context(chunks: DataFrame, *, most: int = 4000) -> DataFrame:
    """How much of each ranked chunk (group_id, rank, text) goes into its group's context: whole while it fits, 2 for a
    separator; the first that does not fit is cut if over 100 characters are left, and the rest is left out."""
    order = Window.partitionBy("group_id").orderBy("rank")
    upto = F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sized = chunks.withColumn("upto", upto).withColumn("before", F.col("upto") - F.length("text") - 2)
    left = F.lit(most) - F.col("before")
    used = F.when(F.col("upto") <= most, F.length("text")).when((F.col("before") <= most) & (left > 100), left).otherwise(0)
    whole = sized.withColumn("used", used.cast("long")).withColumn("spilt", F.col("upto") > most)
    first = F.sum(F.col("spilt").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) <= 1
    return whole.withColumn("first", first).where("used > 0 and first").select("group_id", "rank", "used")


def contexts(chunks: DataFrame, *, part: int = 1000) -> DataFrame:
    """group_id, rank, place, n, chunk_md5, context_md5: the chunks of each context in order of `chunks` (group_id, rank,
    chunk_md5), ranks being numbers: the place from 1, how many the context has, and a digest of all of them in that order.

    A context is cut into parts of `part` ranks, so that none gathers in one task. The digest of a part is the MD5 of its
    chunks' digests, null ones empty, and that of a context the MD5 of its parts' digests, one to a line. Of equal ranks the
    lesser digest is first. Nulls, be they ranks or contexts, are a value of their own.
    """
    sorted_chunks = F.sort_array(F.collect_list(F.struct("rank", "chunk_md5")))
    parts = chunks.groupBy("group_id", F.floor(F.col("rank") / part).alias("_part")).agg(sorted_chunks.alias("_chunks"))
    lines = F.array_join(F.transform("_chunks.chunk_md5", lambda m: F.coalesce(m, F.lit(""))), "\n")
    # Of the parts only these narrow rows go by whole contexts.
    sizes = parts.select("group_id", "_part", F.size("_chunks").cast("long").alias("_c"), F.md5(lines).alias("_md5"))
    before = F.sum("_c").over(Window.partitionBy("group_id").orderBy("_part")) - F.col("_c")
    begun = sizes.select(F.col("group_id").alias("_group"), F.col("_part").alias("_at"), before.alias("_before"))
    digest = F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("_part", "_md5")))["_md5"], "\n"))
    whole = sizes.groupBy(F.col("group_id").alias("_whole")).agg(F.sum("_c").alias("n"), digest.alias("context_md5"))
    placed = parts.join(begun, F.col("group_id").eqNullSafe(F.col("_group")) & F.col("_part").eqNullSafe(F.col("_at"))).join(whole, F.col("group_id").eqNullSafe(F.col("_whole")))
    each = placed.select("group_id", "_before", "n", "context_md5", F.posexplode("_chunks").alias("_i", "_chunk"))
    return each.select("group_id", "_chunk.rank", (F.col("_before") + F.col("_i") + 1).alias("place"), "n", "_chunk.chunk_md5", "context_md5")


def stratified_split(rows: DataFrame, stratum: str, key: str, *, train: float = 0.7, validation: float = 0.15, seed: str = "42") -> DataFrame:
    """`key`, stratum and split: in every stratum the first floor(n * train) rows by md5(seed, key) train, the next
    floor(n * validation) validate, the rest test.

    Rows are counted by stratum and the first three hexadecimal digits of their hash. A running sum of these small counts
    says where each such part begins, and rows are ranked within their part alone, so that no stratum gathers in one task.
    """
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))
    hashed = rows.select(key, stratum, digest.alias("_digest")).withColumn("_part", F.left("_digest", F.lit(3)))
    parts = hashed.groupBy(stratum, "_part").agg(F.count("*").alias("_c"))  # at most 4,096 for each stratum
    ordered = Window.partitionBy(stratum).orderBy("_part")
    begun = parts.withColumn("_before", F.sum("_c").over(ordered) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(stratum))).withColumnRenamed(stratum, "_stratum")
    within = F.row_number().over(Window.partitionBy(stratum, "_part").orderBy("_digest", key))
    ranked = hashed.withColumn("_r", within)
    placed = ranked.join(begun, (ranked["_part"] == begun["_part"]) & ranked[stratum].eqNullSafe(begun["_stratum"]))
    at, first, second = F.col("_before") + F.col("_r"), F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(validation))
    return placed.select(key, stratum, F.when(at <= first, "train").when(at <= first + second, "validation").otherwise("test").alias("split"))


def access_intervals(events: DataFrame) -> DataFrame:
    """For each user the mean of the last 10 intervals between events, in seconds, and the TTL class it falls in."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = events.select("user_id", gap.alias("gap"), F.row_number().over(newest).alias("age")).where("gap is not null and age <= 10")
    mean = F.avg("gap")
    level = F.when(mean < 60, "hot").when(mean < 300, "warm").when(mean < 3600, "cool").otherwise("cold")
    return last.groupBy("user_id").agg(F.round(mean, 6).alias("mean_gap"), level.alias("pattern"))


def first_of_each(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """The first row by `order` of every group of rows alike in `content`; groups are put together before the shuffle."""
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    first = rows.select(F.md5(content).alias("_content"), F.col(order).alias("_order"), row.alias("_row")).groupBy("_content").agg(F.min_by("_row", "_order").alias("_row"))
    return first.select(*(F.col("_row").getField(c).alias(c) for c in rows.columns))
