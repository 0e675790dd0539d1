"""Usage analytics: one row a call, aggregated by tool, path and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def p50(value: str) -> Column:
    """The median, the mean of the middle two of an even number."""
    return F.percentile(value, F.lit(0.5))


def per_second(n: Column, seconds: Column) -> Column:
    """Throughput; null if no time was spent."""
    return F.when(seconds > 0, n / seconds)


def since(usage: DataFrame, when: str | None) -> DataFrame:
    """Calls at or after a time; a bare date is midnight UTC."""
    return usage if when is None else usage.where(F.col("ts") >= F.lit(when).cast("timestamp_ntz"))


def p95_usage(n: Column) -> Column:
    return F.least(n - 1, F.floor(n * 0.95))


def p95_eval(n: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(n * 0.95) - 1)


def p95_bench(n: Column) -> Column:
    """Nearest rank by rounding half to even, then clamped."""
    return F.greatest(F.lit(1), F.least(n, F.bround(n * 0.95 + 0.5))) - 1


def p95_support(n: Column) -> Column:
    return F.least(n - 1, F.floor((n - 1) * 0.95 + 0.999))


def percentile_at(df: DataFrame, by: list[str], value: str, pick, buckets: int = 1024) -> DataFrame:
    """(by, value): the exact order statistic that ``pick`` chooses from the count; nulls do not count.

    The range of a group is cut into equal buckets whose counts tell in which the
    place lies; only its values are then counted and summed in order, so a hot
    group is neither collected nor sorted in one task.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    ends = rows.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count("*").alias("_n"))
    share = (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a"))
    placed = rows.join(ends, by).withColumn("_k", F.when(F.col("_b") > F.col("_a"), F.least(F.lit(buckets - 1), F.floor(share * buckets))).otherwise(0).cast("int"))
    order = Window.partitionBy(*by).orderBy("_k")
    sums = placed.groupBy(*by, "_k", "_n").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(order))
    there = sums.where(F.col("_upto") > pick(F.col("_n"))).groupBy(*by).agg(F.min(F.struct("_k", "_upto", "_c")).alias("_t"))
    there = there.select(*by, F.col("_t._k").alias("_k"), (F.col("_t._upto") - F.col("_t._c")).alias("_before"))
    counts = placed.join(there, [*by, "_k"]).groupBy(*by, value, "_n", "_before").agg(F.count("*").alias("_c"))
    summed = counts.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by).orderBy(value)))
    return summed.where(F.col("_upto") > pick(F.col("_n"))).groupBy(*by).agg(F.min(value).alias(value))


def tool_report(usage: DataFrame, when: str | None = None) -> DataFrame:
    """(tool, calls, avg_latency, p95_latency, tokens, expands) of calls at or after ``when``.

    A bare date is midnight UTC.  Tools come with the 95th percentile that takes
    the value at ``0.95 n`` of the sorted latencies.
    """
    rows = since(usage, when)
    totals = rows.groupBy("tool").agg(
        F.count("*").alias("calls"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.count_if(F.col("expanded")).alias("expands"),
    )
    p95 = percentile_at(rows, ["tool"], "latency_ms", p95_usage).withColumnRenamed("latency_ms", "p95_latency")
    return totals.join(p95, "tool", "left").select("tool", "calls", "avg_latency", "p95_latency", "tokens", "expands")


def path_report(usage: DataFrame) -> DataFrame:
    """(path_taken, calls, avg_latency): by the way a search went, ``n/a`` for calls without one."""
    return usage.groupBy(F.coalesce("path_taken", F.lit("n/a")).alias("path_taken")).agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"))


def expand_rate(usage: DataFrame) -> DataFrame:
    """(searches, expands, expand_rate), one row; the rate is 0 without a search."""
    n = usage.agg(F.count_if(~F.coalesce("expanded", F.lit(False))).alias("searches"), F.count_if(F.col("expanded")).alias("expands"))
    return n.withColumn("expand_rate", F.when(F.col("searches") > 0, F.col("expands") / F.col("searches")).otherwise(0.0))


def daily_calls(usage: DataFrame) -> DataFrame:
    """(day, tool, calls)."""
    return usage.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count("*").alias("calls"))


def savings(served: DataFrame, sizes: DataFrame) -> DataFrame:
    """(qid, served_tokens, spanned_tokens, avoided): a quarter of the bytes of the files touched, less what was served."""
    spanned = served.select("qid", "blob_hash").distinct().join(sizes, "blob_hash").groupBy("qid").agg(
        F.floor(F.sum("size_bytes") / 4).cast("long").alias("spanned_tokens")
    )
    used = served.groupBy("qid").agg(F.sum("tokens").cast("long").alias("served_tokens"))
    return used.join(spanned, "qid").withColumn("avoided", F.greatest(F.lit(0), F.col("spanned_tokens") - F.col("served_tokens")))
