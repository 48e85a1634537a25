"""Counters: per request, and per ten seconds without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.functions.wire import saved

WINDOW = "10 seconds"
#: Windows in a bucket, while gaps are filled.
SPAN = 8640
COUNTERS = ("events_in", "events_sampled_out", "events_exported", "bytes_in", "bytes_dropped", "bytes_exported", "redaction_count", "failopen_count")


def request_stats(df: DataFrame, bytes_in: Column | None = None, bytes_out: Column | None = None) -> DataFrame:
    """Per request: records, kept, dropped, redactions, bytes in and out, first arrival. bytes_*: of a record, default its body's."""
    size_in = bytes_in if bytes_in is not None else F.coalesce(F.octet_length("body_in"), F.lit(0)).cast("long")
    size_out = bytes_out if bytes_out is not None else F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")
    return df.groupBy("request_id").agg(
        F.min("received_at").alias("received_at"),
        F.count("*").alias("records_in"),
        F.count_if("keep").alias("kept"),
        F.count_if(~F.col("keep")).alias("dropped"),
        F.sum("n_redactions").cast("long").alias("redactions"),
        F.sum(size_in).cast("long").alias("bytes_in"),
        F.coalesce(F.sum(F.when(F.col("keep"), size_out)), F.lit(0)).cast("long").alias("bytes_out"),
    )


def samples(stats: DataFrame) -> DataFrame:
    """Stats of well-formed requests as what an aggregate adds up. A malformed request counts nowhere."""
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in stats.columns else F.lit(False)
    return stats.where(~has("parse_bypassed")).select(
        "received_at", F.col("records_in").alias("events_in"), F.col("dropped").alias("events_sampled_out"), F.col("kept").alias("events_exported"), "bytes_in",
        saved(F.col("bytes_in"), F.col("bytes_out")).alias("bytes_dropped"), F.col("bytes_out").alias("bytes_exported"), F.col("redactions").alias("redaction_count"),
        (has("redact_bypassed") | has("assemble_bypassed")).cast("long").alias("failopen_count"),
    )


def window_start(at: Column, width: str = WINDOW) -> Column:
    """Start of the window (epoch milliseconds) that a time falls in, by arithmetic that needs no expansion of rows."""
    ms = int(width.split()[0]) * 1000
    t = F.unix_millis(at.cast("timestamp"))
    return t - F.pmod(t, F.lit(ms))


def window_aggregate(sampled: DataFrame, width: str = WINDOW) -> DataFrame:
    """Sums per window that has any request: window_start_ms, window_end_ms, counters."""
    ms = int(width.split()[0]) * 1000
    out = sampled.withColumn("window_start_ms", window_start(F.col("received_at"), width)).groupBy("window_start_ms").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])
    return out.select("window_start_ms", (F.col("window_start_ms") + ms).alias("window_end_ms"), *COUNTERS)


def gap_filled(windows: DataFrame, policy_version: int, from_ms: int | None = None, to_ms: int | None = None, width: str = WINDOW) -> DataFrame:
    """Every window from the first (or from_ms) up to the last (or before to_ms), zeros where nothing came, numbered from 0.

    Gaps are made from the windows themselves: each begins a run that reaches up to the next one. Windows that came are few
    beside what they sum up, and are put in order by a range sort whose partitions hand each other their last window.
    """
    ms = int(width.split()[0]) * 1000
    some = windows.drop("window_end_ms")
    if from_ms is not None:
        some = some.where(F.col("window_start_ms") >= from_ms)
    if to_ms is not None:
        some = some.where(F.col("window_start_ms") < to_ms)
    # Who follows whom: within buckets of so many windows, then from bucket to bucket (a row for each).
    bucket = F.floor(F.col("window_start_ms") / (ms * SPAN))
    one = some.withColumn("b", bucket).withColumn("next_ms", F.lead("window_start_ms").over(Window.partitionBy("b").orderBy("window_start_ms")))
    first = some.groupBy(bucket.alias("bb")).agg(F.min("window_start_ms").alias("first_ms"))
    chain = first.withColumn("after_ms", F.lead("first_ms").over(Window.orderBy("bb"))).withColumn("start_ms", F.min("first_ms").over(Window.partitionBy()))
    end = F.lit(to_ms).cast("long")
    one = one.join(chain, F.col("b") == F.col("bb"))
    start = F.lit(from_ms).cast("long") if from_ms is not None else F.col("start_ms")
    last = F.coalesce("next_ms", "after_ms", end, F.col("window_start_ms") + ms)
    lead = F.when(F.col("window_start_ms") == F.col("start_ms"), start).otherwise(F.col("window_start_ms"))
    runs = one.withColumn("at", F.explode(F.sequence(lead, last - ms, F.lit(ms).cast("long"))))
    there = F.col("at") == F.col("window_start_ms")
    return runs.select(
        ((F.col("at") - start) / ms).cast("long").alias("seq"), F.col("at").alias("window_start_ms"), (F.col("at") + ms).alias("window_end_ms"), F.lit(str(policy_version)).cast("decimal(20,0)").alias("policy_version"),
        *[F.when(there, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in COUNTERS],
    )


def as_line(df: DataFrame) -> DataFrame:
    """Each aggregate as one line of key=value, numbers only."""
    return df.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns]).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def now_ms() -> Column:
    """Epoch milliseconds of the query's beginning."""
    return F.unix_millis(F.current_timestamp())


def percentile(df: DataFrame, column: str, p: float, exact_rank: bool = False) -> DataFrame:
    """The p-th percentile: interpolated between the two values next to (n - 1) p, or the value at the nearest rank round((n - 1) p).

    Neither gathers values: different ones are counted and sorted by range, and the ranks sought are found in one or two ranges.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    if not total:
        return df.agg(F.max(column).alias("value"))
    place = (total - 1) * p
    if exact_rank:
        return _at_rank(counts, column, int(place + 0.5))
    low = int(place)
    if low == place:
        return _at_rank(counts, column, low).select(F.col("value").cast("double").alias("value"))
    ends = _at_rank(counts, column, low).select(F.col("value").alias("a")).crossJoin(_at_rank(counts, column, low + 1).select(F.col("value").alias("b")))  # one row each
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.lit(place - low)).cast("double").alias("value"))


def _at_rank(counts: DataFrame, column: str, rank: int) -> DataFrame:
    """The value with this rank, from 0, of values with their counts."""
    # Ranks of different values, by the sums of range partitions: a window over all rows would be one task.
    ordered = counts.repartitionByRange(column).withColumn("part", F.spark_partition_id())
    seen, part = 0, None
    for r in ordered.groupBy("part").agg(F.sum("n").alias("size")).orderBy("part").collect():  # a row for each partition
        if seen + r["size"] > rank:
            part = r["part"]
            break
        seen += r["size"]
    within = ordered.where(F.col("part") == part).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy(column)))
    return within.where(F.col("upto") > rank - seen).agg(F.min(column).alias("value"))
