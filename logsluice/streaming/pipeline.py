"""Continuous governance with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logsluice.errors import ForwardError, SpoolError
from logsluice.operators import accounting
from logsluice.operators.governance import RedactStage, SampleStage, govern_rows, rows_of, unredacted
from logsluice.plans.policy import CompiledPolicy
from logsluice.resilience import Breaker, Outcome, guarded
from logsluice.sources.otlp import OUT, govern_payloads
from logsluice.sources.spool import Spool
from logsluice.streaming.sinks import AggregateSink, deliver_all, forward, forward_all, logs_url

Batch = Callable[[DataFrame, int], None]


def read_logs(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    """Landed Parquet logs as a stream; a bounded number of files a batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_payload_files(spark: SparkSession, path: str, files_per_batch: int = 1024) -> DataFrame:
    """Landed payloads (a receiver's folder, or a spool to replay) as a stream of requests, known by their whole path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.otlp").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(F.col("path").alias("request_id"), F.col("modificationTime").alias("received_at"), F.col("content").alias("raw"))


def govern_stream(logs: DataFrame, policy: CompiledPolicy) -> DataFrame:
    """Governed rows of a stream of logs: a map, no state."""
    return govern_rows(logs, policy)


def window_stream(sampled: DataFrame, late: str = "0 seconds", width: str = accounting.WINDOW) -> DataFrame:
    """Ten-second sums of a stream of samples (of requests). In append mode a window leaves, and its state goes, once the watermark passed it."""
    sums = sampled.withWatermark("received_at", late).groupBy(F.window("received_at", width).alias("w")).agg(*[F.sum(c).cast("long").alias(c) for c in accounting.COUNTERS])
    return sums.select(F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), *accounting.COUNTERS)


def made(df: DataFrame) -> DataFrame:
    """df, computed now and kept: what fails in it fails here, and what is done with it later doesn't fail for its sake."""
    df = df.persist()
    try:
        df.count()
    except BaseException:
        df.unpersist()
        raise
    return df


def gated(breaker: Breaker, step: Callable[[], DataFrame], otherwise: Callable[[], DataFrame]) -> Outcome[DataFrame]:
    """What the step makes; what stands in for it, if it fails (a fault) or the breaker is open."""
    if not breaker.allows():
        return Outcome(made(otherwise()), True, "breaker open")
    got = guarded(lambda: made(step()), lambda: made(otherwise()))
    if got.bypassed:
        breaker.fault()
    return got


def governed_batches(policy_now: Callable[[], CompiledPolicy], rows: Batch, aggregates: AggregateSink | None = None, breaker: Breaker | None = None) -> Batch:
    """For foreachBatch: governs a batch by the policy of that moment.

    Redaction alone is behind the breaker: where it fails or the breaker is open, records are sampled all the same and leave
    as they came. Where sampling fails, all records stay. An error of the sink `rows` is the batch's: it is not taken for a
    fault of governing, nothing else is written for it, and Spark runs the batch again.
    """
    breaker = breaker or Breaker()

    def run(batch: DataFrame, number: int) -> None:
        policy = policy_now()
        # A failing sample stage keeps all.
        sampled = guarded(lambda: made(SampleStage(policy).apply(batch)), lambda: made(batch.withColumns({"target": F.lit(100), "keep": F.lit(True)})))
        try:
            got = gated(breaker, lambda: RedactStage(policy).apply(sampled.value), lambda: unredacted(sampled.value))
            try:
                rows(rows_of(got.value), number)
                if aggregates is not None:
                    stats = accounting.request_stats(got.value).withColumn("redact_bypassed", F.lit(got.bypassed or sampled.bypassed))
                    deliver_all(accounting.window_aggregate(accounting.samples(stats)), aggregates)
            finally:
                got.value.unpersist()
        finally:
            sampled.value.unpersist()

    return run


def as_they_came(requests: DataFrame) -> DataFrame:
    """Requests as govern_payloads() would give them if nothing could be done with them."""
    size, none = F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long"), F.lit(0).cast("long")
    values = {"payload": F.col("raw"), "records_in": none, "kept": none, "dropped": none, "redactions": none, "bytes_in": size, "bytes_out": size, "parse_bypassed": F.lit(False), "redact_bypassed": F.lit(True), "assemble_bypassed": F.lit(True)}
    return requests.withColumns(values | {"request_id": F.col("request_id").cast("string"), "received_at": F.col("received_at").cast("timestamp")}).select(*[c.split()[0] for c in OUT.split(", ")])


def payload_batches(policy_now: Callable[[], CompiledPolicy], endpoint: str | None, spool: Spool | None, aggregates: AggregateSink | None = None, send: Callable[[str, bytes], None] = forward, breaker: Breaker | None = None) -> Batch:
    """For foreachBatch over requests: executors send the governed payloads on; those that can't be are spooled. No endpoint: only counted.

    Behind the breaker as records are: with redaction off requests are still sampled; where that fails as well, they leave as they came.
    Requests that can't be read are counted nowhere and not sent. `send` runs on the executors, the spool is the driver's.
    """
    breaker = breaker or Breaker()
    if endpoint is not None:
        logs_url(endpoint)

    def run(batch: DataFrame, number: int) -> None:
        policy = policy_now()
        plain = lambda: guarded(lambda: made(govern_payloads(batch, policy, redact=False)), lambda: as_they_came(batch)).value
        got = gated(breaker, lambda: govern_payloads(batch, policy), plain)
        try:
            if endpoint is not None:
                sent = made(forward_all(got.value.where("NOT parse_bypassed"), endpoint, send))
                try:
                    spooled(sent.where("NOT delivered"), spool)
                finally:
                    sent.unpersist()
            if aggregates is not None:
                deliver_all(accounting.window_aggregate(accounting.samples(got.value)), aggregates)
        finally:
            got.value.unpersist()

    return run


def spooled(failed: DataFrame, spool: Spool | None) -> int:
    """Puts payloads that were not delivered into the spool, in order; raises ForwardError where there is none, or it is full."""
    n = 0
    for r in failed.orderBy("received_at", "request_id").toLocalIterator():
        if spool is None:
            raise ForwardError(r["error"])
        try:
            spool.push(bytes(r["payload"]))
        except SpoolError as e:
            raise ForwardError(f"not delivered and not spooled: {e}") from e
        n += 1
    return n


class WindowFlusher:
    """Aggregates of batches as one sequence of windows without gaps: an aggregate sink in front of another one.

    A window leaves once a later one has begun, zeros where nothing came; flush() gives the last, partial one. Late counts go
    to the oldest window that is still open. It holds open windows alone.
    """

    def __init__(self, sink: AggregateSink, policy_version: int, width_ms: int = 10_000) -> None:
        self.sink, self.policy_version, self.width = sink, policy_version, width_ms
        self.open: dict[int, dict[str, int]] = {}
        self.next: int | None = None
        self.seq = 0

    def deliver(self, aggregate: dict) -> None:
        start = aggregate["window_start_ms"]
        start = start if self.next is None else max(start, self.next)
        self.next = start if self.next is None else self.next
        held = self.open.setdefault(start, dict.fromkeys(accounting.COUNTERS, 0))
        for c in accounting.COUNTERS:
            held[c] += aggregate[c]
        self._leave(max(self.open))

    def flush(self) -> None:
        """All that is open, the window that has just begun included."""
        if self.open:
            self._leave(max(self.open) + self.width)

    def _leave(self, before: int) -> None:
        while self.next is not None and self.next < before:
            start, self.next = self.next, self.next + self.width
            counts = self.open.pop(start, dict.fromkeys(accounting.COUNTERS, 0))
            seq, self.seq = self.seq, self.seq + 1
            self.sink.deliver({"seq": seq, "window_start_ms": start, "window_end_ms": start + self.width, "policy_version": self.policy_version, **counts})


def start(stream: DataFrame, batch: Batch, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    """every None: all that is there, then stop."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(query: StreamingQuery, *, servers: tuple = (), flushers: tuple[WindowFlusher, ...] = ()) -> None:
    """An orderly end: receivers take nothing new and finish what they have, what has landed is governed, the last windows leave."""
    for server in servers:
        server.shutdown()
        server.server_close()
    try:
        if query.isActive:
            query.processAllAvailable()
    finally:
        query.stop()
        for f in flushers:
            f.flush()
