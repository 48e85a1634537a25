"""Queries over the driver's tables, one for each operator of the log engine."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions import hashing, patterns, wire
from logsluice.operators import accounting, governance, redaction, sampling
from logsluice.plans.policy import CompiledPolicy, compile_policy, from_yaml, severity_max
from logsluice.sources import otlp, spool
from logsluice.sources.logs import as_logs, event_requests, events_as_logs, spread, synthetic
from logsluice.streaming import pipeline

POLICY = r"""
sampling:
  default_target: 50
  rules:
    - {match: {namespace: security-audit}, target: 100}
    - {match: {namespace: payments}, target: 100}
    - {match: {severity_lte: DEBUG}, target: 10}
    - {match: {namespace: "batch-*"}, target: 25}
redaction:
  regex_rules:
    - {name: email, pattern: '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', mask: "[EMAIL]", fields: [body, "attributes.user.*"]}
    - {name: ipv4, pattern: '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', mask: "[IP]", fields: [body, "attributes.*note"]}
    - {name: card, pattern: '[0-9]{13,16}', mask: "[CARD]", fields: [body]}
    - {name: phone, pattern: '\+?[0-9][0-9 ()-]{7,}[0-9]', mask: "[$PHONE]", fields: [body]}
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@cache
def _policy(text: str, session: int) -> CompiledPolicy:
    return compile_policy(from_yaml(text))


def policy(spark: SparkSession) -> CompiledPolicy:
    return _policy(POLICY, id(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are long to work on: over all cores even where it is one small file."""
    return spread(table(spark, sf_dir, name))


@query
def sample_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir).where("trace_hex IS NOT NULL")
    return logs.select("event_id", hashing.trace_bucket(hashing.normal_trace_id(F.col("trace_id"))).cast("long").alias("bucket"))


@query
def policy_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_logs(spark, sf_dir).select("event_id", sampling.target(policy(spark), F.col("namespace"), F.col("severity_number")).alias("target"))


@query
def sample_keep_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir).where("trace_hex IS NOT NULL")
    return sampling.sample(logs, policy(spark)).where("keep").select("event_id", "target")


@query
def sample_keep_untraced(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir).where("trace_hex IS NULL")
    out = sampling.sample(logs, policy(spark))
    return out.select("event_id", hashing.bucket_of(hashing.fallback_key(F.col("service_name"), F.col("body"))).cast("long").alias("bucket"), "keep")


@query
def policy_rule_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir).select("event_id", "namespace", "severity_number")
    p = policy(spark)
    return sampling.target_by_table(logs, sampling.rule_table(spark, p), p.default_target, "event_id").select("event_id", F.col("target").cast("int").alias("target"))


@query
def severity_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.col("severity_number")
    band = F.when(sev.isNull(), F.lit("NONE"))
    for name in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"):
        band = band.when(sev <= severity_max(name), F.lit(name))
    return events_as_logs(spark, sf_dir).groupBy(band.otherwise("OTHER").alias("band")).agg(F.count("*").alias("n"))


@query
def namespace_keep_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keep_rate(sampling.sample(events_as_logs(spark, sf_dir), policy(spark)), "namespace")


@query
def trace_id_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 7 == 0, F.upper("trace_hex")).when(F.col("event_id") % 7 == 1, F.substring("trace_hex", 1, 16)).when(F.col("event_id") % 7 == 2, F.concat(F.lit("zz"), F.substring("trace_hex", 3, 30))).when(F.col("event_id") % 7 == 3, F.substring("trace_hex", 1, 5)).otherwise(F.col("trace_hex"))
    return events_as_logs(spark, sf_dir).select("event_id", F.lower(F.hex(hashing.normal_trace_id(odd.cast("binary")))).alias("trace_id"))


@query
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.col("namespace")
    globs = {"any": "*", "batch": "batch-*", "audit": "*-audit", "inner": "*-*", "exact": "web", "under": "we_"}
    return events_as_logs(spark, sf_dir).select("event_id", *[F.coalesce(patterns.matches_glob(ns, g), F.lit(False)).alias(k) for k, g in globs.items()])


@query
def redact_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = policy(spark).redaction[0]
    return texts(spark, sf_dir, "documents").select("doc_id", redaction.redact_text(F.col("text"), [rule]).alias("text"))


@query
def redact_multi_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", redaction.redact_text(F.col("text"), policy(spark).redaction).alias("text"))


@query
def redact_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir)
    attrs = redaction.redact_attributes(F.col("attrs"), policy(spark))
    return logs.select("event_id", F.explode(attrs).alias("a")).select("event_id", F.col("a.key").alias("key"), F.col("a.value").alias("value"))


@query
def redaction_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select(F.col("text").alias("body"))
    return redaction.rule_counts(docs, policy(spark))


@query
def detect_pii_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages")
    return pages.select("page_id", *[F.coalesce(F.col("html").rlike(r.pattern), F.lit(False)).alias(r.name) for r in policy(spark).redaction])


@query
def prefilter_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = policy(spark).redaction
    parts = [texts(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(c).alias("x")) for t, c in (("documents", "text"), ("conversations", "text"), ("benchmark", "text"), ("pages", "html"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(redaction.any_match(F.col("x"), rules)).alias("hits"))


def _attrs_line() -> Column:
    return F.array_join(F.transform("attrs", lambda a: F.concat(a["key"], F.lit("="), a["value"])), "\n").alias("attrs")


@query
def govern_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.govern_rows(events_as_logs(spark, sf_dir), policy(spark)).select("event_id", "request_id", "namespace", "body", _attrs_line())


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.govern(events_as_logs(spark, sf_dir), policy(spark)).stats


@query
def request_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).drop("received_at")


@query
def bytes_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    size_in, size_out = F.col("bytes_in"), F.col("bytes_out")
    return _stats(spark, sf_dir).agg(F.sum(wire.saved(size_in, size_out)).cast("long").alias("saved"), F.sum(size_in - size_out).cast("long").alias("net"))


@query
def window_10s_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.window_aggregate(accounting.samples(_stats(spark, sf_dir)))


@query
def window_10s_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.gap_filled(window_10s_aggregate(spark, sf_dir), policy(spark).fingerprint).drop("policy_version")


@query
def aggregate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.as_json(window_10s_gapfill(spark, sf_dir).select("seq", *accounting.COUNTERS))


@query
def aggregate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.as_line(window_10s_gapfill(spark, sf_dir).select("seq", "events_in", "bytes_in", "redaction_count"))


@query
def spool_fifo_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), spool.file_name(F.col("o_orderkey")))).otherwise(spool.file_name(F.col("o_orderkey"))).alias("name"), F.col("o_custkey").cast("long").alias("size"))
    files = names.withColumn("seq", spool.file_seq(F.col("name"))).where("seq IS NOT NULL")
    both = spool.head(files).select(F.col("seq").cast("long").alias("head"), F.col("size").alias("head_size"))
    use = spool.usage(files).select("files", "bytes", F.col("next_seq").cast("long").alias("next_seq"))
    return both.join(F.broadcast(use))


@query
def otlp_varint_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_orderkey").cast("long") * F.col("l_orderkey") * F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(n.alias("value"), wire.varint_length(n).alias("varint"), wire.field_length(6, n).alias("field")).distinct()


@query
def grpc_frame_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = events_as_logs(spark, sf_dir).select("event_id", F.encode("body", "UTF-8").alias("m"))
    size = F.octet_length("m") + F.when(F.col("event_id") % 11 == 0, F.lit(9)).otherwise(F.lit(0))
    head = F.unhex(F.concat(F.when(F.col("event_id") % 13 == 0, F.lit("01")).otherwise(F.lit("00")), F.lpad(F.hex(size), 8, "0")))
    framed = body.withColumn("raw", F.concat(head, "m", F.lit(b"tail")))
    got = wire.grpc_frame(F.col("raw"))
    verdict = F.coalesce(F.when(got["error"] == "short", "short").when(got["error"] == "compressed", "compressed"), F.lit("accepted"))
    return framed.select("event_id", got["length"].alias("length"), got["message"].cast("string").alias("message"), got["error"].alias("error"), wire.grpc_status(verdict).alias("status"), wire.http_status(verdict).alias("http"))


def _encoded(body: str | None, trace: bytes | None, severity: int | None, attrs: list[tuple[str, str]], extra: bool) -> bytes:
    f = otlp._len_field
    value = lambda s: f(otlp.STRING, s.encode())
    out = bytearray()
    if extra:
        out += otlp.varint(1 << 3 | otlp.FIXED64) + (1_720_000_000_000_000_000).to_bytes(8, "little") + f(3, b"INFO") + otlp.varint(8 << 3 | otlp.FIXED32) + b"\x01\0\0\0" + f(12, b"test.event")
    if severity is not None:
        out += otlp.varint(otlp.SEVERITY << 3) + otlp.varint(severity & (1 << 64) - 1)
    if body is not None:
        out += f(otlp.BODY, value(body))
    for k, v in attrs:
        out += f(otlp.RECORD_ATTRIBUTES, f(otlp.KEY, k.encode()) + f(otlp.VALUE, value(v)))
    if trace is not None:
        out += f(otlp.TRACE_ID, trace)
    return bytes(out)


def encode_request(records: list[bytes], namespace: str | None, service: str | None) -> bytes:
    """A request of one resource and one scope, for loads and tests."""
    f = otlp._len_field
    pairs = b"".join(f(otlp.ATTRIBUTES, f(otlp.KEY, k) + f(otlp.VALUE, f(otlp.STRING, v.encode()))) for k, v in ((otlp.SERVICE, service), (otlp.NAMESPACE, namespace)) if v is not None)
    return f(otlp.RESOURCE_LOGS, f(otlp.RESOURCE, pairs) + f(otlp.SCOPE_LOGS, b"".join(f(otlp.LOG_RECORDS, r) for r in records)))


@query
def otlp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = otlp.decode(event_requests(spark, sf_dir))
    value = lambda k: F.get(F.col("attrs"), F.lit(k))["value"]
    return got.select(
        F.col("request_id").cast("long").alias("request_id"), F.col("record_idx").cast("long").alias("record_idx"), "body", F.col("trace_id").cast("string").alias("trace_hex"), "severity_number", "namespace", "service_name",
        F.array_join("attrs.key", ",").alias("keys"), value(0).alias("email"), value(1).alias("note"),
    )


@query
def otlp_govern_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request, those cut short as well: the bytes that leave, by their hash, and the counts."""
    out = otlp.govern_payloads(event_requests(spark, sf_dir), policy(spark))
    return out.select(F.col("request_id").cast("long").alias("request_id"), F.md5(F.hex("payload")).alias("payload_md5"), "records_in", "kept", "dropped", "redactions", "bytes_in", "bytes_out", "parse_bypassed")


@query
def otlp_open_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with redaction bypassed: requests are sampled, texts leave as they came."""
    out = otlp.govern_payloads(event_requests(spark, sf_dir), policy(spark), redact=False)
    return out.select(F.col("request_id").cast("long").alias("request_id"), F.md5(F.hex("payload")).alias("payload_md5"), "records_in", "kept", "redactions", "bytes_out", "redact_bypassed")


@query
def attr_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir)
    rows = logs.select("event_id", F.posexplode("attrs").alias("pos", "a"))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), F.col("a.key").alias("key"), F.col("a.value").alias("value"))


@query
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.percentile(table(spark, sf_dir, "events"), "value", 0.99).select(F.round("value", 6).alias("value"))


@query
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.percentile(table(spark, sf_dir, "events"), "value", 0.99, exact_rank=True)


@query
def request_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("raw"))
    ok, big = otlp.within_limit(pages, 4000)
    return ok.select("page_id", F.lit("accepted").alias("verdict")).unionByName(big.select("page_id", F.lit("too_large").alias("verdict")))


@query
def content_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("application/grpc", "application/grpc+proto", "application/json", "Application/grpc", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", wire.is_grpc(kind).alias("grpc"))


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of logs, one file a batch."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    return as_logs(spark, events)


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a stream appends until its source is read, as a table in the shared folder."""
    path = _shared(spark)

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(land).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


@query
def stream_govern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.govern_stream(_events_stream(spark, sf_dir), policy(spark)).select("event_id", "request_id", "namespace", "body", _attrs_line())
    return _streamed(spark, rows)


@query
def stream_govern_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By foreachBatch, behind the breaker."""
    path = _shared(spark)
    land = lambda rows, number: rows.select("event_id", "request_id", "namespace", "body", _attrs_line()).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    pipeline.start(_events_stream(spark, sf_dir), pipeline.governed_batches(lambda: policy(spark), land), f"{path}/checkpoint", None).awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


@query
def stream_window_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in append mode: each leaves once the watermark has passed it; the last, partial ones come from the samples behind the last window that left."""
    path = _shared(spark)
    accounting.samples(_stats(spark, sf_dir)).write.parquet(f"{path}/samples")
    samples = spark.read.parquet(f"{path}/samples")
    left = _streamed(spark, pipeline.window_stream(spark.readStream.schema(samples.schema).parquet(f"{path}/samples")))
    last = left.agg(F.max("window_end_ms")).first()[0] or 0
    return left.unionByName(accounting.window_aggregate(samples.where(F.unix_millis("received_at") >= last)))


@query
def synthetic_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = synthetic(spark, 500)
    return got.select("request_id", F.col("record_idx").cast("long").alias("record_idx"), F.unix_millis("received_at").alias("at_ms"), "body", F.lower(F.hex("trace_id")).alias("trace_hex"), "namespace", F.array_join("attrs.key", ",").alias("keys"))


@query
def rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in the policy's order, and the number of each one's mask in the table of masks."""
    p = policy(spark)
    return spark.createDataFrame([(k, r.name, r.mask, p.masks.index(r.mask), r.name in p.rule_names) for k, r in enumerate(p.redaction)], "idx long, name string, mask string, mask_idx long, listed boolean")


@query
def pattern_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over patterns made by rule: a group of one item with a quantifier each on the item and the group."""
    marks = ["", "?", "+", "*", "{2}", "{2,}", "{2,5}", "+?"]
    rows = [(i, a, b, patterns.nested_repetition(f"x({i}{a}){b}y") is not None) for i in ("[0-9]", "m", r"\\w", "(?:pq)") for a in marks for b in marks]
    return spark.createDataFrame(rows, "item string, inner_mark string, outer_mark string, rejected boolean")


@query
def severity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest severity of each band's name, whatever its case."""
    names = [f(n) for n in ("trace", "debug", "info", "warn", "warning", "error", "fatal") for f in (str.lower, str.upper, str.title)]
    return spark.createDataFrame([(n, severity_max(n)) for n in names], "name string, most long")


@query
def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_orderkey").cast("long") * F.col("l_partkey") + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(n.alias("value"), wire.varint_hex(n).alias("digits")).distinct()


@query
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each verdict answers, over HTTP and gRPC."""
    verdict = F.element_at(F.array(*map(F.lit, wire.STATUS)), (F.col("event_id") % len(wire.STATUS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", wire.http_status(verdict).alias("http"), wire.grpc_status(verdict).alias("grpc"))


@query
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the clock of the counters stands within a day of the driver's."""
    return spark.range(1).select((F.abs(accounting.now_ms() - F.lit(time.time_ns() // 1_000_000)) < 86_400_000).alias("agrees"))


@query
def policy_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(str(policy(spark).fingerprint)).alias("fingerprint"))
