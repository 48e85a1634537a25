import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from logsluice.errors import ForwardError, SpoolError
from logsluice.operators import accounting, governance
from logsluice.plans.policy import compile_policy, from_yaml
from logsluice.queries import POLICY, _encoded, encode_request
from logsluice.sources import spool
from logsluice.sources.logs import events_as_logs, synthetic
from logsluice.streaming import pipeline, sinks
from logsluice.resilience import Breaker, guarded


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_breaker():
    clock = Clock()
    b = Breaker(faults=3, window=10, cooldown=30, clock=clock)
    b.fault(), b.fault()
    assert b.allows()
    b.fault()
    assert not b.allows()
    clock.now = 29
    assert not b.allows()
    clock.now = 31
    assert b.allows()
    b.fault(), b.fault()
    clock.now = 42.5
    b.fault()
    assert b.allows()
    b.fault(), b.fault()
    assert not b.allows()


def test_guarded():
    ok, bad = guarded(lambda: 1, lambda: 2), guarded(lambda: 1 // 0, lambda: 2)
    assert (ok.value, ok.bypassed, bad.value, bad.bypassed) == (1, False, 2, True) and "ZeroDivision" in bad.why


def test_spool(tmp_path, spark):
    s = spool.Spool(str(tmp_path), 26)
    assert [s.push(c * 8) for c in (b"a", b"b", b"c")] == [0, 1, 2]
    with pytest.raises(SpoolError):
        s.push(b"d" * 8)
    assert s.stats() == (3, 24)
    (tmp_path / "00000000000000000009.tmp").write_bytes(b"half")
    (tmp_path / "x.otlp").write_bytes(b"other")
    again = spool.Spool(str(tmp_path), 26)
    assert again.stats() == (3, 24) and again.next_seq == 3 and not list(tmp_path.glob("*.tmp"))
    files = spool.scan(spark, str(tmp_path))
    assert tuple(spool.usage(files).first()) == (3, 24, 3) and bytes(spool.head(files).first()["raw"]) == b"a" * 8
    sent = []

    def dead(_):
        raise ForwardError("down")

    assert again.drain_one(dead) == "retry" and again.stats() == (3, 24)
    while again.drain_one(sent.append) == "sent":
        pass
    assert [x[:1] for x in sent] == [b"a", b"b", b"c"] and again.stats() == (0, 0) and again.drain_one(sent.append) == "empty"
    again.push(b"e")
    (tmp_path / f"{3:020d}.otlp").unlink()
    assert again.drain_one(sent.append) == "retry"


def test_a_delivered_payload_is_not_sent_again(tmp_path, monkeypatch):
    s = spool.Spool(str(tmp_path), 100)
    s.push(b"once")

    def refuse(self, missing_ok=False):
        raise PermissionError("read-only")

    monkeypatch.setattr(type(tmp_path), "unlink", refuse)
    sent = []
    assert [s.drain_one(sent.append), s.drain_one(sent.append)] == ["sent", "empty"] and sent == [b"once"] and s.stats() == (0, 0)


def test_drain_backs_off(tmp_path):
    s = spool.Spool(str(tmp_path), 100)
    s.push(b"x")
    waits = []

    def wait(seconds):
        waits.append(seconds)
        return len(waits) == 7

    def dead(_):
        raise ForwardError("down")

    s.drain(dead, wait)
    assert [int(w) for w in waits] == [1, 2, 4, 8, 16, 30, 30] and all(0 <= w % 1 < 0.25 for w in waits)


def test_windows(spark):
    rows = [(10, 4, 6, 1000, 600, 0), (5, 1, 4, 500, 500, 2), (100, 0, 100, 100, 130, 1)]
    df = spark.createDataFrame([(*r, t) for r, t in zip(rows, ("2024-01-01 00:00:01", "2024-01-01 00:00:09", "2024-01-01 00:00:31"), strict=True)], "records_in long, dropped long, kept long, bytes_in long, bytes_out long, redactions long, at string")
    stats = df.withColumn("received_at", F.to_timestamp("at")).withColumn("assemble_bypassed", F.col("records_in") == 5)
    got = accounting.gap_filled(accounting.window_aggregate(accounting.samples(stats)), 2**64 - 1).orderBy("seq").collect()
    assert [(r["seq"], r["events_in"], r["events_sampled_out"], r["events_exported"], r["bytes_in"], r["bytes_exported"], r["bytes_dropped"], r["failopen_count"]) for r in got] == [(0, 15, 5, 10, 1500, 1100, 400, 1), (1, 0, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0), (3, 100, 0, 100, 100, 130, 0, 0)]
    assert int(got[0]["policy_version"]) == 2**64 - 1 and got[1]["window_start_ms"] - got[0]["window_start_ms"] == 10_000
    assert accounting.samples(stats.withColumn("parse_bypassed", F.lit(True))).count() == 0
    lines = []
    assert sinks.deliver_all(accounting.window_aggregate(accounting.samples(stats)), sinks.LineSink(lines.append)) == 2
    assert "events_in=15" in lines[0]

    class Broken:
        def deliver(self, aggregate):
            raise OSError("gone")

    errors = []
    assert sinks.deliver_all(accounting.window_aggregate(accounting.samples(stats)), Broken(), errors.append) == 0 and len(errors) == 2
    assert accounting.gap_filled(accounting.window_aggregate(accounting.samples(stats.limit(0))), 1).count() == 0


def test_stream_equals_batch(spark, sf_small, tmp_path):
    policy = compile_policy(from_yaml(POLICY), spark)
    logs = events_as_logs(spark, sf_small)
    logs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = pipeline.read_logs(spark, str(tmp_path / "in"), logs.schema, files_per_batch=1)
    lines = []

    def land(df, number):
        df.write.mode("append").parquet(str(tmp_path / "out"))

    q = pipeline.start(stream, pipeline.governed_batches(lambda: policy, land, sinks.LineSink(lines.append)), str(tmp_path / "cp"), None)
    q.awaitTermination(120)
    want = governance.govern_rows(logs, policy).select("event_id", "body")
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "body")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and lines
    total = sum(int(line.split("events_in=")[1].split()[0]) for line in lines)
    assert total == logs.count()


def test_window_stream_in_append_mode(spark, tmp_path):
    rows = [(t, 1, 10) for t in (1, 2, 11, 25, 26, 61)]
    sampled = spark.createDataFrame(rows, "t long, events_in long, bytes_in long").withColumn("received_at", F.timestamp_seconds("t"))
    for c in accounting.COUNTERS:
        sampled = sampled if c in sampled.columns else sampled.withColumn(c, F.lit(0).cast("long"))
    sampled = sampled.drop("t")
    sampled.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sampled.schema).parquet(str(tmp_path / "in"))
    q = pipeline.window_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["window_start_ms"]: (r["events_in"], r["bytes_in"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (2, 20), 10_000: (1, 10), 20_000: (2, 20)}  # the last window is not past


def collecting(seen):
    return lambda df, n: seen.extend(r.asDict(recursive=True) for r in df.collect())


def noisy(spark, n=400):
    return synthetic(spark, n // 10).withColumn("namespace", F.lit("web"))


HALF = "sampling: {default_target: 30}\nredaction: {regex_rules: [{name: mail, pattern: '[a-z0-9]+@mail[.]test', mask: '<m>', fields: [body]}]}"


def test_an_open_breaker_bypasses_redaction_alone(spark):
    policy = compile_policy(from_yaml(HALF), spark)
    clock = Clock()
    breaker = Breaker(faults=1, clock=clock)
    breaker.fault()
    assert not breaker.allows()
    logs, seen, lines = noisy(spark), [], []
    pipeline.governed_batches(lambda: policy, collecting(seen), sinks.JsonSink(lines.append), breaker)(logs, 0)
    want = governance.govern_rows(logs, policy).count()
    assert 0 < len(seen) == want < 400 and any("@mail.test" in r["body"] for r in seen)
    totals = [json.loads(x) for x in lines]
    assert sum(t["events_exported"] for t in totals) == want and sum(t["events_sampled_out"] for t in totals) == 400 - want
    assert sum(t["redaction_count"] for t in totals) == 0 and sum(t["failopen_count"] for t in totals) == 40


class BrokenRules:
    def __init__(self, policy):
        self.policy = policy

    def __getattr__(self, name):
        if name == "redaction":
            raise RuntimeError("broken rules")
        return getattr(self.policy, name)


def test_failing_redaction_samples_and_trips(spark):
    policy = compile_policy(from_yaml(HALF), spark)
    logs, seen, breaker = noisy(spark), [], Breaker(faults=2, clock=Clock())
    run = pipeline.governed_batches(lambda: BrokenRules(policy), collecting(seen), None, breaker)
    want = governance.govern_rows(logs, policy).count()
    for k in range(3):
        assert breaker.allows() == (k < 2)
        run(logs, k)
    assert len(seen) == 3 * want and any("@mail.test" in r["body"] for r in seen)


def test_an_error_of_the_sink_releases_nothing(spark):
    policy = compile_policy(from_yaml(HALF), spark)
    seen, breaker = [], Breaker(faults=1, clock=Clock())

    def full(df, n):
        seen.extend(r["body"] for r in df.collect())
        raise OSError("disk full")

    with pytest.raises(OSError):
        pipeline.governed_batches(lambda: policy, full, None, breaker)(noisy(spark), 0)
    assert breaker.allows() and seen and not any("@mail.test" in b for b in seen)


def test_failing_sampling_keeps_all(spark):
    class Broken:
        default_target, redaction = 50, ()

        @property
        def sampling(self):
            raise RuntimeError("broken policy")

    seen = []
    pipeline.governed_batches(lambda: Broken(), collecting(seen), None, Breaker(faults=2))(noisy(spark, 50), 0)
    assert len(seen) == 50


def test_payloads_behind_the_breaker(spark, monkeypatch):
    policy = compile_policy(from_yaml(HALF), spark)
    raw = encode_request([_encoded(f"mail a{k}@mail.test", bytes([k]) * 16, 9, [], False) for k in range(100)], "web", "s")
    df = spark.createDataFrame([("1", raw)], "request_id string, raw binary").withColumn("received_at", F.timestamp_seconds(F.lit(5)))
    lines, clock = [], Clock()
    breaker = Breaker(faults=1, clock=clock)
    run = pipeline.payload_batches(lambda: policy, None, None, sinks.JsonSink(lines.append), breaker=breaker)
    run(df, 0)
    real = pipeline.govern_payloads

    def broken(requests, policy, redact=True):
        if redact:
            raise RuntimeError("broken rules")
        return real(requests, policy, redact)

    monkeypatch.setattr(pipeline, "govern_payloads", broken)
    run(df, 1)
    assert not breaker.allows()
    monkeypatch.setattr(pipeline, "govern_payloads", real)
    run(df, 2)
    a, b, c = map(json.loads, lines)
    assert a["events_sampled_out"] == b["events_sampled_out"] == c["events_sampled_out"] > 0
    assert a["redaction_count"] == 100 and b["redaction_count"] == c["redaction_count"] == 0 and [x["failopen_count"] for x in (a, b, c)] == [0, 1, 1]


def test_windows_leave_in_sequence_and_at_the_end():
    got = []

    class Sink:
        def deliver(self, aggregate):
            got.append(aggregate)

    flusher = pipeline.WindowFlusher(Sink(), 7)
    one = lambda start, n: {"window_start_ms": start, "window_end_ms": start + 10_000, **dict.fromkeys(accounting.COUNTERS, n)}
    for start, n in ((20_000, 1), (20_000, 2), (50_000, 4), (20_000, 8)):
        flusher.deliver(one(start, n))
    assert [(x["seq"], x["window_start_ms"], x["events_in"]) for x in got] == [(0, 20_000, 3), (1, 30_000, 0), (2, 40_000, 0)]
    flusher.flush(), flusher.flush()
    assert [(x["seq"], x["window_start_ms"], x["events_in"], x["policy_version"]) for x in got[3:]] == [(3, 50_000, 12, 7)]


def test_orderly_end(spark, tmp_path):
    from logsluice.sources import receiver

    landing = receiver.Landing(str(tmp_path / "in"))
    server = receiver.serve(landing, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    policy = compile_policy(from_yaml(HALF), spark)
    lines = []
    flusher = pipeline.WindowFlusher(sinks.JsonSink(lines.append), policy.fingerprint)
    landing.put(encode_request([_encoded("b", b"\x05" * 16, 9, [], False)], "web", "s"))
    q = pipeline.start(pipeline.read_payload_files(spark, str(tmp_path / "in")), pipeline.payload_batches(lambda: policy, None, None, flusher), str(tmp_path / "cp"), "1 seconds")
    landing.put(encode_request([_encoded("c", b"\x06" * 16, 9, [], False)], "web", "s"))
    pipeline.drain(q, servers=(server,), flushers=(flusher,))
    assert not q.isActive and sum(json.loads(x)["events_in"] for x in lines) == 2


@pytest.fixture
def destination():
    got, status = [], [200]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.path, self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(status[0])
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/", got, status
    server.shutdown()


def test_forward_and_spool(spark, tmp_path, destination):
    url, got, status = destination
    policy = compile_policy(from_yaml(POLICY), spark)
    raw = encode_request([_encoded("mail a@corp.io", b"\x11" * 16, 9, [], False)], "payments", "s")
    df = spark.createDataFrame([("1", raw), ("2", b"\xff" * 40)], "request_id string, raw binary").withColumn("received_at", F.current_timestamp())
    s = spool.Spool(str(tmp_path / "spool"), 10_000)
    lines = []
    run = pipeline.payload_batches(lambda: policy, url, s, sinks.LineSink(lines.append))
    run(df, 0)
    want = encode_request([_encoded("mail [EMAIL]", b"\x11" * 16, 9, [], False)], "payments", "s")
    assert got == [("/v1/logs", want)] and s.stats() == (0, 0) and "events_in=1 " in lines[0]
    status[0] = 500
    run(df, 1)
    assert s.stats()[0] == 1
    status[0] = 200
    assert s.drain_one(lambda p: sinks.forward(url, p)) == "sent" and got[-1] == ("/v1/logs", want)
    pipeline.payload_batches(lambda: policy, None, None)(df, 2)
    with pytest.raises(ForwardError):
        sinks.logs_url("ftp://x")
    sent = sinks.forward_all(spark.createDataFrame([("9", b"x")], "request_id string, payload binary"), url).first()
    assert sent["delivered"] and got[-1] == ("/v1/logs", b"x")


def test_replay_of_a_spool(spark, tmp_path):
    s = spool.Spool(str(tmp_path / "spool"), 10_000)
    raw = encode_request([_encoded("b", None, 9, [], False)], None, "s")
    s.push(raw), s.push(raw)
    seen = []
    q = pipeline.start(pipeline.read_payload_files(spark, str(tmp_path / "spool")), lambda df, n: seen.extend(bytes(r["raw"]) for r in df.select("raw").collect()), str(tmp_path / "cp"), None)
    q.awaitTermination(60)
    assert seen == [raw, raw]


def test_synthetic(spark):
    df = synthetic(spark, 20)
    assert df.count() == 200 and df.where("body LIKE '%@mail.test%'").count() == 60
    assert df.select("trace_id").distinct().count() == 200
