import http.client
import random
import shutil
import socket
import threading

import pytest
from pyspark.sql import functions as F

from logsluice.errors import AssembleError, ParseError
from logsluice.plans.policy import compile_policy, from_yaml
from logsluice.queries import _encoded, encode_request
from logsluice.sources import grpc_receiver, otlp, receiver

TRACE = bytes.fromhex("00112233445566778899aabbccddeeff")
f = otlp._len_field


def record(body="hello", trace=TRACE, severity=9, attrs=(("user.email", "a@corp.io"),), extra=False):
    return _encoded(body, trace, severity, list(attrs), extra)


def test_views():
    int_attr = f(6, f(1, b"count") + f(2, otlp.varint(3 << 3) + b"\x05"))
    raw = encode_request([record() + int_attr, record("two", None, None, ())], "payments", "checkout")
    a, b = otlp.parse(raw)
    assert raw[slice(*a.body)] == b"hello" and raw[slice(*a.trace_id)] == TRACE and a.severity == 9 and len(a.attrs) == 1
    assert raw[slice(*a.namespace)] == b"payments" and raw[slice(*b.service)] == b"checkout" and b.trace_id is None and b.severity is None


def test_edges():
    int_body = f(5, otlp.varint(3 << 3) + b"\x2a")
    one = otlp.parse(encode_request([int_body], None, None))[0]
    assert one.body is None and one.namespace is None
    raw = encode_request([f(5, f(1, b"kept")) + int_body + f(9, TRACE) + f(9, b"\x01" * 5) + otlp.varint(2 << 3) + otlp.varint((1 << 64) - 3)], None, None)
    one = otlp.parse(raw)[0]
    assert raw[slice(*one.body)] == b"kept" and raw[slice(*one.trace_id)] == TRACE and one.severity == -3
    assert otlp.parse(b"") == []
    for bad in (b"\xff" * 32, f(1, b"x" * 5)[:-1], otlp.varint(1 << 3 | 2) + otlp.varint(1_000_000) + b"x", otlp.varint(9 << 3 | 3)):
        with pytest.raises(ParseError):
            otlp.parse(bad)


def test_resource_after_scopes_and_last_resource():
    pairs = lambda ns: f(1, f(1, f(1, b"k8s.namespace.name") + f(2, f(1, ns))))
    raw = f(1, f(2, f(2, record())) + pairs(b"a") + pairs(b"b"))
    assert raw[slice(*otlp.parse(raw)[0].namespace)] == b"b"
    raw = f(1, pairs(b"a") + f(1, b"") + f(2, f(2, record())))
    assert otlp.parse(raw)[0].namespace is None


def test_every_prefix():
    raw = encode_request([record(extra=True), record("x")], "ns", "svc")
    for n in range(len(raw)):
        try:
            otlp.parse(raw[:n])
        except ParseError:
            pass


def test_assemble_equals_fresh_encoding():
    raw = encode_request([record(extra=True), record("drop me", b"\x22" * 16), record("login bob@corp.io")], "ns", "svc")
    a, b, c = otlp.parse(raw)
    assert otlp.assemble(raw, set(), {}) is raw
    got = otlp.assemble(raw, {b.where}, {c.body: b"login [EMAIL]", a.attrs[0][1]: b"[E]"})
    assert got == encode_request([record(extra=True, attrs=[("user.email", "[E]")]), record("login [EMAIL]")], "ns", "svc")
    assert otlp.assemble(raw, {a.where, b.where, c.where}, {}) == encode_request([], "ns", "svc")


def test_trailing_garbage_parses_but_cannot_be_written_back():
    garbage = f(5, f(1, b"a@corp.io") + b"\xff")
    raw = encode_request([garbage], None, None)
    one = otlp.parse(raw)[0]
    assert raw[slice(*one.body)] == b"a@corp.io"
    with pytest.raises(AssembleError):
        otlp.assemble(raw, set(), {one.body: b"x"})
    assert otlp.assemble(raw, {one.where}, {}) == encode_request([], None, None)


POLICY = r"""
sampling: {default_target: 100, rules: [{match: {severity_lte: DEBUG}, target: 0}]}
redaction: {regex_rules: [{name: email, pattern: '[a-z]+@corp\.io', mask: "[E]", fields: [body, "attributes.user.*"]}, {name: ip, pattern: '[0-9.]{7,}', mask: "[IP]", fields: [body]}]}
"""


def test_govern_payloads(spark):
    policy = compile_policy(from_yaml(POLICY), spark)
    bad_utf8 = f(5, f(1, b"\xff\xfe a@corp.io \x80"))
    raws = {
        "keep": encode_request([record("plain", attrs=())], "n", "s"), "mixed": encode_request([record("a@corp.io 10.0.0.1"), record("b@corp.io", severity=5)], "n", "s"), "bad": b"\xff" * 40, "bytes": encode_request([bad_utf8], None, None),
        "garbage": encode_request([f(5, f(1, b"a@corp.io") + b"\xff")], None, None), "none": b"", "all": encode_request([record(severity=1)], "n", "s"),
    }
    df = spark.createDataFrame([(k, v) for k, v in raws.items()], "request_id string, raw binary").withColumn("received_at", F.current_timestamp())
    got = {r["request_id"]: r for r in otlp.govern_payloads(df, policy).collect()}
    assert bytes(got["keep"]["payload"]) == raws["keep"] and got["keep"]["redactions"] == 0
    assert bytes(got["mixed"]["payload"]) == encode_request([record("[E] [IP]", attrs=[("user.email", "[E]")])], "n", "s")
    assert (got["mixed"]["records_in"], got["mixed"]["kept"], got["mixed"]["dropped"], got["mixed"]["redactions"]) == (2, 1, 1, 5)
    assert got["bad"]["parse_bypassed"] and bytes(got["bad"]["payload"]) == raws["bad"] and got["bad"]["records_in"] == 0
    assert bytes(got["bytes"]["payload"]) == encode_request([f(5, f(1, b"\xff\xfe [E] \x80"))], None, None)
    assert got["garbage"]["assemble_bypassed"] and bytes(got["garbage"]["payload"]) == raws["garbage"]
    assert bytes(got["none"]["payload"]) == b"" and not got["none"]["parse_bypassed"]
    assert bytes(got["all"]["payload"]) == encode_request([], "n", "s")
    open_ = {r["request_id"]: r for r in otlp.govern_payloads(df, policy, redact=False).collect()}
    assert open_["mixed"]["redact_bypassed"] and b"a@corp.io" in bytes(open_["mixed"]["payload"]) and open_["mixed"]["dropped"] == 1


def test_sources_and_functions(spark, tmp_path):
    raw = encode_request([record()], "payments", "checkout")
    (tmp_path / "a.otlp").write_bytes(raw)
    (tmp_path / "b.txt").write_bytes(b"no")
    assert otlp.decode(otlp.read_payloads(spark, str(tmp_path))).first()["namespace"] == "payments"
    ok, big = otlp.within_limit(otlp.read_payloads(spark, str(tmp_path)), len(raw) - 1)
    assert (ok.count(), big.count()) == (0, 1)
    assert otlp.within_limit(otlp.read_payloads(spark, str(tmp_path)), len(raw) - 5, framed=True)[0].count() == 1
    otlp.register(spark)
    spark.createDataFrame([(raw,)], "raw binary").createOrReplaceTempView("payloads")
    assert spark.sql("SELECT r.body, r.service_name FROM payloads p, LATERAL otlp_logs(p.raw) r").first() == ("hello", "checkout")
    assert spark.sql("SELECT sample_bucket(unhex('00000000000000000000000000000001')), sample_bucket(NULL)").first() == (75, None)


def odd_requests():
    """Requests with all that the wire format allows and all that breaks it, and prefixes of some."""
    rng = random.Random(9)
    odd = [f(5, f(1, b"\xff a")), f(5, f(1, b"x") + b"\xff"), f(5, otlp.varint(3 << 3) + b"\x05"), f(6, f(1, b"k")), f(6, f(2, f(1, b"v"))), f(6, f(1, b"k") + f(2, b"\xff")), f(9, b"\x01" * 32), f(9, b"\x01" * 5), otlp.varint(2 << 3) + otlp.varint((1 << 64) - 3), otlp.varint(1 << 3 | 1) + b"\x00" * 8, otlp.varint(8 << 3 | 5) + b"\x00" * 4, otlp.varint(7 << 3 | 3), b"\x80" * 11]
    raws = [b"", b"\xff" * 32, otlp.varint(1 << 3 | 2) + otlp.varint(10**6) + b"x"]
    for _ in range(150):
        records = [b"".join(rng.sample(odd[:11] if rng.random() < 0.8 else odd, rng.randrange(1, 6))) if rng.random() < 0.4 else record(f"b{k} a@corp.io", extra=k % 2 == 0, attrs=[("user.email", "a@corp.io")] * (k % 3)) for k in range(rng.randrange(0, 7))]
        raws.append(encode_request(records, rng.choice([None, "n"]), rng.choice([None, "s"])) * rng.choice([1, 1, 2]))
    return raws + [r[: rng.randrange(len(r) + 1)] for r in raws]


def test_all_at_once_is_one_by_one():
    import numpy as np
    import pyarrow as pa

    raws = odd_requests()
    buf, lo, hi = otlp._buffer(pa.array(raws, pa.binary()))
    at = otlp.layout(buf, lo, hi)
    got = otlp._record_column(buf, at, len(raws), True).to_pylist()
    group = at.scopes[at.records[:, 0], 0]
    request = at.groups[group, 0]
    rng = random.Random(4)
    drop, body, values, want, failed = np.zeros(len(request), bool), {}, {}, [], set()
    for i, raw in enumerate(raws):
        try:
            found = otlp.parse(raw)
        except ParseError:
            assert at.bad[i] and got[i] == []
            want.append(raw)
            continue
        assert not at.bad[i]
        cut = lambda w, raw=raw: None if w is None else raw[slice(*w)]
        assert [(r["body"], r["trace_id"], r["severity_number"], r["namespace"], r["service_name"], [(a["key"].encode(), a["value"]) for a in r["attrs"]], r["record_raw"]) for r in got[i]] == [
            (cut(r.body), cut(r.trace_id), r.severity, None if r.namespace is None else cut(r.namespace).decode(), None if r.service is None else cut(r.service).decode(), [(cut(k), cut(v)) for k, v in r.attrs], cut(r.where)) for r in found
        ]
        gone, new = set(), {}
        attr = np.flatnonzero(request[at.attrs[:, 0]] == i).tolist()
        mine = np.flatnonzero(request == i).tolist()
        for k, r in zip(mine, found, strict=True):
            if rng.random() < 0.3:
                drop[k] = True
                gone.add(r.where)
            if r.body and rng.random() < 0.5:
                body[k] = new[r.body] = b"n" * rng.choice([0, 3, 200])
        for k, where in zip(attr, [v for r in found for _, v in r.attrs], strict=True):
            if rng.random() < 0.5:
                values[k] = new[where] = b"v" * rng.choice([1, 150])
        try:
            want.append(otlp.assemble(raw, gone, new))
        except AssembleError:
            want.append(raw)
            failed.add(i)
            drop[mine] = False
            for k in mine:
                body.pop(k, None)
            for k in attr:
                values.pop(k, None)
            assert at.odd[mine].any()
    assert otlp.rewritten(buf, lo, hi, at, drop, body, values) == want and failed


def test_requests_with_one_name(spark):
    policy = compile_policy(from_yaml(POLICY), spark)
    raws = [encode_request([record("a@corp.io", attrs=())], "n", "s"), encode_request([record("x", attrs=()), record("b@corp.io", attrs=())], "n", "s")]
    df = spark.createDataFrame([("same", r) for r in raws], "request_id string, raw binary").withColumn("received_at", F.current_timestamp())
    got = sorted(bytes(r["payload"]) for r in otlp.govern_payloads(df, policy).collect())
    assert got == sorted([encode_request([record("[E]", attrs=())], "n", "s"), encode_request([record("x", attrs=()), record("[E]", attrs=())], "n", "s")])


def test_attribute_bytes_stay(spark):
    policy = compile_policy(from_yaml(POLICY), spark)
    pair = lambda v: f(6, f(1, b"user.note") + f(2, f(1, v)))
    raw = encode_request([record("x", attrs=()) + pair(b"\xfe a@corp.io \x80\x81") + pair(b"\xff\xfe")], "n", "s")
    df = spark.createDataFrame([("1", raw)], "request_id string, raw binary").withColumn("received_at", F.current_timestamp())
    row = otlp.govern_payloads(df, policy).first()
    assert bytes(row["payload"]) == encode_request([record("x", attrs=()) + pair(b"\xfe [E] \x80\x81") + pair(b"\xff\xfe")], "n", "s") and row["redactions"] == 1
    plan = otlp.govern_payloads(df, policy)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 2


def test_a_request_that_fails_leaves_as_it_came(monkeypatch):
    import pyarrow as pa

    raws = [encode_request([record("one")], "n", "s"), encode_request([record("two")], "n", "s")]
    real = otlp.rewritten

    def broken(buf, lo, hi, at, drop, body, values):
        if b"two" in b"".join(body.values()):
            raise RuntimeError("broken")
        return real(buf, lo, hi, at, drop, body, values)

    monkeypatch.setattr(otlp, "rewritten", broken)
    lists = lambda x, kind: pa.array([[v] for v in x], pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([pa.array(["1", "2"]), pa.array([0, 0], pa.timestamp("us", "UTC")), pa.array(raws, pa.binary()), pa.array([False, False]), lists([True, True], pa.bool_()), lists([b"1", b"two!"], pa.binary()), lists([None, None], pa.list_(pa.binary())), lists([1, 1], pa.int64())], names=list(otlp.DECIDED))
    rows = [r for b in otlp._writer(True)([batch]) for r in b.to_pylist()]
    assert rows[0]["payload"] == encode_request([record("1")], "n", "s") and not rows[0]["assemble_bypassed"]
    assert rows[1]["payload"] == raws[1] and rows[1]["assemble_bypassed"] and rows[1]["kept"] == 1


def running(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server.server_address[1]


def test_receiver(tmp_path):
    server = receiver.serve(receiver.Landing(str(tmp_path / "in")), port=0, most=1000, threads=4)
    port = running(server)

    def post(path, body, method="POST", **how):
        c = http.client.HTTPConnection("127.0.0.1", port, timeout=5)
        c.request(method, path, body, **how)
        return c.getresponse().status

    def sent(text):
        with socket.create_connection(("127.0.0.1", port), timeout=5) as s:
            s.sendall(text)
            return int(s.makefile("rb").readline().split()[1])

    raw = encode_request([record()], "n", "s")
    assert [post("/v1/logs", raw), post("/v1/logs", b"\xff" * 9), post("/v1/traces", raw), post("/v1/logs", b"x" * 1001), post("/v1/logs", None, "GET")] == [200, 400, 404, 413, 404]
    assert post("/v1/logs", iter([raw[:5], raw[5:]]), encode_chunked=True, headers={"Transfer-Encoding": "chunked"}) == 200
    assert post("/v1/logs", iter([b"x" * 600, b"x" * 600]), encode_chunked=True, headers={"Transfer-Encoding": "chunked"}) == 413
    head = b"POST /v1/logs HTTP/1.1\r\nHost: x\r\n"
    assert [sent(head + b"\r\n"), sent(head + b"Content-Length: ten\r\n\r\n"), sent(head + b"Content-Length: -5\r\n\r\n"), sent(head + b"Transfer-Encoding: gzip\r\n\r\n"), sent(head + b"Transfer-Encoding: chunked\r\n\r\nzz\r\n")] == [411, 400, 400, 501, 400]
    assert [p.read_bytes() for p in (tmp_path / "in").glob("*.otlp")] == [raw, raw]
    server.shutdown(), server.server_close()


def test_receiver_that_cannot_land(tmp_path):
    landing = receiver.Landing(str(tmp_path / "in"))
    shutil.rmtree(tmp_path / "in")
    assert receiver.accept(landing, encode_request([record()], "n", "s"), 1000) == "forward_failed"


class GrpcClient:
    """As much of a client as the tests need: header blocks with Huffman codes and remembered entries."""

    def __init__(self, port):
        self.s = socket.create_connection(("127.0.0.1", port), timeout=5)
        self.r = self.s.makefile("rb")
        self.s.sendall(grpc_receiver.PREFACE + grpc_receiver.frame(grpc_receiver.SETTINGS, 0, 0))
        self.next, self.block = 1, grpc_receiver.Block()

    def call(self, data, path=grpc_receiver.PATH, kind="application/grpc", coded=False, split=None):
        g, stream, self.next = grpc_receiver, self.next, self.next + 2
        codes = {c: k for k, c in g.CODES.items()}

        def text(s):
            if not coded:
                return bytes([len(s)]) + s.encode()
            bits = "".join(f"{codes[c][1]:0{codes[c][0]}b}" for c in s)
            bits += "1" * (-len(bits) % 8)
            raw = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
            return bytes([0x80 | len(raw)]) + raw

        block = bytes([0x83, 0x86]) + b"\x44" + text(path) + b"\x40" + text("content-type") + text(kind)
        cut = len(block) if split is None else split
        out = g.frame(g.HEADERS, 0 if split is not None else g.END_HEADERS, stream, block[:cut])
        out += g.frame(g.CONTINUATION, g.END_HEADERS, stream, block[cut:]) if split is not None else b""
        out += b"".join(g.frame(g.DATA, 0, stream, data[k : k + 9000]) for k in range(0, len(data), 9000)) + g.frame(g.DATA, g.END_STREAM, stream)
        self.s.sendall(out)
        got = {}
        while True:
            head = self.r.read(9)
            payload = self.r.read(int.from_bytes(head[:3], "big"))
            if head[3] == g.HEADERS:
                got |= dict(self.block.read(payload))
                if head[4] & g.END_STREAM:
                    return got.get(":status"), got.get("grpc-status")


def test_grpc(tmp_path):
    server = grpc_receiver.serve(receiver.Landing(str(tmp_path / "in")), port=0, most=20_000, idle=5)
    client = GrpcClient(running(server))
    framed = lambda b, flag=0: bytes([flag]) + len(b).to_bytes(4, "big") + b
    raw = encode_request([record("body " * 3000)], "n", "s")
    assert client.call(framed(raw)) == client.call(framed(raw), coded=True) == client.call(framed(raw), split=7) == ("200", "0")
    assert [client.call(x)[1] for x in (framed(b"\xff" * 9), framed(raw)[:-2], b"", framed(raw, 1), framed(b"x" * 30_000))] == ["3", "3", "3", "12", "8"]
    assert client.call(framed(raw), path="/other")[1] == "12" and client.call(framed(raw), kind="text/plain") == ("415", None)
    shutil.rmtree(tmp_path / "in")
    assert client.call(framed(raw))[1] == "14"
    client.s.sendall(grpc_receiver.frame(grpc_receiver.PING, 0, 0, b"12345678"))
    bad = GrpcClient(server.server_address[1])
    bad.s.sendall(grpc_receiver.frame(grpc_receiver.HEADERS, grpc_receiver.END_HEADERS, 1, b"\xff\xff\xff\xff\xff\xff"))
    frames = bad.r.read()
    assert frames[-len(b"a bad number") - 17 :][3:4] == bytes([grpc_receiver.GOAWAY])
    client.s.close(), bad.s.close()
    server.shutdown()


def test_data_source(spark, tmp_path):
    from logsluice.sources import datasource

    datasource.register(spark)
    for k in range(3):
        (tmp_path / f"{k:020d}.otlp").write_bytes(encode_request([record(f"body {k}"), record("x")], "ns", "svc"))
    (tmp_path / "bad.otlp").write_bytes(b"\xff" * 9)
    got = spark.read.format("otlp").option("filesPerTask", "2").load(str(tmp_path))
    assert got.count() == 6 and {r["body"] for r in got.where("record_idx = 0").collect()} == {"body 0", "body 1", "body 2"}
    seen = []
    stream = spark.readStream.format("otlp").option("maxFilesPerTrigger", "2").load(str(tmp_path)).writeStream.foreachBatch(lambda df, n: seen.extend(r["body"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp"))
    q = stream.start()
    q.processAllAvailable()
    assert len(seen) == 6
    (tmp_path / "0.otlp").write_bytes(encode_request([record("late under an early name")], "ns", "svc"))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 7 and seen[-1] == "late under an early name"
    q = stream.start()
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 7
