"""Log payloads in protobuf: requests as rows of records, and records back into requests.

The walker takes what the wire format allows and no more (wire types 0, 1, 2 and 5), skips unknown fields, and fails a
whole request rather than give part of it. Writing back keeps every byte that is not in a dropped record or a
changed string: unknown fields, odd varints and all. parse() and assemble() say what one request means; layout() and
rewritten() do the same for all requests of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.errors import AssembleError, ParseError
from logsluice.operators.redaction import body_rules, let, redacted_attributes, redacted_bytes, total
from logsluice.operators.sampling import kept
from logsluice.plans.policy import CompiledPolicy
from logsluice.resilience import guarded
from logsluice.sources.wire_walk import FIXED32, FIXED64, LEN, VARINT, first_of, header, last_of, varint, walk

# Field numbers of a logs export request and of the parts that are read.
RESOURCE_LOGS, RESOURCE, SCOPE_LOGS, LOG_RECORDS, ATTRIBUTES, STRING, KEY, VALUE = 1, 1, 2, 2, 1, 1, 1, 2
SEVERITY, BODY, RECORD_ATTRIBUTES, TRACE_ID = 2, 5, 6, 9
NAMESPACE, SERVICE = b"k8s.namespace.name", b"service.name"
Range = tuple[int, int]


class Cursor:
    """Reads fields of buf between two places."""

    def __init__(self, buf: bytes, lo: int, hi: int) -> None:
        self.buf, self.at, self.end = buf, lo, hi

    def varint(self) -> int:
        start, value, shift = self.at, 0, 0
        while True:
            if self.at >= self.end:
                raise ParseError("truncated", self.at)
            b = self.buf[self.at]
            self.at += 1
            if shift >= 64:
                raise ParseError("varint too long", start)
            value |= (b & 127) << shift
            if b < 128:
                return value & (1 << 64) - 1
            shift += 7

    def bytes_(self) -> Range:
        at = self.at
        n = self.varint()
        if n > self.end - self.at:
            raise ParseError("length past the end", at)
        lo, self.at = self.at, self.at + n
        return lo, self.at

    def skip(self, wire: int) -> None:
        if wire == VARINT:
            self.varint()
        elif wire == LEN:
            self.bytes_()
        elif wire in (FIXED64, FIXED32):
            n = 8 if wire == FIXED64 else 4
            if n > self.end - self.at:
                raise ParseError("truncated", self.at)
            self.at += n
        else:
            raise ParseError(f"wire type {wire}", self.at)

    def fields(self) -> Iterator[tuple[int, int, Range | None, int]]:
        """(number, wire type, payload if it has a length, where its tag began); skips what has none, but for what the caller read."""
        while self.at < self.end:
            start = self.at
            tag = self.varint()
            number, wire = tag >> 3 & 0xFFFFFFFF, tag & 7
            if wire == LEN:
                yield number, wire, self.bytes_(), start
            else:
                before = self.at
                yield number, wire, None, start
                if self.at == before:
                    self.skip(wire)


@dataclass
class Record:
    where: Range
    body: Range | None = None
    trace_id: Range | None = None
    severity: int | None = None
    attrs: list[tuple[Range, Range]] = field(default_factory=list)
    namespace: Range | None = None
    service: Range | None = None


def _string(buf: bytes, where: Range) -> Range | None:
    """The first string of a value; what comes after it is not read."""
    for number, wire, payload, _ in Cursor(buf, *where).fields():
        if number == STRING and wire == LEN:
            return payload
    return None


def _pair(buf: bytes, where: Range) -> tuple[Range, Range] | None:
    key = value = None
    for number, wire, payload, _ in Cursor(buf, *where).fields():
        if wire == LEN and number == KEY:
            key = payload
        elif wire == LEN and number == VALUE:
            value = _string(buf, payload)
    return None if key is None or value is None else (key, value)


def _resource(buf: bytes, where: Range) -> tuple[Range | None, Range | None]:
    namespace = service = None
    for number, wire, payload, _ in Cursor(buf, *where).fields():
        if number == ATTRIBUTES and wire == LEN and (pair := _pair(buf, payload)):
            key = buf[slice(*pair[0])]
            namespace = pair[1] if key == NAMESPACE else namespace
            service = pair[1] if key == SERVICE else service
    return namespace, service


def _record(buf: bytes, where: Range) -> Record:
    out = Record(where)
    cursor = Cursor(buf, *where)
    for number, wire, payload, _ in cursor.fields():
        if number == SEVERITY and wire == VARINT:
            low = cursor.varint() & 0xFFFFFFFF
            out.severity = low - (1 << 32) if low >> 31 else low
        elif wire != LEN:
            continue
        elif number == BODY:
            out.body = _string(buf, payload) or out.body
        elif number == RECORD_ATTRIBUTES and (pair := _pair(buf, payload)):
            out.attrs.append(pair)
        elif number == TRACE_ID and payload[1] - payload[0] in (16, 32):
            out.trace_id = payload
    return out


def parse(buf: bytes) -> list[Record]:
    """All records of a request, in order, with their resource's attributes. Raises ParseError."""
    out = []
    for number, wire, group, _ in Cursor(buf, 0, len(buf)).fields():
        if number != RESOURCE_LOGS or wire != LEN:
            continue
        namespace = service = None
        scopes = []
        for inner, kind, payload, _ in Cursor(buf, *group).fields():
            if kind == LEN and inner == RESOURCE:
                namespace, service = _resource(buf, payload)
            elif kind == LEN and inner == SCOPE_LOGS:
                scopes.append(payload)
        for scope in scopes:
            for inner, kind, payload, _ in Cursor(buf, *scope).fields():
                if kind == LEN and inner == LOG_RECORDS:
                    record = _record(buf, payload)
                    record.namespace, record.service = namespace, service
                    out.append(record)
    return out


def _len_field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | LEN) + varint(len(payload)) + payload


#: For each level, which field holds what: another level, or a string that may change.
_LEVELS: dict[str, dict[int, str]] = {
    "request": {RESOURCE_LOGS: "group"}, "group": {SCOPE_LOGS: "scope"}, "scope": {LOG_RECORDS: "record"},
    "record": {BODY: "value", RECORD_ATTRIBUTES: "pair"}, "pair": {VALUE: "value"}, "value": {STRING: "text"},
}


def assemble(buf: bytes, dropped: set[Range], changed: dict[Range, bytes]) -> bytes:
    """The request without the dropped records and with the changed strings; the same object if there is neither."""
    if not dropped and not changed:
        return buf

    def rebuilt(level: str, lo: int, hi: int) -> bytes | None:
        """New content, or None where nothing changes."""
        cursor, parts, done = Cursor(buf, lo, hi), [], lo
        for number, wire, payload, start in cursor.fields():
            below = _LEVELS[level].get(number) if wire == LEN else None
            if below is None:
                continue
            if below == "record" and payload in dropped:
                parts.append(buf[done:start])
                done = payload[1]
                continue
            new = changed.get(payload) if below == "text" else rebuilt(below, *payload)
            if new is not None:
                parts += [buf[done:start], _len_field(number, new)]
                done = payload[1]
        return b"".join([*parts, buf[done:hi]]) if parts else None

    try:
        out = rebuilt("request", 0, len(buf))
    except ParseError as e:
        raise AssembleError(str(e)) from e
    return buf if out is None else out


# --- As DataFrames.

PARTS = "body:binary,trace_id:binary,severity_number:int,namespace:string,service_name:string,attrs:array<struct<key:string,value:binary>>"
LOGS = f"request_id string, received_at timestamp, raw_size long, parse_bypassed boolean, records array<struct<{PARTS},record_raw:binary>>"


@dataclass
class Layout:
    """Where everything stands in the requests of a batch: one row a node, with the index of its parent. Text -1: no string."""

    groups: np.ndarray  # request, start of the tag, lo, hi
    scopes: np.ndarray  # group, start, lo, hi
    records: np.ndarray  # scope, start, lo, hi
    bodies: np.ndarray  # by record: start, lo, hi of the value; start, lo, hi of its string
    attrs: np.ndarray  # record; start, lo, hi of the pair, of its value, of its string
    keys: np.ndarray  # by attribute: lo, hi
    trace: np.ndarray  # by record: lo, hi
    severity: np.ndarray  # by record, and whether there is one
    names: np.ndarray  # by group: lo, hi of the namespace; lo, hi of the service
    odd: np.ndarray  # by record: a value holds bytes behind its string that can't be read, so the record can't be written anew
    bad: np.ndarray  # by request


def _equal(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: bytes) -> np.ndarray:
    out = hi - lo == len(text)
    at = np.flatnonzero(out)
    out[at] = (buf[lo[at][:, None] + np.arange(len(text))] == np.frombuffer(text, dtype=np.uint8)).all(axis=1)
    return out


def _strings(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values: (start, lo, hi) of the first string, -1 if there is none; whether reading fails before it; whether it does behind it."""
    inner = walk(buf, lo, hi)
    found = inner.messages(STRING)
    first = first_of(found.of, len(lo))
    where = np.stack([found.start, found.lo, found.hi], axis=1)[first] if len(found.of) else np.full((len(lo), 3), -1)
    where[first < 0] = -1
    return where, inner.bad & (first < 0), inner.bad & (first >= 0)


def _pairs(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: (lo, hi) of the key, (start, lo, hi, start, lo, hi) of the value and its string (-1: none of either); failed; odd."""
    inner = walk(buf, lo, hi)
    keys, values = inner.messages(KEY), inner.messages(VALUE)
    text, failed, behind = _strings(buf, values.lo, values.hi)
    bad, odd = inner.bad.copy(), np.zeros(len(lo), dtype=bool)
    bad[values.of[failed]] = True
    odd[values.of[behind]] = True
    key, value = last_of(keys.of, len(lo)), last_of(values.of, len(lo))
    at = np.full((len(lo), 2), -1)
    at[key >= 0] = np.stack([keys.lo, keys.hi], axis=1)[key[key >= 0]]
    both = np.full((len(lo), 6), -1)
    have = np.flatnonzero((value >= 0) & (key >= 0))
    if len(have):
        both[have] = np.concatenate([np.stack([values.start, values.lo, values.hi], axis=1), text], axis=1)[value[have]]
    both[both[:, 3] < 0] = -1
    return at, both, bad, odd


def layout(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Layout:
    """All requests buf[lo:hi] at once, with the meaning that parse() gives them."""
    top = walk(buf, lo, hi)
    bad = top.bad.copy()
    g = top.messages(RESOURCE_LOGS)
    inner = walk(buf, g.lo, g.hi)
    bad[g.of[inner.bad]] = True
    resources, s = inner.messages(RESOURCE), inner.messages(SCOPE_LOGS)
    # Attributes of resources; the last resource of a group counts, and in it the last pair of a name.
    rows = walk(buf, resources.lo, resources.hi)
    bad[g.of[resources.of[rows.bad]]] = True
    p = rows.messages(ATTRIBUTES)
    key, value, failed, _ = _pairs(buf, p.lo, p.hi)
    bad[g.of[resources.of[p.of[failed]]]] = True
    final = last_of(resources.of, len(g.of))
    names = np.full((len(g.of), 4), -1)
    counts = np.flatnonzero((value[:, 0] >= 0) & (final[resources.of[p.of]] == p.of)) if len(p.of) else np.zeros(0, np.int64)
    for k, name in ((0, NAMESPACE), (2, SERVICE)):
        hit = counts[_equal(buf, key[counts, 0], key[counts, 1], name)] if len(counts) else counts
        names[resources.of[p.of[hit]], k : k + 2] = value[hit, 4:6]
    inner = walk(buf, s.lo, s.hi)
    bad[g.of[s.of[inner.bad]]] = True
    r = inner.messages(LOG_RECORDS)
    request = g.of[s.of[r.of]]
    inner = walk(buf, r.lo, r.hi)
    bad[request[inner.bad]] = True
    n = len(r.of)
    severity = np.zeros((n, 2), dtype=np.int64)
    some = inner.where((inner.number == SEVERITY) & (inner.wire == VARINT))
    severity[some.of, 0] = (some.value & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    severity[some.of, 1] = 1
    trace = np.full((n, 2), -1)
    some = inner.messages(TRACE_ID)
    some = some.where(np.isin(some.hi - some.lo, (16, 32)))
    trace[some.of] = np.stack([some.lo, some.hi], axis=1)
    odd = np.zeros(n, dtype=bool)
    b = inner.messages(BODY)
    text, failed, behind = _strings(buf, b.lo, b.hi)
    bad[request[b.of[failed]]] = True
    odd[b.of[behind]] = True
    bodies = np.full((n, 6), -1)
    have = text[:, 0] >= 0
    bodies[b.of[have]] = np.concatenate([np.stack([b.start, b.lo, b.hi], axis=1), text], axis=1)[have]
    a = inner.messages(RECORD_ATTRIBUTES)
    key, value, failed, behind = _pairs(buf, a.lo, a.hi)
    bad[request[a.of[failed]]] = True
    odd[a.of[behind]] = True
    have = value[:, 3] >= 0
    attrs = np.concatenate([np.stack([a.of, a.start, a.lo, a.hi], axis=1), value], axis=1)[have]
    node = lambda f: np.stack([f.of, f.start, f.lo, f.hi], axis=1)
    return Layout(node(g), node(s), node(r), bodies, attrs, key[have], trace, severity, names, odd, bad)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each value begins and ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, places, data = column.buffers()
    ends = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return buf, ends[:-1], ends[1:]


def _slices(buf: np.ndarray, where: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Ranges as values, null where negative; text that is not UTF-8 has marks in place of what can't be read."""
    there = where[:, 0] >= 0
    size = np.where(there, where[:, 1] - where[:, 0], 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(where[:, 0] - ends[:-1], size) + np.arange(ends[-1])]
    nulls = pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    out = pa.Array.from_buffers(pa.binary(), len(where), [nulls, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    if kind != pa.string():
        return out
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in out.to_pylist()], pa.string())


def _record_column(buf: np.ndarray, at: Layout, requests: int, whole: bool) -> pa.Array:
    """The records of each request, in order, as parse() gives them; a malformed request has none."""
    data = buf
    group = at.scopes[at.records[:, 0], 0] if len(at.records) else np.zeros(0, np.int64)
    request = at.groups[group, 0] if len(group) else group
    ok = ~at.bad[request] if len(request) else np.zeros(0, bool)
    kept = np.flatnonzero(ok)
    mine = at.attrs[:, 0]
    attr_ok = ok[mine] if len(mine) else np.zeros(0, bool)
    names = at.names[group[kept]] if len(kept) else np.zeros((0, 4), np.int64)
    attr_count = np.bincount(mine[attr_ok], minlength=len(ok))[kept] if len(ok) else np.zeros(0, np.int64)
    pair = pa.StructArray.from_arrays([_slices(data, at.keys[attr_ok], pa.string()), _slices(data, at.attrs[attr_ok][:, 8:10], pa.binary())], names=["key", "value"])
    fields = {
        "body": _slices(data, at.bodies[kept][:, 4:6], pa.binary()), "trace_id": _slices(data, at.trace[kept], pa.binary()), "severity_number": pa.array(at.severity[kept, 0], pa.int32(), mask=at.severity[kept, 1] == 0),
        "namespace": _slices(data, names[:, 0:2], pa.string()), "service_name": _slices(data, names[:, 2:4], pa.string()),
        "attrs": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(attr_count)]), pa.int32()), pair),
    }
    if whole:
        fields["record_raw"] = _slices(data, at.records[kept][:, 2:4], pa.binary())
    records = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    count = np.bincount(request[kept], minlength=requests) if len(kept) else np.zeros(requests, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), records)


def decode_requests(requests: DataFrame) -> DataFrame:
    """requests (request_id, raw, received_at) with their records as an array; a malformed request has none and parse_bypassed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 2, 1 << 23):
                buf, lo, hi = _buffer(batch.column(2))
                at = layout(buf, lo, hi)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hi - lo, pa.int64()), pa.array(at.bad), _record_column(buf, at, len(batch), True)], names=["request_id", "received_at", "raw_size", "parse_bypassed", "records"])

    rows = requests.select(F.col("request_id").cast("string").alias("request_id"), F.col("received_at").cast("timestamp").alias("received_at"), "raw")
    return rows.mapInArrow(run, LOGS)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes in a binary column, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def records(decoded: DataFrame) -> DataFrame:
    """One row for each record; body is text (null where its bytes are not UTF-8), body_raw the bytes; attribute values that are not UTF-8 have marks."""
    rows = decoded.select("request_id", "received_at", F.posexplode("records").alias("record_idx", "r"))
    text = F.col("r.body").cast("string")
    attrs = F.transform("r.attrs", lambda a: F.struct(a["key"].alias("key"), F.make_valid_utf8(a["value"].cast("string")).alias("value")))
    return rows.select(
        "request_id", "record_idx", "received_at", F.when(F.is_valid_utf8(text), text).alias("body"), F.col("r.body").alias("body_raw"), "r.trace_id", "r.severity_number", "r.namespace", "r.service_name", attrs.alias("attrs"), "r.record_raw",
    )


def decode(requests: DataFrame) -> DataFrame:
    return records(decode_requests(requests))


def within_limit(requests: DataFrame, most: int, framed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Requests up to the size limit, and the others. framed: five more bytes are allowed."""
    ok = F.coalesce(F.octet_length("raw") <= most + (5 if framed else 0), F.lit(False))
    return requests.where(ok), requests.where(~ok)


def read_payloads(spark: SparkSession, path: str, pattern: str = "*.otlp") -> DataFrame:
    """Landed payload files as requests (request_id: the file's whole path, as names may repeat in other folders)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("request_id"), F.col("modificationTime").alias("received_at"), F.col("content").alias("raw"))


OUT = "request_id string, received_at timestamp, payload binary, records_in long, kept long, dropped long, redactions long, bytes_in long, bytes_out long, parse_bypassed boolean, redact_bypassed boolean, assemble_bypassed boolean"
#: What the writer gets: the request, and what was decided for each record. new, values: null where nothing changes.
DECIDED = "request_id", "received_at", "raw", "parse_bypassed", "keep", "new", "values", "n"


def govern_payloads(requests: DataFrame, policy: CompiledPolicy, redact: bool = True) -> DataFrame:
    """Payloads in, governed payloads and their stats out (OUT). What can't be read or written back leaves as it came.

    A request stays a row all the way, without an exchange: its records are an array, decisions are expressions over it, and they
    are written into its bytes. redact=False: as with an open circuit breaker, redaction is bypassed; sampling is not.
    """
    rows = requests.select(F.col("request_id").cast("string").alias("request_id"), F.col("received_at").cast("timestamp").alias("received_at"), "raw")
    kind = f"request_id string, received_at timestamp, raw binary, parse_bypassed boolean, records array<struct<{PARTS}>>"
    decided = rows.mapInArrow(_read, kind).withColumn("d", F.transform("records", lambda r: _decided(r, policy, redact)))
    columns = ["request_id", "received_at", "raw", "parse_bypassed", *[F.col(f"d.{c}").alias(c) for c in DECIDED[4:]]]
    return decided.select(*columns).mapInArrow(_writer(redact), OUT)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_bytes(whole, 2, 1 << 23):
            buf, lo, hi = _buffer(batch.column(2))
            at = layout(buf, lo, hi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.bad), _record_column(buf, at, len(batch), False)], names=["request_id", "received_at", "raw", "parse_bypassed", "records"])


def _decided(r: Column, policy: CompiledPolicy, redact: bool) -> Column:
    """struct<keep, new, values, n> of a record: what the policy says of it. Text of dropped records is not put together, its matches count."""
    keep = kept(policy, r["namespace"], r["severity_number"], r["trace_id"], r["service_name"], r["body"])
    nothing = F.struct(keep.alias("keep"), F.lit(None).cast("binary").alias("new"), F.lit(None).cast("array<binary>").alias("values"), F.lit(0).cast("long").alias("n"))
    if not redact:
        return nothing

    def with_keep(ok: Column) -> Column:
        body = redacted_bytes(r["body"], body_rules(policy), None, ok)
        attrs = redacted_attributes(r["attrs"], policy, ok, binary=True)

        if attrs is None:
            return let(body, lambda b: F.struct(ok.alias("keep"), b["new"].alias("new"), F.lit(None).cast("array<binary>").alias("values"), b["n"].alias("n")))

        def done(x: Column) -> Column:
            n = total(x["a"])
            values = F.when(n > 0, F.transform(x["a"], lambda a: F.when(a["n"] > 0, a["value"])))
            return F.struct(ok.alias("keep"), x["b"]["new"].alias("new"), values.alias("values"), (x["b"]["n"] + n).alias("n"))

        return let(F.struct(body.alias("b"), attrs.alias("a")), done)

    return let(keep, with_keep)


def rewritten(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: Layout, drop: np.ndarray, body: dict[int, bytes], values: dict[int, bytes]) -> list[bytes]:
    """The requests without the dropped records and with the new strings (body: by record, values: by attribute); all else stays byte by byte.

    Lengths change from the strings up. Requests with records that can't be written anew are left out by the caller.
    """
    record_of = at.records[:, 0]
    change: dict[int, int] = {}
    # (request, from, to, what comes instead)
    edits: list[tuple[int, int, int, bytes]] = []
    request = at.groups[at.scopes[record_of, 0], 0] if len(at.records) else np.zeros(0, np.int64)

    def resize(owner: int, number: int, start: int, a: int, b: int, more: int) -> int:
        """A field's new header; by how much the field grows."""
        head = header(number, b - a + more)
        edits.append((owner, start, a, head))
        return more + len(head) - (a - start)

    for k, new in body.items():
        if not drop[k]:
            owner = int(request[k])
            vs, va, vb, ts, ta, tb = at.bodies[k].tolist()
            edits.append((owner, ta, tb, new))
            more = resize(owner, STRING, ts, ta, tb, len(new) - (tb - ta))
            change[k] = resize(owner, BODY, vs, va, vb, more)
    for k, new in values.items():
        record, ps, pa_, pb, vs, va, vb, ts, ta, tb = at.attrs[k].tolist()
        if not drop[record]:
            owner = int(request[record])
            edits.append((owner, ta, tb, new))
            more = resize(owner, STRING, ts, ta, tb, len(new) - (tb - ta))
            more = resize(owner, VALUE, vs, va, vb, more)
            change[record] = change.get(record, 0) + resize(owner, RECORD_ATTRIBUTES, ps, pa_, pb, more)
    scope_change = np.zeros(len(at.scopes), dtype=np.int64)
    touched = np.zeros(len(at.scopes), dtype=bool)
    for k, more in change.items():
        scope, start, a, b = at.records[k].tolist()
        scope_change[scope] += resize(int(request[k]), LOG_RECORDS, start, a, b, more)
        touched[scope] = True
    gone = np.flatnonzero(drop)
    if len(gone):
        scope, start, _, end = at.records[gone].T
        edits.extend(zip(request[gone].tolist(), start.tolist(), end.tolist(), [b""] * len(gone), strict=True))
        np.subtract.at(scope_change, scope, end - start)
        touched[scope] = True
    group_change = np.zeros(len(at.groups), dtype=np.int64)
    for k in np.flatnonzero(touched).tolist():
        group, start, a, b = at.scopes[k].tolist()
        group_change[group] += resize(int(at.groups[group, 0]), SCOPE_LOGS, start, a, b, int(scope_change[k]))
    for k in np.unique(at.scopes[touched, 0]).tolist():
        owner, start, a, b = at.groups[k].tolist()
        resize(owner, RESOURCE_LOGS, start, a, b, int(group_change[k]))
    edits.sort()
    data = memoryview(buf)
    out = [data[a:b].tobytes() if not edits else None for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    k = 0
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out[i] is None:
            parts, done = [], a
            while k < len(edits) and edits[k][0] == i:
                _, start, stop, new = edits[k]
                parts += [data[done:start], new]
                done = stop
                k += 1
            out[i] = b"".join([*parts, data[done:b]])
    return out


def _writer(redact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flat(column: pa.ListArray) -> pa.Array:
        return column.flatten()

    def there(at: np.ndarray, new: pa.Array, pairs: bool = False) -> dict[int, object] | list[tuple[int, object]]:
        """The values that are not null, by their owner's number."""
        have = new.is_valid().to_numpy(zero_copy_only=False)
        both = zip(at[have].tolist(), new.filter(pa.array(have)).to_pylist(), strict=True)
        return list(both) if pairs else dict(both)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, lo, hi = _buffer(batch.column(2))
        at = layout(buf, lo, hi)
        n = len(batch)
        group = at.scopes[at.records[:, 0], 0] if len(at.records) else np.zeros(0, np.int64)
        request = at.groups[group, 0] if len(group) else group
        sound = np.flatnonzero(~at.bad[request]) if len(request) else request
        drop, count = np.zeros(len(request), dtype=bool), np.zeros(len(request), dtype=np.int64)
        drop[sound] = ~flat(batch.column(4)).fill_null(True).to_numpy(zero_copy_only=False)
        count[sound] = flat(batch.column(7)).to_numpy(zero_copy_only=False)
        body = there(sound, flat(batch.column(5)))
        values: dict[int, bytes] = {}
        first = np.searchsorted(at.attrs[:, 0], sound)
        for a, new in there(first, flat(batch.column(6)), pairs=True):
            values |= {a + j: x for j, x in enumerate(new) if x is not None}
        # A record that can't be written anew takes its whole request along, where anything in it would change.
        changes = drop.copy()
        changes[list(body)] = True
        changes[at.attrs[list(values), 0]] = True
        stuck = np.zeros(n, dtype=bool)
        stuck[request[at.odd & ~drop]] = True
        any_change = np.zeros(n, dtype=bool)
        any_change[request[changes]] = True
        stuck &= any_change & ~at.bad
        if stuck.any():
            body = {k: x for k, x in body.items() if not stuck[request[k]]}
            values = {k: x for k, x in values.items() if not stuck[request[at.attrs[k, 0]]]}
        payload = rewritten(buf, lo, hi, at, drop & ~stuck[request] if len(request) else drop, body, values)
        total_of = lambda x: np.bincount(request, weights=x, minlength=n).astype(np.int64) if len(request) else np.zeros(n, np.int64)
        inside = np.zeros(len(request), dtype=np.int64)
        inside[sound] = 1
        whole, gone = total_of(inside), total_of((drop & (inside > 0)).astype(np.int64))
        columns = [whole, whole - gone, gone, total_of(count), hi - lo, np.array([len(x) for x in payload], dtype=np.int64)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payload, pa.binary()), *[pa.array(c, pa.int64()) for c in columns], pa.array(at.bad), pa.array((~at.bad) & (not redact)), pa.array(stuck)], names=NAMES)

    def as_it_came(batch: pa.RecordBatch) -> pa.RecordBatch:
        """What stands in where writing fails: each request alone, and one that fails alone leaves unchanged."""
        raw = [x or b"" for x in batch.column(2).to_pylist()]
        zero = pa.array([0] * len(raw), pa.int64())
        records = pa.array([len(x or ()) for x in batch.column(4).to_pylist()], pa.int64())
        size = pa.array([len(x) for x in raw], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), records, records, zero, zero, size, size, batch.column(3), pa.array([not redact] * len(raw)), pa.array([True] * len(raw))], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 2, 1 << 23):
                got = guarded(lambda b=batch: one(b), lambda: None).value
                if got is not None:
                    yield got
                    continue
                for k in range(len(batch)):
                    alone = batch.slice(k, 1)
                    yield guarded(lambda b=alone: one(b), lambda b=alone: as_it_came(b)).value

    return run


NAMES = [x.split()[0] for x in OUT.split(", ")]


def _cut(buf: bytes, where: Range | None) -> bytes | None:
    return None if where is None else buf[slice(*where)]


def _text(buf: bytes, where: Range | None) -> str | None:
    return None if where is None else buf[slice(*where)].decode("utf-8", "replace")


def register(spark: SparkSession, name: str = "otlp_logs") -> None:
    """The decoder as a table function: SELECT ... FROM t, LATERAL otlp_logs(t.raw). And sample_bucket(trace_id) as a SQL function."""
    from pyspark.sql.functions import udtf

    class Logs:
        def eval(self, raw: bytes):  # noqa: ANN201
            try:
                found = parse(bytes(raw or b""))
            except ParseError:
                return
            for i, r in enumerate(found):
                yield i, _text(raw, r.body), _cut(raw, r.trace_id), r.severity, _text(raw, r.namespace), _text(raw, r.service)

    spark.udtf.register(name, udtf(Logs, returnType="record_idx int, body string, trace_id binary, severity_number int, namespace string, service_name string"))
    from logsluice.functions.hashing import ZERO_SEED

    h = f"xxhash64(CAST({ZERO_SEED} AS BIGINT), t)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sample_bucket(t BINARY) RETURNS INT RETURN CASE WHEN t IS NULL THEN NULL ELSE CAST((shiftrightunsigned({h}, 1) % 50) * 2 + ({h} & 1) AS INT) END")
