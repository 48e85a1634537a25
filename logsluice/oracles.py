"""DuckDB SQL for the queries of the log engine."""

from __future__ import annotations

import re

from logsluice.functions.hashing import P1, P2, P3, P4, P5
from logsluice.sources.logs import LOGS_SQL, REQUEST_LOGS_SQL, requests_hex

ORACLES: dict[str, str] = {}
U = "::UHUGEINT"
W = f"18446744073709551616{U}"
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
    ("card", "[0-9]{13,16}", "[CARD]"), ("phone", r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[$PHONE]"),
]
LOGS = f"logs AS ({LOGS_SQL})"
TARGET = "CASE WHEN namespace LIKE 'security-audit' THEN 100 WHEN namespace LIKE 'payments' THEN 100 WHEN severity_number <= 8 THEN 10 WHEN namespace LIKE 'batch-%' THEN 25 ELSE 50 END"


def rot(x: str, r: int) -> str:
    return f"((({x}) * {1 << r}{U}) % {W} + (({x}) >> {64 - r}{U}))"


def mul(a: str, p: int) -> str:
    return f"(({a}) * {p}{U} % {W})"


def add(a: str, b: str) -> str:
    return f"((({a}) + {b}) % {W})"


def le(col: str, at: str, n: int) -> str:
    """n bytes at byte `at` of a column of hexadecimal digits, little end first."""
    return "('0x' || " + " || ".join(f"substr({col}, ({at}) * 2 + {2 * k + 1}, 2)" for k in range(n - 1, -1, -1)) + f")::UBIGINT{U}"


def avalanche(source: str, keep: str) -> str:
    return f"""
a1 AS (SELECT {keep}, {mul("xor(h, h >> 33" + U + ")", P2)} AS h FROM {source}),
a2 AS (SELECT {keep}, {mul("xor(h, h >> 29" + U + ")", P3)} AS h FROM a1),
hashed AS (SELECT {keep}, CAST(xor(h, h >> 32{U}) % 100{U} AS BIGINT) AS bucket FROM a2)"""


def traced() -> str:
    """hashed (event_id, bucket): of 16 bytes, the trace id."""
    steps = [f"w0 AS (SELECT event_id, {mul(le('trace_hex', '0', 8), P2)} AS x1, {mul(le('trace_hex', '8', 8), P2)} AS x2 FROM logs WHERE trace_hex IS NOT NULL)"]
    steps.append(f"w1 AS (SELECT event_id, {mul(rot('x1', 31), P1)} AS k1, {mul(rot('x2', 31), P1)} AS k2 FROM w0)")
    steps.append(f"w2 AS (SELECT event_id, k2, xor({(P5 + 16) % (1 << 64)}{U}, k1) AS y FROM w1)")
    steps.append(f"w3 AS (SELECT event_id, xor({add(mul(rot('y', 27), P1), f'{P4}{U}')}, k2) AS z FROM w2)")
    steps.append(f"w4 AS (SELECT event_id, {add(mul(rot('z', 27), P1), f'{P4}{U}')} AS h FROM w3)")
    return f"{LOGS},\n" + ",\n".join(steps) + "," + avalanche("w4", "event_id")


def untraced() -> str:
    """hashed (event_id, bucket): of any number of bytes, service and body."""
    start = "SELECT event_id, lower(hex(encode(service_name)) || '00' || hex(encode(body))) AS kh FROM logs WHERE trace_hex IS NULL"
    return f"{LOGS},\n{chain(start)}," + avalanche("c3", "event_id")


def chain(start: str) -> str:
    """CTEs up to c3 (event_id, h): the hash, but for its last mixing, of kh (lower-case digits) of any length."""

    def lane(a: str, x: str) -> str:
        return mul(rot(add(a, f"({x}) * {P2}{U}"), 31), P1)

    seeds = [(P1 + P2) % (1 << 64), P2, 0, (1 << 64) - P1]
    steps = [f"b0 AS ({start})", "b1 AS (SELECT *, length(kh) // 2 AS n FROM b0)"]
    for j, seed in enumerate(seeds):
        steps.append(f"v{j} AS (SELECT *, list_reduce(list_transform(range(0, n // 32), lambda i: {le('kh', f'i * 32 + {8 * j}', 8)}), lambda a, l: {lane('a', 'l')}, {seed}{U}) AS l{j} FROM {'b1' if j == 0 else f'v{j - 1}'})")
    steps.append(f"q0 AS (SELECT *, ({rot('l0', 1)} + {rot('l1', 7)} + {rot('l2', 12)} + {rot('l3', 18)}) % {W} AS q FROM v3)")
    for j in range(4):
        merged = add(mul(f"xor(q, {lane(f'0{U}', f'l{j}')})", P1), f"{P4}{U}")
        steps.append(f"q{j + 1} AS (SELECT * REPLACE ({merged} AS q) FROM q{j})")
    steps.append(f"c0 AS (SELECT event_id, kh, n, (CASE WHEN n >= 32 THEN q ELSE {P5}{U} END + n{U}) % {W} AS h, n // 32 * 32 AS place, n % 32 // 8 AS words FROM q4)")
    steps.append(f"c1 AS (SELECT event_id, kh, n, place + 8 * words AS place, list_reduce(list_transform(range(0, words), lambda i: {le('kh', 'place + i * 8', 8)}), lambda a, l: {add(mul(rot(f'xor(a, {lane(f"0{U}", "l")})', 27), P1), f'{P4}{U}')}, h) AS h FROM c0)")
    steps.append(f"c2 AS (SELECT event_id, kh, n, CASE WHEN n - place >= 4 THEN place + 4 ELSE place END AS place, CASE WHEN n - place >= 4 THEN {add(mul(rot('xor(h, ' + mul(le('kh', 'place', 4), P1) + ')', 23), P2), f'{P3}{U}')} ELSE h END AS h FROM c1)")
    steps.append(f"c3 AS (SELECT event_id, list_reduce(list_transform(range(place, n), lambda i: {le('kh', 'i', 1)}), lambda a, l: {mul(rot('xor(a, ' + mul('l', P5) + ')', 11), P1)}, h) AS h FROM c2)")
    return ",\n".join(steps)


def every() -> str:
    """hashed (event_id, bucket) of traced and untraced records."""
    parts = [re.sub(r"\b(a1|a2|hashed)\b", rf"\1_{k}", f().removeprefix(f"{LOGS},\n")) for k, f in (("t", traced), ("u", untraced))]
    return f"{LOGS},\n{parts[0]},\n{parts[1]},\nhashed AS (SELECT * FROM hashed_t UNION ALL SELECT * FROM hashed_u)"


def spliced(source: str, key: str, text: str, rules: list[tuple[str, str, str]] | None = None) -> str:
    """redacted (key, out): the rules' matches resolved by start, end, rule, and replaced. source has key and text."""
    rules = rules or RULES
    found = []
    for k, (_, p, _) in enumerate(rules):
        found.append(f"SELECT {key}, {k} AS r, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS j FROM (SELECT {key}, regexp_extract_all({text}, '{p}') AS ms, string_split_regex({text}, '{p}') AS gs FROM {source}) x")
    masks = "[" + ", ".join(f"'{m}'" for *_, m in rules) + "]"
    return f"""
found AS ({" UNION ALL ".join(f"({x})" for x in found)}),
placed AS (SELECT {key}, r, m, sum(length(g) + length(m)) OVER (PARTITION BY {key}, r ORDER BY j) AS e FROM found),
ranked AS (SELECT {key}, r, e - length(m) AS s, e, row_number() OVER (PARTITION BY {key} ORDER BY e - length(m), e, r) AS k FROM placed),
walked AS (SELECT {key}, 0::BIGINT AS k, 0::HUGEINT AS cur, '' AS out, {text} AS t FROM {source} UNION ALL
  SELECT w.{key}, w.k + 1, CASE WHEN x.s < w.cur THEN w.cur ELSE x.e END, CASE WHEN x.s < w.cur THEN w.out ELSE w.out || substr(w.t, (w.cur + 1)::BIGINT, (x.s - w.cur)::BIGINT) || ({masks})[x.r + 1] END, w.t
  FROM walked w JOIN ranked x ON x.{key} = w.{key} AND x.k = w.k + 1),
redacted AS (SELECT {key}, max_by(out || substr(t, (cur + 1)::BIGINT), k) AS out FROM walked GROUP BY {key})"""


ORACLES["sample_bucket"] = f"WITH {traced()} SELECT event_id, bucket FROM hashed"
ORACLES["policy_target"] = f"WITH {LOGS} SELECT event_id, {TARGET} AS target FROM logs"
ORACLES["sample_keep_traced"] = f"WITH {traced()} SELECT event_id, target FROM (SELECT event_id, {TARGET} AS target FROM logs) JOIN hashed USING (event_id) WHERE bucket < target"
ORACLES["sample_keep_untraced"] = f"WITH {untraced()} SELECT event_id, bucket, bucket < target AS keep FROM (SELECT event_id, {TARGET} AS target FROM logs) JOIN hashed USING (event_id)"
ORACLES["policy_rule_table_join"] = f"""WITH {LOGS}, rules(idx, g, s, t) AS (VALUES (0, 'security-audit', NULL, 100), (1, 'payments', NULL, 100), (2, NULL, 8, 10), (3, 'batch-%', NULL, 25))
SELECT event_id, coalesce(arg_min(t, idx), 50)::INTEGER AS target FROM logs LEFT JOIN rules ON coalesce(g IS NULL OR namespace LIKE g, false) AND coalesce(s IS NULL OR severity_number <= s, false) GROUP BY event_id"""
ORACLES["severity_band_counts"] = f"""WITH {LOGS} SELECT CASE WHEN severity_number IS NULL THEN 'NONE' WHEN severity_number <= 4 THEN 'TRACE' WHEN severity_number <= 8 THEN 'DEBUG' WHEN severity_number <= 12 THEN 'INFO'
 WHEN severity_number <= 16 THEN 'WARN' WHEN severity_number <= 20 THEN 'ERROR' WHEN severity_number <= 24 THEN 'FATAL' ELSE 'OTHER' END AS band, count(*) AS n FROM logs GROUP BY ALL"""
ORACLES["namespace_keep_rate"] = f"""WITH {every()} SELECT namespace, count(*) AS records, sum((bucket < target)::INT)::BIGINT AS kept, (sum((bucket < target)::INT) * 10000 // count(*))::BIGINT AS rate_bp
FROM (SELECT event_id, namespace, {TARGET} AS target FROM logs) JOIN hashed USING (event_id) GROUP BY namespace"""
ORACLES["trace_id_normalise"] = f"""WITH {LOGS}, odd AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN upper(trace_hex) WHEN 1 THEN substr(trace_hex, 1, 16) WHEN 2 THEN 'zz' || substr(trace_hex, 3, 30) WHEN 3 THEN substr(trace_hex, 1, 5) ELSE trace_hex END AS t FROM logs)
SELECT event_id, CASE WHEN length(t) = 16 THEN lower(hex(encode(t))) WHEN regexp_full_match(t, '[0-9A-Fa-f]{{32}}') THEN lower(t) END AS trace_id FROM odd"""
ORACLES["glob_match"] = f"""WITH {LOGS} SELECT event_id, namespace IS NOT NULL AS "any", coalesce(starts_with(namespace, 'batch-'), false) AS batch, coalesce(suffix(namespace, '-audit'), false) AS audit,
 coalesce(contains(namespace, '-'), false) AS "inner", coalesce(namespace = 'web', false) AS exact, coalesce(namespace = 'we_', false) AS under FROM logs"""
ORACLES["redact_email_documents"] = f"SELECT doc_id, regexp_replace(text, '{RULES[0][1]}', '[EMAIL]', 'g') AS text FROM documents"
ORACLES["redact_multi_documents"] = f"WITH RECURSIVE {spliced('documents', 'doc_id', 'text')} SELECT doc_id, out AS text FROM redacted"
ORACLES["redact_attrs"] = f"""WITH {LOGS}, attrs AS (SELECT event_id, body, regexp_extract(body, '^user ([0-9]+)', 1) AS u FROM logs),
rows AS (SELECT event_id, 'user.email' AS key, regexp_replace('u' || u || '@corp.io', '{RULES[0][1]}', '[EMAIL]', 'g') AS value FROM attrs UNION ALL SELECT event_id, 'http.method', 'POST' FROM attrs
 UNION ALL SELECT event_id, 'request.note', regexp_replace(body, '{RULES[1][1]}', '[IP]', 'g') FROM attrs) SELECT * FROM rows"""
ORACLES["redaction_rule_counts"] = " UNION ALL ".join(f"SELECT '{n}' AS rule, coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0)::BIGINT AS matches FROM documents" for n, p, _ in RULES)
ORACLES["detect_pii_pages"] = "SELECT page_id, " + ", ".join(f"coalesce(regexp_matches(html, '{p}'), false) AS {n}" for n, p, _ in RULES) + " FROM pages"
_any = "|".join(f"(?:{p})" for _, p, _ in RULES)
ORACLES["prefilter_hits"] = " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n, count(*) FILTER (regexp_matches({c}, '{_any}')) AS hits FROM {t}" for t, c in (("documents", "text"), ("conversations", "text"), ("benchmark", "text"), ("pages", "html")))
_GOVERNED = f"{every()}, decided AS (SELECT l.event_id, l.request_id, l.received_at, l.namespace, l.body, bucket < {TARGET} AS keep FROM logs l JOIN hashed USING (event_id)), {spliced('decided', 'event_id', 'body')}"
_EMAIL, _NOTE = "'u' || regexp_extract(body, '^user ([0-9]+)', 1) || '@corp.io'", "body"
_COUNTED = f"""counted AS (SELECT event_id, sum(n)::BIGINT AS n FROM (SELECT event_id, count(*) AS n FROM found GROUP BY event_id
 UNION ALL SELECT event_id, len(regexp_extract_all({_EMAIL}, '{RULES[0][1]}')) + len(regexp_extract_all({_NOTE}, '{RULES[1][1]}')) FROM logs) GROUP BY event_id)"""
_ATTRS = f"""'user.email=' || regexp_replace({_EMAIL.replace('body', 'd.body')}, '{RULES[0][1]}', '[EMAIL]', 'g') || chr(10) || 'http.method=POST' || chr(10)
 || 'request.note=' || regexp_replace(d.{_NOTE}, '{RULES[1][1]}', '[IP]', 'g')"""
ORACLES["govern_logs"] = f"WITH RECURSIVE {_GOVERNED} SELECT d.event_id, d.request_id, d.namespace, r.out AS body, {_ATTRS} AS attrs FROM decided d JOIN redacted r USING (event_id) WHERE keep"
ORACLES["stream_govern"] = ORACLES["stream_govern_batches"] = ORACLES["govern_logs"]
_STATS = f"""{_GOVERNED}, {_COUNTED},
stats AS (SELECT request_id, min(received_at) AS received_at, count(*) AS records_in, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, sum(coalesce(n, 0))::BIGINT AS redactions,
 sum(strlen(body))::BIGINT AS bytes_in, coalesce(sum(strlen(out)) FILTER (keep), 0)::BIGINT AS bytes_out FROM decided JOIN redacted USING (event_id) LEFT JOIN counted USING (event_id) GROUP BY request_id)"""
ORACLES["request_stats"] = f"WITH RECURSIVE {_STATS} SELECT * EXCLUDE (received_at) FROM stats"
ORACLES["bytes_saved"] = f"WITH RECURSIVE {_STATS} SELECT sum(greatest(bytes_in - bytes_out, 0))::BIGINT AS saved, sum(bytes_in - bytes_out)::BIGINT AS net FROM stats"
_SUMS = [
    "sum(records_in)::BIGINT AS events_in", "sum(dropped)::BIGINT AS events_sampled_out", "sum(kept)::BIGINT AS events_exported", "sum(bytes_in)::BIGINT AS bytes_in",
    "sum(greatest(bytes_in - bytes_out, 0))::BIGINT AS bytes_dropped", "sum(bytes_out)::BIGINT AS bytes_exported", "sum(redactions)::BIGINT AS redaction_count", "0::BIGINT AS failopen_count",
]
_WINDOWS = f"""{_STATS}, windows AS (SELECT epoch_ms(time_bucket(INTERVAL '10 seconds', received_at)) AS window_start_ms, epoch_ms(time_bucket(INTERVAL '10 seconds', received_at)) + 10000 AS window_end_ms,
 {', '.join(_SUMS)} FROM stats GROUP BY 1, 2)"""
_COUNTERS = [x.split(" AS ")[1] for x in _SUMS]
ORACLES["window_10s_aggregate"] = ORACLES["stream_window_10s"] = f"WITH RECURSIVE {_WINDOWS} SELECT * FROM windows"
_FILLED = f"""{_WINDOWS}, ends AS (SELECT min(window_start_ms) AS lo, max(window_start_ms) AS hi FROM windows), numbers AS (SELECT lo, unnest(range(0, (hi - lo) // 10000 + 1)) AS i FROM ends),
filled AS (SELECT i::BIGINT AS seq, lo + i * 10000 AS window_start_ms, lo + i * 10000 + 10000 AS window_end_ms, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in _COUNTERS)}
 FROM numbers s LEFT JOIN windows w ON w.window_start_ms = lo + i * 10000)"""
ORACLES["window_10s_gapfill"] = f"WITH RECURSIVE {_FILLED} SELECT * FROM filled"
_JSON = " || ',' || ".join(f"'\"{c}\":' || {c}" for c in ["seq", *_COUNTERS])
ORACLES["aggregate_json"] = f"WITH RECURSIVE {_FILLED} SELECT '{{' || {_JSON} || '}}' AS json FROM filled"
_LINE = " || ' ' || ".join(f"'{c}=' || {c}" for c in ("seq", "events_in", "bytes_in", "redaction_count"))
ORACLES["aggregate_line"] = f"WITH RECURSIVE {_FILLED} SELECT {_LINE} AS line FROM filled"
ORACLES["spool_fifo_head"] = "WITH f AS (SELECT o_orderkey::BIGINT AS seq, o_custkey::BIGINT AS size FROM orders WHERE o_orderkey % 5 <> 0) SELECT min(seq) AS head, arg_min(size, seq) AS head_size, count(*) AS files, sum(size)::BIGINT AS bytes, max(seq) + 1 AS next_seq FROM f"
_size = "CASE " + " ".join(f"WHEN {{0}} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"
ORACLES["otlp_varint_size"] = f"WITH n AS (SELECT DISTINCT l_orderkey::BIGINT * l_orderkey * l_partkey AS value FROM lineitem) SELECT value, {_size.format('value')} AS varint, (1 + {_size.format('value')} + value)::BIGINT AS field FROM n"
ORACLES["grpc_frame_decode"] = f"""WITH {LOGS}, f AS (SELECT event_id, body, strlen(body) + CASE WHEN event_id % 11 = 0 THEN 9 ELSE 0 END AS n, event_id % 13 = 0 AS z FROM logs),
g AS (SELECT *, CASE WHEN z THEN 'compressed' WHEN n > strlen(body) + 4 THEN 'short' END AS error FROM f)
SELECT event_id, n::BIGINT AS length, CASE WHEN error IS NULL THEN body END AS message, error, CASE error WHEN 'compressed' THEN 12 WHEN 'short' THEN 3 ELSE 0 END AS status, CASE error WHEN 'compressed' THEN 415 WHEN 'short' THEN 400 ELSE 200 END AS http FROM g"""
# Requests of ten records, with the namespace and the service of the first; their bytes are written anew by SQL.
_REQUEST_LOGS = f"logs AS ({REQUEST_LOGS_SQL})"
ORACLES["otlp_decode"] = f"""WITH {_REQUEST_LOGS} SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY event_id) - 1 AS record_idx, body, trace_hex, severity_number, namespace, service_name,
 'user.email,request.note' AS keys, email, note FROM logs WHERE request_id % 97 <> 0"""
_HEX_JOINED = "string_agg(rec, '' ORDER BY event_id)"


def _numbered(ctes: str, suffix: str) -> str:
    """The same CTEs under other names."""
    return re.sub(r"\b(r\d+|requests)\b", rf"\1{suffix}", ctes).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def payloads(redact: bool) -> str:
    """The requests that leave, and their counts."""
    governed = f"{every().replace(LOGS, _REQUEST_LOGS)}, decided AS MATERIALIZED (SELECT l.*, bucket < {TARGET} AS keep FROM logs l JOIN hashed USING (event_id))"
    if redact:
        email, note = f"regexp_replace(email, '{RULES[0][1]}', '[EMAIL]', 'g')", f"regexp_replace(note, '{RULES[1][1]}', '[IP]', 'g')"
        governed += f""", {spliced('decided', 'event_id', 'body')}, new AS MATERIALIZED (SELECT d.* REPLACE (r.out AS body, {email} AS email, {note} AS note) FROM decided d JOIN redacted r USING (event_id)),
counted AS (SELECT event_id, sum(n)::BIGINT AS n FROM (SELECT event_id, count(*) AS n FROM found GROUP BY event_id
 UNION ALL SELECT event_id, len(regexp_extract_all(email, '{RULES[0][1]}')) + len(regexp_extract_all(note, '{RULES[1][1]}')) FROM logs) GROUP BY event_id)"""
    else:
        governed += ", new AS MATERIALIZED (SELECT * FROM decided), counted AS (SELECT event_id, 0::BIGINT AS n FROM decided)"
    before = _numbered(requests_hex("(SELECT * REPLACE (true AS keep) FROM decided)", _HEX_JOINED), "_in")
    after = _numbered(requests_hex("new", _HEX_JOINED), "_out")
    return f"""WITH RECURSIVE {governed}, {before}, {after},
counts AS (SELECT request_id, count(*) AS records_in, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, sum(n)::BIGINT AS redactions FROM decided JOIN counted USING (event_id) GROUP BY request_id),
whole AS (SELECT request_id, md5(o.digits) AS payload_md5, records_in, kept, dropped, redactions, length(i.digits) // 2 AS bytes_in, length(o.digits) // 2 AS bytes_out, false AS parse_bypassed
 FROM counts JOIN requests_in i USING (request_id) JOIN requests_out o USING (request_id) WHERE request_id % 97 <> 0),
cut AS (SELECT request_id, md5(digits[1:length(digits) - 6]) AS payload_md5, 0 AS records_in, 0 AS kept, 0 AS dropped, 0::BIGINT AS redactions, length(digits) // 2 - 3 AS bytes_in, length(digits) // 2 - 3 AS bytes_out, true AS parse_bypassed
 FROM requests_in WHERE request_id % 97 = 0),
every_request AS (SELECT * FROM whole UNION ALL SELECT * FROM cut)"""


ORACLES["otlp_govern_payloads"] = f"{payloads(True)} SELECT * FROM every_request"
ORACLES["otlp_open_breaker"] = f"{payloads(False)} SELECT request_id, payload_md5, records_in, kept, redactions, bytes_out, NOT parse_bypassed AS redact_bypassed FROM every_request"
ORACLES["attr_unnest"] = f"""WITH {LOGS} SELECT event_id, 0::BIGINT AS pos, 'user.email' AS key, 'u' || regexp_extract(body, '^user ([0-9]+)', 1) || '@corp.io' AS value FROM logs
 UNION ALL SELECT event_id, 1, 'http.method', 'POST' FROM logs UNION ALL SELECT event_id, 2, 'request.note', body FROM logs"""
ORACLES["latency_percentile"] = "SELECT round(quantile_cont(value, 0.99), 6) AS value FROM events"
ORACLES["latency_nearest_rank"] = "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE k = floor((n - 1) * 0.99 + 0.5)"
ORACLES["request_size_limit"] = "SELECT page_id, CASE WHEN strlen(html) <= 4000 THEN 'accepted' ELSE 'too_large' END AS verdict FROM pages"
ORACLES["content_type_gate"] = "SELECT page_id, page_id % 5 < 2 AS grpc FROM pages"
_synthetic = "WITH n AS (SELECT unnest(range(0, 5000)) AS id)"
ORACLES["synthetic_logs"] = f"""{_synthetic} SELECT id // 10 AS request_id, id % 10 AS record_idx, 1750000000000 + id AS at_ms, CASE WHEN id % 10 < 3
 THEN 'password reset mailed to guest' || id || '@mail.test, asked for by 192.168.' || id % 250 || '.17 in session=k' || id || 'q'
 ELSE 'cache refresh of shelf ' || id % 89 || ' took ' || id % 53 || ' ms, 4 pages written, none evicted, store healthy' END AS body, md5('1-' || id) AS trace_hex, 'library' AS namespace, 'rpc.method,user.contact' AS keys FROM n"""
ORACLES["rule_listing"] = " UNION ALL ".join(f"SELECT {k}::BIGINT AS idx, '{n}' AS name, '{m}' AS mask, {k}::BIGINT AS mask_idx, true AS listed" for k, (n, _, m) in enumerate(RULES))
_marks = "(VALUES ('', false), ('?', false), ('+', true), ('*', true), ('{2}', false), ('{2,}', true), ('{2,5}', false), ('+?', true))"
ORACLES["pattern_lint"] = f"SELECT item, a.m AS inner_mark, b.m AS outer_mark, a.e AND b.e AS rejected FROM (VALUES ('[0-9]'), ('m'), ('\\\\w'), ('(?:pq)')) i(item), {_marks} a(m, e), {_marks} b(m, e)"
_bands = "(VALUES ('trace', 4), ('debug', 8), ('info', 12), ('warn', 16), ('warning', 16), ('error', 20), ('fatal', 24)) b(n, m)"
ORACLES["severity_names"] = f"SELECT unnest([n, upper(n), upper(n[1]) || n[2:]]) AS name, m::BIGINT AS most FROM {_bands}"
ORACLES["varint_bytes"] = f"""WITH n AS (SELECT DISTINCT l_orderkey::BIGINT * l_partkey + l_suppkey AS value FROM lineitem)
SELECT value, array_to_string(list_transform(range(0, {_size.format('value')}), lambda i: lpad(hex(((value >> (7 * i)) & 127) + CASE WHEN i + 1 < {_size.format('value')} THEN 128 ELSE 0 END), 2, '0')), '') AS digits FROM n"""
_codes = "(VALUES (0, 200, 0), (1, 400, 3), (2, 503, 14), (3, 413, 8), (4, 404, 12), (5, 415, 12), (6, 415, 3), (7, 400, 3)) c(k, http, grpc)"
ORACLES["status_codes"] = f"SELECT event_id, http, grpc FROM events JOIN {_codes} ON event_id % 8 = k"
ORACLES["wall_clock"] = "SELECT abs(epoch_ms(current_timestamp::TIMESTAMP) - epoch_ms(now()::TIMESTAMP)) < 86400000 AS agrees"


def _fingerprint() -> str:
    """The policy's bytes, spelt out, through the hash."""
    text = lambda x: x.encode().hex()
    sampling = [("security-audit", "", 100), ("payments", "", 100), ("", "DEBUG", 10), ("batch-*", "", 25)]
    fields = [["body", "attributes.user.*"], ["body", "attributes.*note"], ["body"], ["body"]]
    digits = "3200" + "".join(f"{text(n)}00{text(v)}00{t:02x}00" for n, v, t in sampling) + "ff"
    digits += "".join(f"{text(n)}00{text(p)}00{text(m)}00" + "".join(f"{text(x)}00" for x in f) + "fe" for (n, p, m), f in zip(RULES, fields, strict=True))
    rest = avalanche("c3", "event_id").replace(f"CAST(xor(h, h >> 32{U}) % 100{U} AS BIGINT) AS bucket", f"CAST(xor(h, h >> 32{U}) AS VARCHAR) AS fingerprint")
    return f"WITH {chain(f'SELECT 1 AS event_id, {chr(39)}{digits}{chr(39)} AS kh')},{rest} SELECT fingerprint FROM hashed"


ORACLES["policy_fingerprint"] = _fingerprint()
