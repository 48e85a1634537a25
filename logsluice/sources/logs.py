"""Log records from other tables, and synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The events table as log records: the same text runs in Spark and in DuckDB.
LOGS_SQL = """
SELECT event_id, CAST(floor(event_id / 10) AS BIGINT) AS request_id, ts AS received_at,
  'user ' || CAST(user_id AS STRING) || ' ' || event_type || ' from 10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING)
    || CASE WHEN event_id % 3 = 0 THEN ' mail u' || CAST(user_id AS STRING) || '@corp.io' ELSE '' END AS body,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE md5(CAST(user_id AS STRING) || '-' || CAST(event_id AS STRING)) END AS trace_hex,
  CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 9 WHEN 'signup' THEN 10 WHEN 'error' THEN 17 END AS severity_number,
  CASE user_id % 5 WHEN 0 THEN 'payments' WHEN 1 THEN 'batch-nightly' WHEN 2 THEN 'web' WHEN 3 THEN 'security-audit' END AS namespace,
  'svc-' || CAST(user_id % 7 AS STRING) AS service_name
FROM events"""


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer splits than there are: a table of one small file would be one task's work. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records made of the events table; trace_id as the 32 digits that senders of JSON use, attrs from the user."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return as_logs(spark, events)


def as_logs(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The same of any events, a stream's as well."""
    logs = spark.sql(LOGS_SQL.replace("FROM events", "FROM {events}"), events=events)
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    attrs = F.array(attr("user.email", F.concat(F.lit("u"), F.regexp_extract("body", "^user ([0-9]+)", 1), F.lit("@corp.io"))), attr("http.method", F.lit("POST")), attr("request.note", F.col("body")))
    return logs.withColumns({"received_at": F.col("received_at").cast("timestamp"), "trace_id": F.col("trace_hex").cast("binary"), "attrs": attrs})


def synthetic(spark: SparkSession, requests: int, records: int = 10, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """A seeded load of `records` records a request: three in ten tell of a person, with an address, a host and a session key."""
    n = spark.range(0, requests * records, numPartitions=partitions) if partitions else spark.range(0, requests * records)
    i = F.col("id") % records
    number = F.col("id").cast("string")
    personal = F.concat(F.lit("password reset mailed to guest"), number, F.lit("@mail.test, asked for by 192.168."), (F.col("id") % 250).cast("string"), F.lit(".17 in session=k"), number, F.lit("q"))
    routine = F.concat(F.lit("cache refresh of shelf "), (F.col("id") % 89).cast("string"), F.lit(" took "), (F.col("id") % 53).cast("string"), F.lit(" ms, 4 pages written, none evicted, store healthy"))
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    return n.select(
        (F.col("id") / records).cast("long").alias("request_id"), i.cast("int").alias("record_idx"), F.timestamp_millis(F.lit(1_750_000_000_000) + F.col("id")).alias("received_at"),
        F.when(i % 10 < 3, personal).otherwise(routine).alias("body"), F.unhex(F.md5(F.concat_ws("-", F.lit(str(seed)), "id"))).alias("trace_id"),
        F.lit(9).alias("severity_number"), F.lit("library").alias("namespace"), F.lit("lending-desk").alias("service_name"),
        F.array(attr("rpc.method", "Renew"), attr("user.contact", "reader@mail.test")).alias("attrs"),
    )


# --- The events table as protobuf requests, in hexadecimal digits: the same text runs in Spark and in DuckDB, but for how strings are put together.


def varint_hex(n: str) -> str:
    """Digits of a number below 2**21 in base 128."""
    byte = lambda x: f"lpad(hex(CAST({x} AS BIGINT)), 2, '0')"
    rest = lambda k: f"floor({n} / {1 << 7 * k})"
    two = f"{byte(f'{n} % 128 + 128')} || {byte(rest(1))}"
    three = f"{byte(f'{n} % 128 + 128')} || {byte(f'{rest(1)} % 128 + 128')} || {byte(rest(2))}"
    return f"(CASE WHEN {n} < 128 THEN {byte(n)} WHEN {n} < 16384 THEN {two} ELSE {three} END)"


def field_hex(number: int, digits: str) -> str:
    """A field with a length; null where the digits are."""
    return f"('{number << 3 | 2:02X}' || {varint_hex(f'floor(length({digits}) / 2)')} || {digits})"


def requests_hex(source: str, joined: str) -> str:
    """CTEs up to requests (request_id, digits), of source (event_id, request_id, namespace, service_name, severity_number, trace_hex, body, email, note, keep).

    joined: an aggregate of the records' digits, `rec`, in the order of event_id. Records with keep false are left out.
    """
    pair = lambda key, value: f"'0A{len(key):02X}{key.encode().hex().upper()}' || {value}"
    maybe = lambda x: f"coalesce({x}, '')"
    extra = "CASE WHEN event_id % 2 = 0 THEN '09' || '0000F8BF4B5EDF17' || '1A04494E464F' || '4501000000' ELSE '' END"  # fields that nobody reads
    return f"""
r0 AS (SELECT event_id, request_id, namespace, service_name, severity_number, trace_hex, keep, hex(body) AS bh, hex(email) AS eh, hex(note) AS nh FROM {source}),
r1 AS (SELECT *, {field_hex(1, "bh")} AS bt, {field_hex(1, "eh")} AS et, {field_hex(1, "nh")} AS nt, hex(trace_hex) AS th FROM r0),
r2 AS (SELECT *, {field_hex(2, "et")} AS ev, {field_hex(2, "nt")} AS nv FROM r1),
r3 AS (SELECT *, {pair("user.email", "ev")} AS ep, {pair("request.note", "nv")} AS np FROM r2),
r4 AS (SELECT event_id, request_id, namespace, service_name, keep, {extra} || CASE WHEN severity_number IS NULL THEN '' ELSE '10' || lpad(hex(CAST(severity_number AS BIGINT)), 2, '0') END
  || {field_hex(5, "bt")} || {field_hex(6, "ep")} || {field_hex(6, "np")} || {maybe(field_hex(9, "th"))} AS m FROM r3),
r5 AS (SELECT event_id, request_id, namespace, service_name, CASE WHEN keep THEN {field_hex(2, "m")} ELSE '' END AS rec FROM r4),
r6 AS (SELECT request_id, max(namespace) AS namespace, max(service_name) AS service_name, {joined} AS recs FROM r5 GROUP BY request_id),
r7 AS (SELECT request_id, {field_hex(2, "recs")} AS scope, hex(namespace) AS ns, hex(service_name) AS sv FROM r6),
r8 AS (SELECT request_id, scope, {field_hex(1, "ns")} AS nt, {field_hex(1, "sv")} AS st FROM r7),
r9 AS (SELECT request_id, scope, {field_hex(2, "nt")} AS nv, {field_hex(2, "st")} AS sv FROM r8),
r10 AS (SELECT request_id, scope, {pair("service.name", "sv")} AS sp, {pair("k8s.namespace.name", "nv")} AS np FROM r9),
r11 AS (SELECT request_id, scope, {maybe(field_hex(1, "sp"))} || {maybe(field_hex(1, "np"))} AS res FROM r10),
r12 AS (SELECT request_id, {field_hex(1, "res")} || scope AS g FROM r11),
requests AS (SELECT request_id, {field_hex(1, "g")} AS digits FROM r12)"""


#: Records of requests: those of one share the namespace and the service of the first.
REQUEST_LOGS_SQL = f"""
SELECT event_id, request_id, body, trace_hex, severity_number, first_value(namespace) OVER w AS namespace, first_value(service_name) OVER w AS service_name,
  'u' || regexp_extract(body, '^user ([0-9]+)', 1) || '@corp.io' AS email, body AS note FROM ({LOGS_SQL}) l WINDOW w AS (PARTITION BY request_id ORDER BY event_id)"""


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as requests of ten records, in protobuf; every 97th is cut short by three bytes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ctes = requests_hex("kept", "listagg(rec, '') WITHIN GROUP (ORDER BY event_id)")
    rows = spark.sql(f"WITH kept AS (SELECT *, true AS keep FROM ({REQUEST_LOGS_SQL.replace('FROM events', 'FROM {{events}}').replace('{{', '{').replace('}}', '}')}) x), {ctes} SELECT * FROM requests", events=events)
    raw = F.unhex("digits")
    cut = F.when(F.col("request_id") % 97 == 0, F.substring(raw, F.lit(1), F.octet_length(raw) - 3)).otherwise(raw)
    return rows.select(F.col("request_id").cast("string").alias("request_id"), F.timestamp_seconds(F.col("request_id")).alias("received_at"), cut.alias("raw"))
