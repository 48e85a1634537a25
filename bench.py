"""Times the headline queries over one scale factor and prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8). Each query runs once to warm up and then BENCH_RUNS (1) times; the least time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

HEADLINE = [
    "sample_keep_traced", "policy_target", "namespace_keep_rate", "govern_logs", "request_stats", "window_10s_aggregate", "window_10s_gapfill", "redact_email_documents", "redact_multi_documents",
    "redaction_rule_counts", "prefilter_hits", "otlp_decode", "otlp_govern_payloads", "latency_nearest_rank",
]
#: A load like the one that the throughput target is stated for: one rule by namespace, five redaction rules on the body.
LOAD = r"""
sampling: {default_target: 100, rules: [{match: {namespace: library}, target: 25}]}
redaction:
  regex_rules:
    - {name: mailbox, pattern: '[a-z0-9._-]{1,64}@[a-z0-9.-]{3,255}', mask: "<mailbox>", fields: [body]}
    - {name: private_host, pattern: '\b(?:10|172|192)\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', mask: "<host>", fields: [body]}
    - {name: session, pattern: 'session=[a-z0-9]{4,40}', mask: "session=<gone>", fields: [body]}
    - {name: password, pattern: '(?:password|passwd)[ ]?[:=][ ]?[^ ]+', mask: "password=<gone>", fields: [body]}
    - {name: long_number, pattern: '[0-9]{4}(?:[ -]?[0-9]{4}){2,3}', mask: "<number>", fields: [body]}
"""
EVENTS, RECORDS = 2_000_000, 10


def payloads(load: DataFrame) -> DataFrame:
    """The load as protobuf requests of RECORDS records."""
    import pyarrow as pa

    from logsluice.queries import _encoded, encode_request

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = batch.to_pylist()
            groups = [rows[k : k + RECORDS] for k in range(0, len(rows), RECORDS)]
            raw = [encode_request([_encoded(r["body"], r["trace_id"], r["severity_number"], [(a["key"], a["value"]) for a in r["attrs"]], False) for r in g], g[0]["namespace"], g[0]["service_name"]) for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array([str(g[0]["request_id"]) for g in groups]), pa.array([g[0]["received_at"] for g in groups], pa.timestamp("us", "UTC")), pa.array(raw, pa.binary())], names=["request_id", "received_at", "raw"])

    return load.mapInArrow(run, "request_id string, received_at timestamp, raw binary")


def timed(make: Callable[[], DataFrame], runs: int) -> float:
    seconds = []
    for _ in range(runs + 1):
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - began)
    return min(seconds[1:])


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from logsluice.operators import accounting, governance
    from logsluice.plans.policy import compile_policy, from_yaml
    from logsluice.queries import QUERIES
    from logsluice.sources import otlp
    from logsluice.sources.logs import synthetic

    took = {name: round(timed(lambda n=name: QUERIES[n](spark, sf_dir), runs), 4) for name in HEADLINE}
    policy = compile_policy(from_yaml(LOAD), spark)
    path = f"{os.environ.get('TMPDIR', '/tmp')}/bench-load-{os.getpid()}"
    synthetic(spark, EVENTS // RECORDS, RECORDS, partitions=4 * int(cpus)).write.mode("overwrite").parquet(f"{path}/logs")
    load = spark.read.parquet(f"{path}/logs")
    payloads(load).write.mode("overwrite").parquet(f"{path}/requests")
    requests = spark.read.parquet(f"{path}/requests")
    rates = {}
    # rows: kept and redacted records; stats: all counters and windows; payloads: bytes in, decoded, sampled, redacted, written back, counted.
    for name, make in (
        ("rows", lambda: governance.govern_rows(load, policy)),
        ("stats", lambda: accounting.window_aggregate(accounting.samples(governance.govern(load, policy).stats))),
        ("payloads", lambda: otlp.govern_payloads(requests, policy)),
    ):
        seconds = timed(make, runs)
        took[f"load_{name}"] = round(seconds, 4)
        rates[f"events_per_s_core_{name}"] = round(EVENTS / seconds / int(cpus))
    import shutil

    shutil.rmtree(path, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
