"""Where governed data and aggregates go."""

from __future__ import annotations

import json
import ssl
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.errors import ForwardError, SinkError


class AggregateSink(Protocol):
    def deliver(self, aggregate: dict) -> None: ...


class LineSink:
    """One line of numbers an aggregate."""

    def __init__(self, write: Callable[[str], object] | None = None) -> None:
        self.write = write or (lambda line: print(line, file=sys.stdout, flush=True))

    def deliver(self, aggregate: dict) -> None:
        self.write(" ".join(f"{k}={v}" for k, v in aggregate.items()))


class JsonSink(LineSink):
    def deliver(self, aggregate: dict) -> None:
        self.write(json.dumps(aggregate, default=int))


def deliver_all(aggregates: DataFrame, sink: AggregateSink, log: Callable[[str], object] = lambda m: print(m, file=sys.stderr)) -> int:
    """Delivers each aggregate, in order; a failure is logged and goes no further. How many arrived."""
    done = 0
    for row in aggregates.orderBy("window_start_ms").toLocalIterator():
        try:
            sink.deliver(row.asDict())
            done += 1
        except Exception as e:
            log(str(SinkError(f"aggregate {row['window_start_ms']} not delivered: {e}")))
    return done


def logs_url(endpoint: str) -> str:
    if not endpoint.startswith(("http://", "https://")):
        raise ForwardError(f"not an http address: {endpoint}")
    return endpoint.rstrip("/") + "/v1/logs"


def forward(endpoint: str, payload: bytes, timeout: float = 10, context: ssl.SSLContext | None = None) -> None:
    """POST of one payload; anything but 2xx is an error."""
    url = logs_url(endpoint)
    request = urllib.request.Request(url, data=payload, method="POST", headers={"Content-Type": "application/x-protobuf"})
    try:
        with urllib.request.urlopen(request, timeout=timeout, context=context or (ssl.create_default_context() if url.startswith("https") else None)) as r:
            if not 200 <= r.status < 300:
                raise ForwardError(f"status {r.status}")
    except (urllib.error.URLError, OSError) as e:
        raise ForwardError(str(e)) from e


def client_context(roots: str | None = None, certificate: str | None = None, key: str | None = None) -> ssl.SSLContext:
    """TLS for a client that checks the server's name and chain: the system's roots, or those of a PEM file; with a certificate of its own if given."""
    context = ssl.create_default_context(cafile=roots)
    context.minimum_version = ssl.TLSVersion.TLSv1_2
    if certificate:
        context.load_cert_chain(certificate, key)
    return context


def forward_with(timeout: float = 10, roots: str | None = None, certificate: str | None = None, key: str | None = None) -> Callable[[str, bytes], None]:
    """forward() with these settings, for executors: the context is made where it is used."""

    def send(endpoint: str, payload: bytes) -> None:
        forward(endpoint, payload, timeout, client_context(roots, certificate, key) if endpoint.startswith("https") else None)

    return send


def forward_all(payloads: DataFrame, endpoint: str, send: Callable[[str, bytes], None] = forward) -> DataFrame:
    """Sends the payloads from the executors, each partition in order: request_id, received_at, delivered, error, and the payload of failed ones, for the spool."""
    logs_url(endpoint)
    rows = payloads.select("request_id", *(["received_at"] if "received_at" in payloads.columns else [F.current_timestamp().alias("received_at")]), "payload")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            errors = []
            for payload in pdf["payload"]:
                try:
                    send(endpoint, bytes(payload))
                    errors.append(None)
                except ForwardError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"request_id": pdf["request_id"], "received_at": pdf["received_at"], "delivered": [e is None for e in errors], "error": errors, "payload": [None if e is None else p for e, p in zip(errors, pdf["payload"], strict=True)]})

    return rows.mapInPandas(run, "request_id string, received_at timestamp, delivered boolean, error string, payload binary")
