"""spark.read.format("otlp") and spark.readStream.format("otlp"): records straight from a folder of landed payload files.

The folder must be one that all workers see. For stores that only Spark's readers open, use read_payloads() and decode().
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

from logsluice.errors import ParseError
from logsluice.sources.otlp import parse

SCHEMA = "request_id string, record_idx int, body string, trace_id binary, severity_number int, namespace string, service_name string"


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


def rows_of(path: str) -> Iterator[tuple]:
    """The records of a payload file; of a malformed one, none."""
    raw = Path(path).read_bytes()
    try:
        found = parse(raw)
    except ParseError:
        return
    text = lambda r: None if r is None else raw[slice(*r)].decode("utf-8", "replace")
    for i, r in enumerate(found):
        yield Path(path).name, i, text(r.body), None if r.trace_id is None else raw[slice(*r.trace_id)], r.severity, text(r.namespace), text(r.service)


def listed(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).iterdir() if p.suffix == ".otlp")


class OtlpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "otlp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return StreamReader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.files = options["path"], int(options.get("filesPerTask", "256"))

    def partitions(self) -> list[InputPartition]:
        paths = listed(self.folder)
        return [Files(paths[k : k + self.files]) for k in range(0, len(paths), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from rows_of(path)


class StreamReader(DataSourceStreamReader):
    """New files of each batch, oldest first, parsed by the executors; at most maxFilesPerTrigger a batch.

    Files are known by (time of change, name), and each batch names its files: one that lands late under an earlier name is
    taken as well. Those of the last `remembered` seconds are remembered, so a file is not read twice.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.most, self.per_task = options["path"], int(options.get("maxFilesPerTrigger", "256")), int(options.get("filesPerTask", "16"))
        self.remembered = float(options.get("remembered", "3600"))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"batch": 0, "since": 0, "seen": [], "files": []}

    def latestOffset(self) -> dict:
        now = self.at or self.initialOffset()
        seen = set(now["seen"])
        times = {p: os.stat(p).st_mtime_ns for p in listed(self.folder)}
        new = sorted((t, p) for p, t in times.items() if t >= now["since"] and os.path.basename(p) not in seen)[: self.most]
        if new:
            since = max(now["since"], new[-1][0] - int(self.remembered * 1e9))
            kept = [os.path.basename(p) for p, t in times.items() if t >= since and os.path.basename(p) in seen]
            now = {"batch": now["batch"] + 1, "since": since, "seen": sorted([*kept, *(os.path.basename(p) for _, p in new)]), "files": [p for _, p in new]}
        self.at = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = self.at or end
        paths = end["files"] if end["batch"] != start["batch"] else []
        return [Files(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from rows_of(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OtlpSource)
