"""A spool of payloads on disk: numbered files, oldest first out, never evicted."""

from __future__ import annotations

import contextlib
import os
import re
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.errors import SpoolError

NAME = r"([0-9]{20})\.otlp"


def file_seq(name: Column) -> Column:
    """The number in a spool file's name; null for any other name."""
    digits = F.regexp_extract(name, rf"\A{NAME}\z", 1)
    return F.when(name.rlike(rf"\A{NAME}\z"), digits.cast("decimal(20,0)"))


def file_name(seq: Column) -> Column:
    return F.format_string("%020d.otlp", seq)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Spooled payloads: seq, size, raw. Files of other names are not there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.otlp").load(path)
    rows = files.select(file_seq(F.element_at(F.split("path", "/"), -1)).alias("seq"), F.col("length").alias("size"), F.col("content").alias("raw"))
    return rows.where("seq IS NOT NULL")


def head(files: DataFrame) -> DataFrame:
    """The oldest file."""
    return files.orderBy("seq").limit(1)


def usage(files: DataFrame) -> DataFrame:
    """files, bytes, next_seq."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max("seq") + 1, F.lit(0)).cast("decimal(20,0)").alias("next_seq"))


def jitter() -> float:
    """0 to 0.249 seconds by the clock, so that many agents don't come back at once."""
    return time.time_ns() // 1000 % 250 / 1000


class Spool:
    """The driver's side: push, drain, recovery. Files appear whole or not at all."""

    def __init__(self, folder: str, max_bytes: int) -> None:
        self.folder, self.max_bytes, self.lock = Path(folder), max_bytes, threading.Lock()
        self.folder.mkdir(parents=True, exist_ok=True)
        self.sizes: dict[int, int] = {}
        for p in self.folder.iterdir():
            if p.suffix == ".tmp":
                p.unlink()
            elif m := re.fullmatch(NAME, p.name):
                self.sizes[int(m[1])] = p.stat().st_size
        self.next_seq, self.used = max(self.sizes, default=-1) + 1, sum(self.sizes.values())

    def stats(self) -> tuple[int, int]:
        with self.lock:
            return len(self.sizes), self.used

    def push(self, payload: bytes) -> int:
        """Its number. Raises SpoolError where it would not fit; nothing is removed to make room."""
        with self.lock:
            if self.used + len(payload) > self.max_bytes:
                raise SpoolError("full")
            seq, self.next_seq = self.next_seq, self.next_seq + 1
            self.sizes[seq] = len(payload)  # reserved
            self.used += len(payload)
        path = self.folder / f"{seq:020d}.otlp"
        try:
            with open(path.with_suffix(".tmp"), "wb") as f:
                f.write(payload)
                f.flush()
                os.fsync(f.fileno())
            os.rename(path.with_suffix(".tmp"), path)
        except OSError as e:
            self._forget(seq)
            raise SpoolError(str(e)) from e
        return seq

    def _forget(self, seq: int) -> None:
        with self.lock:
            self.used -= self.sizes.pop(seq, 0)

    def drain_one(self, send: Callable[[bytes], None]) -> str:
        """Sends the oldest file and removes it once that worked: empty, sent, or retry (it stays, and stays first)."""
        with self.lock:
            seq = min(self.sizes, default=None)
        if seq is None:
            return "empty"
        path = self.folder / f"{seq:020d}.otlp"
        try:
            send(path.read_bytes())
        except Exception:
            return "retry"
        # Delivered is delivered: a file that can't be removed is not sent again by this process.
        with contextlib.suppress(OSError):
            path.unlink()
        self._forget(seq)
        return "sent"

    def drain(self, send: Callable[[bytes], None], wait: Callable[[float], bool], idle: float = 1.0, first: float = 1.0, most: float = 30.0) -> None:
        """Until wait(seconds) says stop: pauses double from `first` to `most` while sending fails, each with up to a quarter second more."""
        pause = first
        while True:
            got = self.drain_one(send)
            if got == "sent":
                pause = first
                continue
            if wait(idle if got == "empty" else pause + jitter()):
                return
            pause = first if got == "empty" else min(most, pause * 2)
