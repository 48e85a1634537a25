"""The whole step: sample and redact records, and account for it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.operators import accounting, redaction, sampling
from logsluice.plans.policy import CompiledPolicy


class Stage(Protocol):
    """A step over logs: a name, for counters, and a map from DataFrame to DataFrame that changes no number of rows."""

    name: str

    def apply(self, logs: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class SampleStage:
    """Adds target and keep."""

    policy: CompiledPolicy
    name: str = "sample"

    def apply(self, logs: DataFrame) -> DataFrame:
        return sampling.sample(logs, self.policy)


@dataclass(frozen=True)
class RedactStage:
    """Redacts the records that stay, counts matches in all of them, and keeps the body that came as body_in."""

    policy: CompiledPolicy
    name: str = "redact"

    def apply(self, logs: DataFrame) -> DataFrame:
        return redaction.redact(logs.withColumn("body_in", F.col("body")), self.policy, wanted=F.col("keep") if "keep" in logs.columns else None)


def unredacted(sampled: DataFrame) -> DataFrame:
    """What stands in for the redact stage where that is bypassed: texts as they came, nothing counted."""
    return sampled.withColumns({"body_in": F.col("body"), "n_redactions": F.lit(0).cast("long")})


@dataclass
class Governed:
    rows: DataFrame  # kept records, redacted
    stats: DataFrame  # per request, over all records


def rows_of(governed: DataFrame) -> DataFrame:
    """The records that leave."""
    return governed.where("keep").drop("keep", "target", "n_redactions", "body_in")


def govern(logs: DataFrame, policy: CompiledPolicy) -> Governed:
    """Two branches of one plan: rows drop before they redact, stats count matches in dropped records as well.

    A caller that wants both of one input persists governed_records() and takes rows and stats from that, so that they share a scan.
    """
    sampled = sampling.sample(logs, policy)
    rows = redaction.redact(sampled.where("keep"), policy).drop("keep", "target", "n_redactions")
    return Governed(rows, accounting.request_stats(governed_records(logs, policy)))


def governed_records(logs: DataFrame, policy: CompiledPolicy) -> DataFrame:
    """All records with keep, body_in and n_redactions, kept ones redacted."""
    return RedactStage(policy).apply(SampleStage(policy).apply(logs))


def govern_rows(logs: DataFrame, policy: CompiledPolicy) -> DataFrame:
    """Only the kept and redacted records: a map without a shuffle."""
    return govern(logs, policy).rows
