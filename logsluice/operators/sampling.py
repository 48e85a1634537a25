"""Deterministic sampling: an ordered policy gives each record a target, a hash of its trace decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.functions.hashing import bucket_of, fallback_key, normal_trace_id, trace_bucket
from logsluice.functions.patterns import matches_glob
from logsluice.plans.policy import CompiledPolicy

RULES = "idx int, ns_like string, sev_max int, target int"


def rule_condition(namespace: Column, severity: Column, glob: str | None, band: int | None) -> Column:
    """All that the rule asks for; asking for what a record lacks is never met."""
    found = F.lit(True)
    if glob is not None:
        found &= matches_glob(namespace, glob)
    if band is not None:
        found &= severity <= band
    return found


def target(policy: CompiledPolicy, namespace: Column, severity: Column) -> Column:
    """Percent to keep, of the first rule that matches, else the default."""
    out = None
    for glob, band, percent in policy.sampling:
        condition = rule_condition(namespace, severity, glob, band)
        out = F.when(condition, F.lit(percent)) if out is None else out.when(condition, F.lit(percent))
    default = F.lit(policy.default_target)
    return (default if out is None else out.otherwise(default)).cast("int")


def bucket(trace_id: Column, service: Column, body: Column) -> Column:
    """0 to 99, by the trace id where there is a sound one, else by service and body."""
    trace = normal_trace_id(trace_id)
    return F.when(trace.isNotNull(), trace_bucket(trace)).otherwise(bucket_of(fallback_key(service, body)))


def kept(policy: CompiledPolicy, namespace: Column, severity: Column, trace_id: Column, service: Column, body: Column) -> Column:
    """Whether a record stays."""
    if not policy.sampling and policy.default_target in (0, 100):
        return F.lit(policy.default_target == 100)  # nothing to hash for
    return bucket(trace_id, service, body) < target(policy, namespace, severity)


def keep(policy: CompiledPolicy, df: DataFrame) -> Column:
    return kept(policy, df["namespace"], df["severity_number"], df["trace_id"], df["service_name"], df["body"])


def sample(df: DataFrame, policy: CompiledPolicy) -> DataFrame:
    """Logs with target and keep. A projection: dropping is a filter on keep that Spark pushes where it is cheapest."""
    return df.withColumns({"target": target(policy, F.col("namespace"), F.col("severity_number")), "keep": keep(policy, df)})


def rule_table(spark: SparkSession, policy: CompiledPolicy) -> DataFrame:
    """The policy's rules as rows (RULES)."""
    from logsluice.functions.patterns import like_pattern

    return spark.createDataFrame([(i, None if g is None else like_pattern(g), s, t) for i, (g, s, t) in enumerate(policy.sampling)], RULES)


def target_by_table(df: DataFrame, rules: DataFrame, default: int, key: str, most: int = 10_000) -> DataFrame:
    """df with target, by rules that are rows: for policies that change as data. key: a column that tells rows apart.

    Up to `most` rules are one array in the plan, searched within the row, without an exchange; more are joined.
    """
    few = rules.select("idx", "ns_like", "sev_max", "target").orderBy("idx").limit(most + 1).collect()
    namespace, severity = F.col("namespace"), F.col("severity_number")
    if len(few) <= most:
        row = lambda r: F.struct(F.lit(r["ns_like"]).cast("string").alias("ns_like"), F.lit(r["sev_max"]).cast("int").alias("sev_max"), F.lit(r["target"]).alias("target"))
        table = F.array(*map(row, few)) if few else F.array().cast("array<struct<ns_like:string,sev_max:int,target:int>>")
        met = lambda r: F.coalesce((r["ns_like"].isNull() | F.like(namespace, r["ns_like"])) & (r["sev_max"].isNull() | (severity <= r["sev_max"])), F.lit(False))
        return df.withColumn("target", F.coalesce(F.get(F.filter(table, met), F.lit(0))["target"], F.lit(default)))
    met = F.coalesce(F.col("ns_like").isNull() | F.expr("namespace LIKE ns_like"), F.lit(False)) & F.coalesce(F.col("sev_max").isNull() | (severity <= F.col("sev_max")), F.lit(False))
    found = df.select(key, "namespace", "severity_number").join(rules.withColumnRenamed("target", "rule_target"), met, "left").groupBy(key).agg(F.min_by("rule_target", "idx").alias("found"))
    return df.join(found, key).withColumn("target", F.coalesce("found", F.lit(default))).drop("found")


def keep_rate(df: DataFrame, *by: str) -> DataFrame:
    """Records and kept records per group, and the rate in hundredths of a percent (whole numbers, so that engines agree)."""
    kept = F.sum(F.col("keep").cast("long"))
    return df.groupBy(*by).agg(F.count("*").alias("records"), kept.alias("kept"), F.expr("CAST(sum(CAST(keep AS BIGINT)) * 10000 div count(*) AS BIGINT)").alias("rate_bp"))
