"""Mixing of sources to target weights by cube-method balanced sampling.

Every source gets a target number of words by water-filling: shares of the total by weight, none above max_repeat times
what the source has. A document's expected number of copies is its source's target over its size; the whole part is taken
outright, the fraction is an inclusion probability. The flight phase of the cube method moves these probabilities through
the null-space of the balancing constraints (number of documents, number of words, per source) until each is 0 or 1, but
for two documents at most in each bucket. What is left over from all buckets flies again, in fewer buckets, until one
bucket per source is left. There a dozen documents are the landing problem: all ways to decide them are compared.

Buckets are made by a hash of the document and of its number among equal ones, so a hot source, or a document that occurs
a million times, is spread over as many as its size asks for. All randomness is a hash of these and the seed: reruns agree, whatever
the partitions.

Cases: null text has size 0; null source is a source, the last; an empty source (no words) has target 0; null ids and repeated
rows are documents of their own; equal documents are told apart by nothing and are interchangeable; a very long text is one
document, and its source comes as near to its target as that allows; other columns, whatever their names, are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import WORD, columns, mix64, written

#: Documents in a bucket of the flight phase, on average.
BUCKET = 4096
#: Documents of a source that are kept for the landing, besides what the flight leaves.
HELD = 10
#: Sources up to which their rows (targets, buckets) are broadcast; with more the joins are Spark's to choose.
SMALL = 10_000
NEAR = 1e-9


def targets(sizes: list[float], weights: list[float], share: float, max_repeat: float) -> list[float]:
    """share of all sizes dealt by weight; what is above max_repeat times a size is dealt again among the others."""
    out, left, total = [0.0] * len(sizes), share * sum(sizes), sum(weights)
    # The smaller a source beside its weight, the sooner it is full; once one is not, none of the rest is.
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    for k, i in enumerate(order):
        if left * weights[i] <= max_repeat * sizes[i] * total:
            for j in order[k:]:
                out[j] = left * weights[j] / total
            break
        out[i] = max_repeat * sizes[i]
        left, total = left - out[i], total - weights[i]
    return out


def flight(p: list[float], size: list[float], coin: Iterator[float], landing: bool) -> list[float]:
    """Moves probabilities to 0 or 1 with the sums of p and of p * size kept, but for two units at most.

    landing: HELD units, spread over the sizes, don't fly; of all ways to decide these and what is left, the nearest to both sums is taken.
    """
    p = list(p)
    live: list[int] = []
    open_units = [k for k in range(len(p)) if NEAR < p[k] < 1 - NEAR]
    p = [x if NEAR < x < 1 - NEAR else float(x > 0.5) for x in p]
    goal = sum(p), sum(x * s for x, s in zip(p, size, strict=True))
    held = {open_units[i * (len(open_units) - 1) // max(1, HELD - 1)] for i in range(min(HELD, len(open_units)))} if landing else set()

    def move(units: list[int], u: tuple[float, ...]) -> None:
        up = min(((1 - p[k]) / x if x > 0 else p[k] / -x) for k, x in zip(units, u, strict=True) if x)
        down = min((p[k] / x if x > 0 else (1 - p[k]) / -x) for k, x in zip(units, u, strict=True) if x)
        step = up if next(coin) * (up + down) < down else -down
        for k, x in zip(units, u, strict=True):
            p[k] += step * x
            p[k] = 0.0 if p[k] < NEAR else 1.0 if p[k] > 1 - NEAR else p[k]

    for k in open_units:
        if k in held:
            continue
        live.append(k)
        while len(live) == 3:
            a, b, c = (size[k] for k in live)
            # The vector across (1, 1, 1) and (a, b, c) keeps both totals; equal sizes allow any exchange.
            scale = max(abs(c - b), abs(a - c), abs(b - a))
            move(live, ((c - b) / scale, (a - c) / scale, (b - a) / scale) if scale else (1.0, -1.0, 0.0))
            live = [k for k in live if 0 < p[k] < 1]
    if landing and (live := live + sorted(held)):
        sizes = np.array([size[k] for k in live], dtype=np.float64)
        ways = np.arange(1 << len(live))[:, None] >> np.arange(len(live)) & 1
        rest = set(live)
        sure = [k for k in range(len(p)) if k not in rest]
        gap_docs = goal[0] - sum(p[k] for k in sure) - ways.sum(axis=1)
        gap_words = goal[1] - sum(p[k] * size[k] for k in sure) - ways @ sizes
        cost = np.abs(gap_words) / max(1.0, sizes.mean()) + 0.1 * np.abs(gap_docs)
        best = np.flatnonzero(cost <= cost.min() + NEAR)
        for k, x in zip(live, ways[best[int(next(coin) * len(best))]], strict=True):
            p[k] = float(x)
    return p


def _coin(seed: int) -> Iterator[float]:
    at = np.uint64(seed)
    while True:
        values = mix64(at + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = values[-1]
        yield from ((values >> np.uint64(11)).astype(np.float64) / (1 << 53)).tolist()


def _fly(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """One round over rows (key, doc_id, row, source, size, copies, p); buckets: per source, how many. A source's only bucket lands."""
    dealt = rows.join(buckets, rows["source"].eqNullSafe(buckets["of"])).drop("of")
    dealt = dealt.withColumn("bucket", F.pmod("key", "n").cast("long"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "key", "doc_id", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        g["p"] = flight(g["p"].tolist(), g["size"].tolist(), _coin(int(g["key"].iloc[0]) & (1 << 64) - 1), g["n"].iloc[0] == 1)
        return g[["key", "doc_id", "row", "source", "size", "copies", "p"]]

    return dealt.groupBy("source", "bucket").applyInPandas(run, "key long, doc_id long, row long, source string, size long, copies long, p double")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with the number of each among those of its key (from 0, in any order) taken into the key.

    Rows are numbered within their partition and key; a key's partitions hand each other their counts, so no key is one task's.
    """
    own = rows.withColumn("part", F.spark_partition_id())
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("part", "key").orderBy("row")) - 1)
    counts = own.groupBy("key", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("key").alias("k"), F.col("part").alias("p"), before.alias("before")).where("before > 0")
    out = own.join(counts, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")), "left")
    return written(out.select("doc_id", "row", "source", "size", F.xxhash64("key", (F.col("nth") + F.coalesce("before", F.lit(0))).cast("long")).alias("key")))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeat: float = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), copies, taken (copies * size).

    row_col: a long column that tells rows apart, returned as row; as they have it, rows that share an id are told apart.
    weights: of the sources in code point order, null last, repeating. Totals per source go to the driver: a row for each source.
    """
    spark = docs.sparkSession
    sized = columns(docs, doc_id=(id_col, "long"), source=(source_col, "string"), text=(text_col, "string"), **({"row": (row_col, "long")} if row_col else {}))
    sized = sized if row_col else sized.withColumn("row", F.lit(0).cast("long"))
    sized = written(sized.select("doc_id", "row", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "source", "text").alias("key")))
    sized = _numbered(sized)
    of = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    of.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    goal = targets([float(r["s"]) for r in of], [float(weights[i % len(weights)]) for i in range(len(of))], share, max_repeat)
    plan = spark.createDataFrame([(r["source"], r["s"], t, t / r["s"] if r["s"] else 0.0) for r, t in zip(of, goal, strict=True)], "of string, source_size long, target double, rate double")
    plan = F.broadcast(plan) if len(of) <= SMALL else plan
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["of"])).select(
        "key", "doc_id", "row", "source", "size",
        F.floor("rate").cast("long").alias("copies"), (F.col("rate") - F.floor("rate")).alias("p"),
    )
    kind = "of string, n long"
    counts = {r["source"]: r["n"] for r in of}
    decided = None
    while counts:
        buckets = spark.createDataFrame([(s, math.ceil(n / BUCKET)) for s, n in counts.items()], kind)
        buckets = F.broadcast(buckets) if len(counts) <= SMALL else buckets
        rows = written(_fly(rows, buckets))
        done = rows.where((F.col("p") <= 0) | (F.col("p") >= 1))
        decided = done if decided is None else decided.unionByName(done)
        rows = rows.where((F.col("p") > 0) & (F.col("p") < 1))
        counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if decided is None:
        decided = rows
    out = decided.withColumn("copies", F.col("copies") + F.col("p").cast("long"))
    return out.join(plan, out["source"].eqNullSafe(plan["of"])).select("doc_id", *(["row"] if row_col else []), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
