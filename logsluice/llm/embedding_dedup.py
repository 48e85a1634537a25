"""Near-duplicates among embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within a squared distance of 2 - 2c. Vectors are rotated (by a fixed random rotation, so
that no coordinate is special) and split into blocks of a few dimensions; in one block at least, the squared distance of a
linked pair is within that block's share of the budget, in proportion to its dimensions. So a range join in each block
finds every link:

1. A block's first coordinate is cut into strips, at quantiles, none narrower than the block's radius (the root of its share).
   Partners are in one strip or in two that touch, so each vector goes to its own strip, and as a guest to the next one if
   that begins within the radius: two rows a block at most, whatever the input.
2. Within a strip vectors are sorted by that coordinate, meet those within the radius, and are candidates if their distance
   in the whole block is within its share. A pair that an earlier block has as well is that block's. The rest, the union of all
   blocks' candidates once each, is verified by the cosine in double precision.

Each task returns, per vector, how many it links with and one link of a spanning forest, never the pairs. Equal vectors are one
before the join. A strip of more than PART vectors is dealt into parts, each two of which are a task: what structure the
vectors have narrows the strips; for vectors without any a strip keeps its share of all rows, and beyond PART a strip the work and
what is moved grow with the square of that (no exact join does better there).

Cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors of different
lengths don't link; very large and very small numbers are scaled first, so only directions count; equal vectors under
different ids, or repeated rows, link and count as often as they occur; a null vec_id counts as a link but names no component;
other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import columns, frugal, partitions_for, written
from logsluice.llm.components import components, spanning

#: Vectors of a strip in one task; a task holds two such parts.
PART = 32_768
#: Strips of a block, at most.
STRIPS = 64
#: Rows that meet at a time within a task.
TILE = 1024
#: Room for the rounding of single precision, in squared distance.
SLACK = 1e-4


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, block_dims: int) -> list[tuple[int, int]]:
    n = max(1, dims // block_dims)
    cut = [round(i * dims / n) for i in range(n + 1)]
    return list(zip(cut, cut[1:], strict=False))


def shares(dims: int, cosine: float, block_dims: int) -> list[tuple[int, int, float]]:
    """(first dimension, end, squared distance) of each block."""
    return [(lo, hi, (2 - 2 * cosine) * (hi - lo) / dims + SLACK) for lo, hi in block_edges(dims, block_dims)]


def turned(v: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors, rotated. The largest number of each is made one first, so that squares neither vanish nor overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(v.shape[1], seed)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, one dimension after another: the same number wherever two rows meet."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        d = x[:, k] - y[:, k]
        out += d * d
    return out


def linked(x: np.ndarray, y: np.ndarray | None, block: int, cosine: float, block_dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y) of rotated unit vectors that this block is the first to have and whose cosine is enough; y None: pairs i < j of x."""
    edges = shares(x.shape[1], cosine, block_dims)
    lo, hi, share = edges[block]
    reach = math.sqrt(share)
    parts = []
    for t in (x, x if y is None else y):
        order = np.argsort(t[:, lo], kind="stable")
        part = np.ascontiguousarray(t[order, lo:hi], dtype=np.float32)
        parts.append((order, part, t[order, lo], np.einsum("ij,ij->i", part, part)))
    (order_x, part_x, first_x, square_x), (order_y, part_y, first_y, square_y) = parts
    whole_y = x if y is None else y
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(order_x), TILE):
        b = min(a + TILE, len(order_x))
        left = a if y is None else int(np.searchsorted(first_y, first_x[a] - reach))
        right = int(np.searchsorted(first_y, first_x[b - 1] + reach, side="right"))
        for c in range(left, right, TILE):
            d = min(c + TILE, right)
            # Squared distance <= share and some room, as a product and one comparison; then exactly, and not in a block before.
            near = part_x[a:b] @ part_y[c:d].T
            near -= 0.5 * square_x[a:b, None]
            i, j = np.nonzero(near >= 0.5 * (square_y[c:d] - share - SLACK))
            if y is None:
                i, j = i[a + i < c + j], j[a + i < c + j]
            if not len(i):
                continue
            i, j = order_x[a + i], order_y[c + j]
            for e, (p, q, most) in enumerate(edges[: block + 1]):
                d2 = apart(x[i, p:q], whole_y[j, p:q])
                ok = d2 <= most if e == block else d2 > most
                i, j = i[ok], j[ok]
            exact = np.zeros(len(i))
            for k in range(x.shape[1]):
                exact += x[i, k] * whole_y[j, k]
            found.append((i[exact >= cosine], j[exact >= cosine]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.9, block_dims: int = 16, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = columns(vectors, vec_id=(id_col, "long"), v=(vector_col, "array<double>"))
    # In one column for grouping: null unless every number is finite and one is not zero.
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = written(rows.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))).alias("v")))
    # A key of two hashes stands for the vector in later joins.
    keys = F.xxhash64("v").alias("h"), F.xxhash64(F.lit(seed), F.reverse("v")).alias("g")
    sound_rows = rows.where("v IS NOT NULL").select("vec_id", *keys, "v")
    # Aggregated in each task first, so a hot vector is a row for each task.
    groups = sound_rows.groupBy("h", "g").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("v").alias("v"))
    groups = written(groups.mapInPandas(_turn(seed), "h long, g long, copies long, first_id long, dims int, v binary"))
    counted = _joined(groups, cosine, block_dims)
    if counted is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counted = written(counted)
    # A group is named by a whole number of its own; components are found among these, then named by their smallest id.
    links = counted.where("root <> h").select(F.col("h").alias("a"), F.col("root").alias("b"))
    component = components(links)
    named = groups.join(component, groups["h"] == component["node"], "left").select("h", "g", "first_id", "copies", F.coalesce("component", "h").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    sums = counted.groupBy(F.col("h").alias("h2")).agg(F.sum("links").alias("links"))
    per_group = named.join(smallest, "component").join(sums, F.col("h") == F.col("h2"), "left")
    per_group = per_group.select(F.col("h").alias("h1"), F.col("g").alias("g1"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), keys[0]).alias("h"), F.when(F.col("v").isNotNull(), keys[1]).alias("g")).join(per_group, (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links") > 0, F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _turn(seed: int) -> object:
    @frugal
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["v"].map(len).to_numpy()
            for dims in np.unique(size).tolist():
                some = pdf[size == dims]
                new = turned(np.stack(some["v"].to_numpy()).astype(np.float64), seed)
                yield some.assign(dims=dims, v=[row.tobytes() for row in new])[["h", "g", "copies", "first_id", "dims", "v"]]

    return run


def _first_coordinates(cosine: float, block_dims: int) -> object:
    @frugal
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, some in pdf.groupby("dims"):
                v = np.frombuffer(b"".join(some["v"]), np.float64).reshape(-1, dims)
                for block, (lo, _, _) in enumerate(shares(int(dims), cosine, block_dims)):
                    yield pd.DataFrame({"dims": dims, "block": block, "x": v[:, lo]})

    return run


def _joined(groups: DataFrame, cosine: float, block_dims: int) -> DataFrame | None:
    """h, links (vectors of other groups it links with, in one task), root (the least group of its component in that task)."""
    # Strips: quantiles of each block's first coordinate, at most STRIPS numbers a block and length of vectors.
    first = groups.select("dims", "v").mapInPandas(_first_coordinates(cosine, block_dims), "dims int, block int, x double")
    cuts: dict[tuple[int, int], np.ndarray] = {}
    rows_of: dict[int, int] = {}
    for r in first.groupBy("dims", "block").agg(F.percentile_approx("x", [k / STRIPS for k in range(1, STRIPS)], 1000).alias("q"), F.count("*").alias("n")).collect():
        reach, at = math.sqrt(shares(r["dims"], cosine, block_dims)[r["block"]][2]), []
        for q in r["q"]:
            if not at or q - at[-1] >= reach:
                at.append(q)
        cuts[r["dims"], r["block"]], rows_of[r["dims"]] = np.array(at), r["n"]
    if not cuts:
        return None

    @frugal
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector in its strip of each block, and as a guest in the next one if that is near."""
        for pdf in batches:
            for dims, some in pdf.groupby("dims"):
                v = np.frombuffer(b"".join(some["v"]), np.float64).reshape(-1, dims)
                for block, (lo, _, share) in enumerate(shares(int(dims), cosine, block_dims)):
                    at = cuts[int(dims), block]
                    strip = np.searchsorted(at, v[:, lo], side="right")
                    next_ = np.append(at, np.inf)[strip]
                    guest = next_ - v[:, lo] <= math.sqrt(share)
                    own = some.assign(block=block, strip=strip, guest=False)
                    also = some[guest].assign(block=block, strip=strip[guest] + 1, guest=True)
                    yield pd.concat([own, also])[["h", "g", "copies", "dims", "v", "block", "strip", "guest"]]

    dealt = groups.select("h", "g", "copies", "dims", "v").mapInPandas(deal, "h long, g long, copies long, dims int, v binary, block int, strip int, guest boolean")
    # How many parts a strip has follows from its number of rows; only strips of more than one part send a row more than once.
    most = max(rows_of.values())
    if most > PART:
        strips = written(dealt.groupBy("dims", "block", "strip").agg(F.count("*").alias("n")))
        parts = F.ceil(F.col("n") / PART).cast("int")
        dealt = dealt.join(F.broadcast(strips.select("dims", "block", "strip", parts.alias("parts"))), ["dims", "block", "strip"])  # at most STRIPS + 1 rows a block
        part = F.pmod("g", "parts").cast("int")
        dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")}).drop("parts", "other")
    else:
        dealt = dealt.withColumns({"part": F.lit(0), "one": F.lit(0), "two": F.lit(0)})

    @frugal
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "guest", "h"])
        dims, block, one, two = (int(pdf[c].iloc[0]) for c in ("dims", "block", "one", "two"))
        ids, copies = pdf["h"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        v = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(-1, dims)
        part, guest = pdf["part"].to_numpy(), pdf["guest"].to_numpy()
        # Hosts with each other, and guests with hosts; of two parts, those of one with those of the other.
        meet = [(~guest, None), (guest, ~guest)] if one == two else [(~guest & (part == one), ~guest & (part == two)), (guest & (part == one), ~guest & (part == two)), (guest & (part == two), ~guest & (part == one))]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in meet:
            at_x, at_y = np.flatnonzero(x), np.flatnonzero(x if y is None else y)
            if len(at_x) and len(at_y):
                i, j = linked(v[at_x], None if y is None else v[at_y], block, cosine, block_dims)
                left.append(at_x[i]), right.append(at_y[j])
        i, j = np.concatenate(left), np.concatenate(right)
        a, b = ids[i], ids[j]
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate([copies[j], copies[i]]), minlength=len(nodes)).astype(np.int64)
        child, root = spanning(a, b)
        of = nodes.copy()
        of[np.searchsorted(nodes, child)] = root
        return pd.DataFrame({"h": nodes, "links": links, "root": of})

    keys = ["dims", "block", "strip", "one", "two"]
    return dealt.repartition(partitions_for(groups), *keys).groupBy(*keys).applyInPandas(compare, "h long, links long, root long")
