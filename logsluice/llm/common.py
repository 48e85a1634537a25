"""Helpers shared by the corpus operators: columns, hashes, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls 9 to 13, which are also what bytes.split() cuts at.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: A setting of Spark: whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def columns(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """name=(column, type): the wanted columns under new names, so that no other column can clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(n) for n, (c, t) in wanted.items()])


def kept_columns(df: DataFrame, keep: tuple[str, ...]) -> dict[str, tuple[str, str]]:
    """For columns(): those that an operator carries along, under names that can't clash."""
    return {f"keep_{i}": (c, df.schema[c].dataType.simpleString()) for i, c in enumerate(keep)}


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(f: Callable) -> Callable:
    """A function for Python workers that leaves little memory behind: workers are kept, and idle ones count against their executor."""

    def to_the_end(out: Iterator) -> Iterator:
        try:
            yield from out
        finally:
            trim()

    def call(*args: object) -> object:
        pa.set_memory_pool(pa.system_memory_pool())
        out = f(*args)
        if inspect.isgenerator(out):
            return to_the_end(out)
        trim()
        return out

    # Spark looks at how many arguments there are.
    return (lambda a: call(a)) if len(inspect.signature(f).parameters) == 1 else lambda a, b: call(a, b)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder which driver and executors share. Where the session names none a temporary one is made, in local mode alone: on a cluster it would not be shared."""
    jsc = spark.sparkContext._jsc.sc()
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, kept if executors are lost.

    What it shuffled is deleted at once; without this that stays until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


def mark() -> int:
    """How many tables this process has written: for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Deletes tables that operators of this process have written since a mark, but for the last ones; call it once their results are stored. How many."""
    n, end = 0, len(_written) - but_last
    paths, _written[since:end] = _written[since:end], []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_written: list[str] = []
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a line end after each, and where each ends, that line end included; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ended = pc.binary_join_element_wise(filled, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    if not len(ended):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    _, places, data = ended.buffers()
    ends = np.frombuffer(places, dtype=np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def word_spans(data: np.ndarray, ends: np.ndarray, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of joined() texts begin and end, and how many each text has. gaps: by byte, whether it parts words."""
    edge = np.flatnonzero(np.diff(gaps[data], prepend=True))
    begin, end = edge[0::2], edge[1::2]
    return begin, end, np.diff(np.searchsorted(begin, ends), prepend=0)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each span: a polynomial over them modulo 2**64, taken from running sums and scrambled."""
    out = np.empty(len(begin), dtype=np.uint64)
    # In slices of whole words, so that the powers stay small; a word longer than a slice gets a slice of its own.
    step = 1 << 20
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(end, begin[first] + step, side="right")))
        lo, hi = int(begin[first]), int(end[last - 1])
        size = 1 << max(20, (hi - lo).bit_length())
        up, down = _powers_to(size)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        b, e = begin[first:last] - lo, end[first:last] - lo
        out[first:last] = mix64((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        first = last
    return out


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of joined() texts, one after another, and the number of words of each text."""
    if lower:
        data = _LOWER[data]
    begin, end, counts = word_spans(data, ends)
    return span_hashes(data, begin, end), counts


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """For each start of a run of width items, a 64-bit hash of the run; runs may cross texts, the caller drops those."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += words[j : j + n]
    return mix64(out)


def partitions_for(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sampled_rows(rows: DataFrame, by: str, most: int, groups: int, seed: int = 3) -> DataFrame:
    """A training sample: about `most` rows for each value of `by`, all where there are fewer, of the `groups` most frequent values. With `order_`, a hash to sort by.

    Rows are chosen one by one, by a hash of their place in the input, so rows that share an id, or all they have, are not chosen together.
    """
    placed = rows.withColumn("order_", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    n = rows.groupBy(F.col(by).alias("by_")).agg(F.count("*").alias("n_")).orderBy(F.desc("n_"), "by_").limit(groups)
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("n_"))
    chosen = F.pmod("order_", F.lit(1 << 30)) < share * (1 << 30)
    return placed.join(F.broadcast(n), F.col(by) == F.col("by_")).where(chosen).drop("by_", "n_")


def window_of(text: Column, order: Column, most: int) -> Column:
    """The text, or of a longer one `most` characters from a place that the hash tells."""
    beyond = F.greatest(F.length(text) - most, F.lit(0))
    return F.substring(text, F.pmod(F.shiftright(order, 32), F.greatest(beyond + 1, F.lit(1)).cast("long")).cast("int") + 1, F.lit(most))


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, longest: int, id_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Texts with a label 0 or 1, about `rows` of each, and their labels; of a text longer than that, a window of `longest` characters.

    The labels are sampled first, so that it is these few ids that are broadcast, and texts are read but not shuffled. Of texts that share
    an id about as many are taken as it has labels.
    """
    chosen = columns(labels, of_=(id_col, "long"), y_=(label_col, "int")).where("y_ IN (0, 1) AND of_ IS NOT NULL")
    chosen = sampled_rows(chosen, "y_", rows, 2).groupBy("of_", "y_").agg(F.count("*").alias("n_"))
    texts = columns(docs, id_=(id_col, "long"), text_=(text_col, "string")).withColumn("row_", F.xxhash64(F.lit(5), "id_", F.monotonically_increasing_id()))
    got = texts.join(F.broadcast(chosen), F.col("id_") == F.col("of_")).withColumn("text_", window_of(F.col("text_"), F.col("row_"), longest))
    got = got.select("text_", "y_", "row_").orderBy("row_", "text_", "y_").limit(rows * 4).collect()
    return [r["text_"] for r in got], np.array([r["y_"] for r in got], dtype=np.int64)


def buckets_for(df: DataFrame, text_col: str, most: int, times: int = 1) -> int:
    """Buckets of about `most` bytes of text, and at least so many for each shuffle partition: what a task holds at a time doesn't grow with the input."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(times * partitions_for(df), -(-size // most))


def in_slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def sent_by_bucket(bucket: np.ndarray, *fields: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of equally long fields as one (bucket, bytes) for each bucket, field after field, in the order they come."""
    order = np.argsort(bucket, kind="stable")
    sorted_, fields = bucket[order], tuple(np.ascontiguousarray(f[order]) for f in fields)
    cuts = [*np.flatnonzero(np.diff(sorted_, prepend=-1)).tolist(), len(order)]
    return [(int(sorted_[a]), b"".join(f[a:b].tobytes() for f in fields)) for a, b in zip(cuts, cuts[1:], strict=False)]


def received(payloads: list[bytes], *kinds: str) -> tuple[np.ndarray, ...]:
    """The fields of all payloads, one after another."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=k)] for k in kinds]
    for p in payloads:
        n, at = len(p) // sum(sizes), 0
        for i, (k, size) in enumerate(zip(kinds, sizes, strict=True)):
            parts[i].append(np.frombuffer(p, dtype=k, count=n, offset=at))
            at += n * size
    return tuple(np.concatenate(x) for x in parts)


def run_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words[begin:end], for begins in ascending order, from running sums: a cost that doesn't grow with the runs."""
    out = np.empty(len(begin), dtype=np.uint64)
    step, first = 1 << 20, 0
    while first < len(begin):
        lo = int(begin[first])
        last = int(np.searchsorted(begin, lo + step))
        hi = int(end[first:last].max())
        up, down = _powers_to(1 << max(21, (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(words[lo:hi] * up[: hi - lo], out=sums[1:])
        b, e = begin[first:last] - lo, end[first:last] - lo
        out[first:last] = mix64((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        first = last
    return out


def bucket_of_id(ids: np.ndarray, n: int) -> np.ndarray:
    """The same as pmod(xxhash64(id), n) in SQL, for bigint ids."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # constants of xxHash64

    def turned(x: np.ndarray, k: int) -> np.ndarray:
        return x << np.uint64(k) | x >> np.uint64(64 - k)

    x = np.ascontiguousarray(ids, dtype=np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (np.uint64(42 + 8) + p5) ^ turned(x * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
    return np.mod((h ^ h >> np.uint64(32)).view(np.int64), np.int64(n))


def packed_rows(df: DataFrame, most: int = 1 << 23) -> DataFrame:
    """The rows of df (bucket int, ...) as (bucket, payload): a task's rows of a bucket together, compressed, for less to shuffle.

    Compression works over many rows here, where Spark's own sees a few; texts take about two thirds of the space.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for batch in _by_size(whole, most):
                held.append(batch)
                size += batch.nbytes
                if size >= most:
                    yield _packed(held)
                    held, size = [], 0
        if held:
            yield _packed(held)

    return df.mapInArrow(run, "bucket int, payload binary")


def packed_table(rows: pa.Table, most: int = 1 << 23) -> pa.Table:
    """The same for a table at hand."""
    parts = [_packed([b]) for whole in rows.to_batches() for b in _by_size(whole, most) if len(b)]
    return pa.Table.from_batches(parts, pa.schema([("bucket", pa.int32()), ("payload", pa.binary())]))


def maybe_among(df: DataFrame, ids: DataFrame, most: int = 27, by: str = "doc_id") -> DataFrame:
    """df (doc_id, ...) with a boolean may_: false where doc_id is certainly none of the ids, so that such rows needn't be shuffled to a join with them.

    A bitmap of hashes, 16 cells for an id up to 2**most in all (16 MB), in pieces of 4 KB that are broadcast. A null id is none of them. by: another column, of whole numbers, that both have.
    """
    cells = 1 << min(most, max(15, (16 * ids.count()).bit_length()))
    cell = F.pmod(F.xxhash64(F.col(by).cast("long")), F.lit(cells)) + 1
    placed = ids.where(F.col(by).isNotNull()).select(F.bitmap_bucket_number(cell).alias("piece_"), F.bitmap_bit_position(cell).alias("bit_"))
    # Dealt before they are aggregated, as a piece from each task would be far more than the ids.
    pieces = written(placed.repartition(F.col("piece_")).groupBy("piece_").agg(F.bitmap_construct_agg("bit_").alias("map_")))
    place = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(F.col("map_"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.bit_get(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    return df.join(F.broadcast(pieces), F.when(F.col(by).isNotNull(), F.bitmap_bucket_number(cell)) == F.col("piece_"), "left").select(*[df[c] for c in df.columns], set_.alias("may_"))


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df (doc_id, ...) less its rows whose doc_id is among the ids; a null doc_id is none of them.

    Ids alone are shuffled, and those rows of which neither a bitmap of the ids that go nor one of those that stay can tell: a tenth or so.
    """
    ids = written(ids)
    stay = written(df.select("doc_id").join(ids, "doc_id", "left_anti"))
    told = maybe_among(maybe_among(df, ids).withColumnRenamed("may_", "goes_"), stay)
    return told.where("NOT goes_").select(*df.columns).unionByName(told.where("goes_ AND may_").join(ids, "doc_id", "left_anti").select(*df.columns))


def _by_size(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(len(batch) * most // max(1, batch.nbytes)))
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    bucket = table.column(0).to_numpy()
    order = np.argsort(bucket, kind="stable")
    table, bucket = table.take(pa.array(order)).combine_chunks(), bucket[order]
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
    values = [c.to_pylist() for c in table.columns[1:]]
    codec = pa.Codec("zstd", compression_level=3)
    payloads = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        raw = pickle.dumps([v[a:b] for v in values], protocol=5)
        payloads.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def unpacked(payloads: list[bytes], fields: int) -> list[list]:
    """The columns, besides bucket, of all packed rows."""
    codec = pa.Codec("zstd")
    out: list[list] = [[] for _ in range(fields)]
    for p in payloads:
        for values, more in zip(out, pickle.loads(codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True)), strict=True):
            values += more
    return out
