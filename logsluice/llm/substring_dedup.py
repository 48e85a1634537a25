"""Removal of long passages that an earlier document has too, by recompression.

Every text is a sequence of words. Equal neighbours become a run, named by the word and their number; then, in each of LEVELS
levels, pairs of a left and a right symbol become one, sides being a bit of a symbol's name at that level. A name is a hash
of what it stands for, so all tasks name equal runs and pairs alike without an exchange for each level; the Spark round below
enters the names that matter in one register, where a name with two contents is two names. A symbol's context is all words
on which it depends that it is formed: its own, and those of a neighbour which could have taken a part of it. Where a passage holds the context,
it holds the symbol. So of the symbols with their context in it a window of `window` words has the same wherever it occurs. Its
anchors are the longest ones (some ten words in prose, a single word where all are equal), of equally long ones those with the least hash.

1. Each task sends its anchors by name, with a second hash of their words; a symbol that documents with different ids have is shared.
2. Shared symbols reveal repeats: only windows that hold the context of one are looked at. Their own names (128 bits, of all
   their words) are sent by name, and where the least doc_id is another document's, the window's start goes back to its document.
3. Each document drops the words that such windows cover.

What moves are packed arrays, a payload for each task and bucket. Before sending, a task settles what it can: of a symbol or
window that many of its documents have, one entry leaves the task, so a passage that a third of all documents share
costs an entry a task. Documents meet their results by a hash of the id, in buckets; their number follows the size of the texts.

Cases: null text has no words; texts shorter than a window stay; a document with null doc_id neither loses words nor takes
others'; rows with one doc_id don't take each other's; an empty table gives no rows; very long texts are whole; other columns, whatever
their names, are not looked at but those of `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logsluice.llm.common import bucket_of_id, buckets_for, columns, frugal, in_slices, joined, kept_columns, mix64, packed_rows, received, run_hashes, sent_by_bucket, unpacked, word_hashes

#: Levels of pairs: symbols grow by a third a level, and what a window loses at its ends grows with them.
LEVELS = 9
#: Windows that are longer than this would need wider fields.
WIDEST = 250
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 64 << 20
#: Bytes of text whose symbols are in memory at a time, and those whose anchors are settled together, about.
STEP, SETTLED = 1 << 20, 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)


class Symbols(NamedTuple):
    """Symbols as words [start, end) of all texts, with their context [left, right)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def take(self, which: np.ndarray) -> Symbols:
        return Symbols(*(x[which] for x in self))


def symbols(words: np.ndarray, counts: np.ndarray, window: int) -> Symbols:
    """All symbols of the texts, of every level, whose context is no longer than a window."""
    n = len(words)
    place = np.arange(n)
    now = Symbols(words, place, place + 1, place, place + 1)
    found = [now]
    doc = np.repeat(np.arange(len(counts)), counts)
    first, end = np.cumsum(counts) - counts, np.cumsum(counts)
    # Runs: a symbol depends on both neighbours being others. Outside of a text there is a neighbour that nobody knows.
    new = np.ones(n, dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], n)
    long = stop - at
    name = np.where(long > 1, mix64(words[at] + long.astype(np.uint64) * ODD), words[at])
    now, doc = Symbols(name, at, stop, at - 1, stop + 1), doc[at]
    found.append(now.take(np.flatnonzero((long > 1) & (long + 2 <= window))))
    for level in range(LEVELS):
        if len(now.name) < 2:
            break
        right = (mix64(now.name + np.uint64(1000 + level)) & np.uint64(1)).astype(bool)
        next_ = np.append(doc[1:] == doc[:-1], False)
        pair = ~right & next_ & np.append(right[1:], False)
        taken = np.append(False, pair[:-1])
        # One that stays depends on the neighbour that could have taken it: a left one on what follows, a right one on what is before.
        left, end_ = now.left.copy(), now.right.copy()
        waits = np.flatnonzero(~right & ~pair)
        end_[waits] = np.maximum(end_[waits], np.where(next_[waits], now.right[np.minimum(waits + 1, len(doc) - 1)], end[doc[waits]] + 1))
        waits = np.flatnonzero(right & ~taken)
        before = np.append(False, next_[:-1])
        left[waits] = np.minimum(left[waits], np.where(before[waits], now.left[np.maximum(waits - 1, 0)], first[doc[waits]] - 1))
        p = np.flatnonzero(pair)
        name, stop = now.name.copy(), now.end.copy()
        name[p] = mix64(mix64(now.name[p]) ^ now.name[p + 1] * ODD)
        stop[p] = now.end[p + 1]
        left[p], end_[p] = np.minimum(now.left[p], now.left[p + 1]), np.maximum(now.right[p], now.right[p + 1])
        now = Symbols(name, now.start, stop, left, end_)
        small = p[end_[p] - left[p] <= window]
        found.append(now.take(small))
        now, doc = now.take(~taken), doc[~taken]
    return Symbols(*(np.concatenate(x) for x in zip(*found, strict=True)))


class Anchors(NamedTuple):
    name: np.ndarray
    check: np.ndarray  # another hash of its words
    of: np.ndarray  # text
    at: np.ndarray  # first word of the context, in the text
    span: np.ndarray  # words of the context
    words: np.ndarray  # words of the symbol


def anchors(words: np.ndarray, counts: np.ndarray, window: int) -> Anchors:
    """The anchors of all windows of the texts."""
    first, end = np.cumsum(counts) - counts, np.cumsum(counts)
    all_ = symbols(words, counts, window)
    doc = np.repeat(np.arange(len(counts)), counts)[all_.start] if len(words) else np.zeros(0, np.int64)
    # Windows, by their first word, that hold the context; all within the text.
    lo, hi = np.maximum(all_.right - window, first[doc]), np.minimum(all_.left, end[doc] - window)
    there = np.flatnonzero((all_.left >= first[doc]) & (all_.right <= end[doc]) & (lo <= hi))
    if not len(there):
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none.astype(np.uint32), none, none, none, none)
    all_, doc, lo, hi = all_.take(there), doc[there], lo[there], hi[there]
    size = all_.end - all_.start
    rank = size.astype(np.uint64) << np.uint64(56) | mix64(all_.name ^ ODD) >> np.uint64(8)
    # The highest rank at each window: ranges are put down as two overlapping spans of a power of two, which hand on to their halves.
    level = np.floor(np.log2(hi - lo + 1)).astype(np.int64)
    best = np.zeros(0, dtype=np.uint64)
    for k in range(int(level.max()), -1, -1):
        half = 1 << k
        spans = np.zeros(len(words), dtype=np.uint64)
        if len(best):
            spans = np.maximum(spans, best)
            spans[half:] = np.maximum(spans[half:], best[:-half])
        here = np.flatnonzero(level == k)
        np.maximum.at(spans, lo[here], rank[here])
        np.maximum.at(spans, hi[here] - half + 1, rank[here])
        best = spans
    # A symbol is an anchor where some window in its range has none of a higher rank: where the least of these is its own.
    is_anchor = np.zeros(len(rank), dtype=bool)
    for k in range(int(level.max()) + 1):
        half = 1 << k
        here = np.flatnonzero(level == k)
        is_anchor[here] = np.minimum(best[lo[here]], best[hi[here] - half + 1]) == rank[here]
        ahead = np.append(best[half:], np.full(min(half, len(best)), np.iinfo(np.uint64).max, dtype=np.uint64))
        best = np.minimum(best, ahead)
    which = np.flatnonzero(is_anchor)
    which = which[np.argsort(all_.start[which], kind="stable")]
    all_, doc = all_.take(which), doc[which]
    check = (run_hashes(mix64(words + ODD), all_.start, all_.end) >> np.uint64(32)).astype(np.uint32)
    return Anchors(all_.name, check, doc, all_.left - first[doc], all_.right - all_.left, all_.end - all_.start)


def anchors_of(texts: pa.RecordBatch, window: int) -> Anchors:
    """The anchors of rows (doc_id, text). Symbols take some fifty times the memory of their text, so they are made for a few texts at a time."""
    parts, row = [], 0
    for part in in_slices(texts, 1, STEP):
        got = anchors(*word_hashes(*joined(part.column(1))), window)
        parts.append(got._replace(of=got.of + row))
        row += len(part)
    return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (mix64(x.astype(np.uint64) + np.uint64(77)) % np.uint64(n)).astype(np.int64)


def _rows(parts: list[tuple[str, list[tuple[int, bytes]]]]) -> dict[str, pa.Array]:
    rows = [(b, kind, p) for kind, sent in parts for b, p in sent]
    return {"bucket": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.string()), "payload": pa.array([r[2] for r in rows], pa.binary())}


def _settled(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By entry of a key in two parts: whether its key has documents with different ids, whether its own is not the least, whether it is the first of the least."""
    order = np.lexsort((doc, two, one))
    k, j, d = one[order], two[order], doc[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = (k[1:] != k[:-1]) | (j[1:] != j[:-1])
    of = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(k)) - 1
    shared, later, leads = np.empty(len(k), bool), np.empty(len(k), bool), np.empty(len(k), bool)
    shared[order] = (d[at] != d[last])[of] if len(k) else first
    later[order] = d != d[at][of] if len(k) else first
    leads[order] = first
    return shared, later, leads


SENT = "bucket int, kind string, payload binary"


def removable(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, payload): doc_id and first word of the windows that a document with a smaller id has too, by the doc_id's bucket."""
    docs = docs.where("doc_id IS NOT NULL")
    dealt = packed_rows(docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text"))

    @frugal
    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 1, SETTLED):
                got = anchors_of(batch, window)
                doc = batch.column(0).to_numpy(zero_copy_only=False)[got.of]
                at, span = got.at.astype(np.int32), got.span.astype(np.uint8)
                shared, _, leads = _settled(got.name, got.check, doc)
                x = ~shared | leads
                out = [("entry", sent_by_bucket(_bucket(got.name[x], buckets), got.name[x], got.check[x], doc[x], at[x], span[x]))]
                out.append(("known", sent_by_bucket(bucket_of_id(doc[shared], buckets), doc[shared], at[shared], span[shared])))
                yield pa.RecordBatch.from_pydict(_rows(out))

    @frugal
    def share_anchors(t: pa.Table) -> pa.Table:
        name, check, doc, at, span = received([p for p, k in zip(t["payload"].to_pylist(), t["kind"].to_pylist(), strict=True) if k == "entry"], "<u8", "<u4", "<i8", "<i4", "u1")
        shared, _, _ = _settled(name, check, doc)
        parts = [("known", sent_by_bucket(bucket_of_id(doc[shared], buckets), doc[shared], at[shared], span[shared]))]
        parts += [("known", [(b, p)]) for b, p, k in zip(t["bucket"].to_pylist(), t["payload"].to_pylist(), t["kind"].to_pylist(), strict=True) if k == "known"]
        return pa.Table.from_pydict(_rows(parts))

    @frugal
    def send_windows(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc_a, at, span = received(found["payload"].to_pylist(), "<i8", "<i4", "u1")
        order = np.argsort(doc_a, kind="stable")
        doc_a, at, span = doc_a[order], at[order].astype(np.int64), span[order].astype(np.int64)
        active = set(doc_a.tolist())
        some = [(d, t) for p in texts["payload"].to_pylist() for d, t in zip(*unpacked([p], 2), strict=True) if d in active]
        whole = pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([t for _, t in some], pa.string())], names=["doc_id", "text"])
        windows = []
        for part in in_slices(whole, 1, STEP):
            ids = part.column(0).to_numpy()
            words, counts = word_hashes(*joined(part.column(1)))
            begin = np.cumsum(counts) - counts
            # Anchors of these texts, and the windows that hold their context.
            lo, hi = np.searchsorted(doc_a, ids), np.searchsorted(doc_a, ids, side="right")
            row = np.repeat(np.arange(len(ids)), hi - lo)
            which = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            a, b = np.maximum(at[which] + span[which] - window, 0), np.minimum(at[which], counts[row] - window)
            ok = a <= b
            change = np.bincount(begin[row[ok]] + a[ok], minlength=len(words) + 1) - np.bincount(begin[row[ok]] + b[ok] + 1, minlength=len(words) + 1)
            start = np.flatnonzero(np.cumsum(change)[: len(words)] > 0)
            of = np.repeat(np.arange(len(ids)), counts)[start]
            one, two = run_hashes(words, start, start + window), run_hashes(mix64(words + ODD), start, start + window)
            windows.append((one, two, ids[of], (start - begin[of]).astype(np.int32)))
        if not windows:
            return pa.Table.from_pydict(_rows([]))
        one, two, doc, word = (np.concatenate(x) for x in zip(*windows, strict=True))
        # Of equal windows only those of the least document leave the task as such; the others are settled.
        _, later, _ = _settled(one, two, doc)
        first = ~later
        out = [("entry", sent_by_bucket(_bucket(one[first], buckets), one[first], two[first], doc[first], word[first]))]
        out.append(("known", sent_by_bucket(bucket_of_id(doc[later], buckets), doc[later], word[later])))
        return pa.Table.from_pydict(_rows(out))

    @frugal
    def judge_windows(t: pa.Table) -> pa.Table:
        one, two, doc, at = received([p for p, k in zip(t["payload"].to_pylist(), t["kind"].to_pylist(), strict=True) if k == "entry"], "<u8", "<u8", "<i8", "<i4")
        _, later, _ = _settled(one, two, doc)
        parts = [("known", sent_by_bucket(bucket_of_id(doc[later], buckets), doc[later], at[later]))]
        parts += [("known", [(b, p)]) for b, p, k in zip(t["bucket"].to_pylist(), t["payload"].to_pylist(), t["kind"].to_pylist(), strict=True) if k == "known"]
        return pa.Table.from_pydict(_rows(parts))

    found = docs.select("doc_id", "text").mapInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(share_anchors, SENT)
    windows = dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(send_windows, SENT)
    return windows.groupBy("bucket").applyInArrow(judge_windows, SENT)


def remove(docs: DataFrame, *, window: int = 50, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns of `keep`, n_words, n_removed, kept (its kept words, joined by one space).

    buckets: parts into which what moves is cut, a task's memory holds one with its texts; None: by the input's size.
    """
    if not 1 <= window <= WIDEST:
        raise ValueError(f"windows have 1 to {WIDEST} words")
    df = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"), **kept_columns(docs, keep))
    buckets = buckets or buckets_for(df, "text", BUCKET_BYTES)
    # Documents without an id go to any bucket, whatever their text.
    bucket = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id")), F.lit(buckets)).cast("int").alias("bucket")
    fields = df.select("doc_id", *[f"keep_{i}" for i in range(len(keep))]).schema
    # A kept column that is the text itself is not sent a second time.
    same = [f"keep_{i}" for i, c in enumerate(keep) if c == text_col and fields[f"keep_{i}"].dataType == df.schema["text"].dataType]
    sent = [f for f in fields.names if f not in same]
    dealt = packed_rows(df.select(bucket, "text", *sent))
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long", "n_removed long", "kept string"])

    names, kinds = fields.names, [x.type for x in to_arrow_schema(fields)]

    @frugal
    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc_a, at = received(found["payload"].to_pylist(), "<i8", "<i4")
        order = np.lexsort((at, doc_a))
        doc_a, at = doc_a[order], at[order].astype(np.int64)
        rows = unpacked(texts["payload"].to_pylist(), 1 + len(sent))
        known = [d is not None for d in rows[1]]
        ids = np.array([d or 0 for d in rows[1]], dtype=np.int64)
        lo, hi = np.searchsorted(doc_a, ids), np.searchsorted(doc_a, ids, side="right")
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(rows[0]):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            n_words.append(len(words))
            if known[i] and hi[i] > lo[i]:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                start = np.unique(at[lo[i] : hi[i]])
                start = start[start <= len(words) - window]
                change[start] += 1
                change[start + window] -= 1
                gone = np.cumsum(change[:-1]) > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        carried = dict(zip(sent, rows[1:], strict=True)) | dict.fromkeys(same, rows[0])
        arrays = {name: pa.array(carried[name], kind) for name, kind in zip(names, kinds, strict=True)}
        return pa.Table.from_pydict(arrays | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    found = removable(df.select("doc_id", "text"), window, buckets)
    out = dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(cut, out_schema)
    return out.select("doc_id", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept")
