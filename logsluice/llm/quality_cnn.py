"""Quality classifier: a byte-level convolutional network in numpy.

A text is its bytes, cut into overlapping chunks that cover all of it. A byte is a learned vector. Learned filters slide over each
chunk; their largest responses are the chunk's features, the largest over all chunks are the document's, and a small dense
layer combines these into one probability.

Training takes a bounded sample of labelled rows (`rows` for each label, of longer texts a window of `longest` characters) and, of
each document, a few chunks an epoch. It runs on the driver in seconds, whatever the input; scoring is one pass without a
shuffle. Weights are some thousand numbers.

Cases: null or empty text is scored as one chunk of zero bytes; without labels of both kinds every score is the share of the label
seen, or 0.5; very long texts are scored whole, some chunks at a time; equal texts get equal scores, in any batch, so repeated rows
do; a null doc_id is scored like others and never learnt from; other columns, whatever their names, are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsluice.llm.common import columns, frugal, in_slices, joined, labelled_texts
from logsluice.llm.nn import Adam, Params, normal, sigmoid

CHUNK, HOP = 256, 192
WIDTH, STRIDE = 16, 4
BYTE_DIMS, FILTERS, HIDDEN = 6, 32, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these sizes, which text each chunk is of and where in it the chunk begins; one chunk at least."""
    n = np.maximum(1, -(-(sizes - (CHUNK - HOP)) // HOP))
    of = np.repeat(np.arange(len(sizes)), n)
    return of, (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * HOP


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each chunk, its bytes) for some chunks at a time; bytes past a text's end are 0."""
    data, ends = joined(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts - 1
    of, at = chunk_starts(sizes)
    for a in range(0, len(of), 8192):
        o, s = of[a : a + 8192], at[a : a + 8192]
        place = s[:, None] + np.arange(CHUNK)
        inside = place < sizes[o][:, None]
        place = np.minimum(place + starts[o][:, None], len(data) - 1)
        yield o, np.where(inside, data[place], 0).astype(np.uint8)


def responses(p: Params, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Largest response of each filter in each chunk, after a ramp."""
    row = p["bytes"][data].reshape(len(data), -1)
    windows = np.lib.stride_tricks.sliding_window_view(row, WIDTH * BYTE_DIMS, axis=1)[:, :: STRIDE * BYTE_DIMS]
    flat = np.ascontiguousarray(windows).reshape(-1, WIDTH * BYTE_DIMS)
    z = (flat @ p["filters"]).reshape(len(data), PLACES, FILTERS)
    if not keep:
        return np.maximum(z.max(axis=1) + p["bias"], 0), ()
    best = z.argmax(axis=1)
    top = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0] + p["bias"]
    return np.maximum(top, 0), (flat, best, top)


def combined(p: Params, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(most @ p["dense"] + p["dense_bias"])
    return sigmoid(hidden @ p["out"] + p["out_bias"])[:, 0], hidden


def fit(texts: list[str], labels: np.ndarray, *, steps: int = 400, batch: int = 64, pieces: int = 6, seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {
        "bytes": normal(rng, 256, BYTE_DIMS, scale=0.5), "filters": normal(rng, WIDTH * BYTE_DIMS, FILTERS), "bias": np.zeros(FILTERS, np.float32),
        "dense": normal(rng, FILTERS, HIDDEN), "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(rng, HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
    }
    data, of = [], []
    for o, d in chunks(pa.array(texts, pa.string())):
        of.append(o), data.append(d)
    of, data = np.concatenate(of), np.concatenate(data)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    y = labels.astype(np.float32)
    # Both labels weigh the same in part, so that a rare one is learnt, and scores stay near frequencies.
    share = float(y.mean())
    weight = np.where(y > 0, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5).astype(np.float32)
    adam = Adam(p, rate=0.004, decay=0.002)
    epochs = max(6, -(-steps * batch // len(texts)))
    for epoch in range(epochs):
        adam.rate = 0.004 * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            docs = order[a : a + batch]
            pick = [first[d] + (np.arange(n) if (n := first[d + 1] - first[d]) <= pieces else rng.choice(n, pieces, replace=False)) for d in docs]
            counts = np.array([len(x) for x in pick])
            rows = np.concatenate(pick)
            feature, (flat, best, top) = responses(p, data[rows], keep=True)
            most = np.maximum.reduceat(feature, np.cumsum(counts) - counts, axis=0)
            score, hidden = combined(p, most)
            g: Params = {}
            d_out = ((score - y[docs]) * weight[docs] / len(docs))[:, None]
            g["out"], g["out_bias"] = hidden.T @ d_out, d_out.sum(axis=0)
            d_hidden = (d_out @ p["out"].T) * (1 - hidden * hidden)
            g["dense"], g["dense_bias"] = most.T @ d_hidden, d_hidden.sum(axis=0)
            owner = np.repeat(np.arange(len(docs)), counts)
            d_feature = (d_hidden @ p["dense"].T)[owner] * (feature == most[owner])
            d_top = d_feature * (top > 0)
            g["bias"] = d_top.sum(axis=0)
            # The gradient reaches a filter through the one place where it responded most.
            place = best + np.arange(len(rows))[:, None] * PLACES
            g["filters"] = np.stack([flat[place[:, f]].T @ d_top[:, f] for f in range(FILTERS)], axis=1)
            back = d_top[:, :, None] * p["filters"].T[None]
            back = back.reshape(len(rows), FILTERS, WIDTH, BYTE_DIMS)
            seen = data[rows][np.arange(len(rows))[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)]
            g["bytes"] = np.zeros_like(p["bytes"])
            np.add.at(g["bytes"], seen.ravel(), back.reshape(-1, BYTE_DIMS))
            adam.step(g)
    return p


def scores(p: Params, texts: pa.Array) -> np.ndarray:
    most = np.zeros((len(texts), FILTERS), dtype=np.float32)
    for of, data in chunks(texts):
        for a in range(0, len(of), 512):  # so many that the windows stay in the cache
            feature, _ = responses(p, data[a : a + 512])
            o = of[a : a + 512]
            edge = np.flatnonzero(np.diff(o, prepend=-1))
            most[o[edge]] = np.maximum(most[o[edge]], np.maximum.reduceat(feature, edge, axis=0))
    return combined(p, most)[0].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, *, rows: int = 1500, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> Params | float:
    """Weights from about `rows` texts of each label, of longer texts a window of `longest` characters; a number where one label is missing."""
    texts, y = labelled_texts(docs, labels, label_col, rows, longest, id_col, text_col)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit(texts, y, **how)


def classify(docs: DataFrame, model: Params | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 1, 1 << 22):
                got = scores(sent.value, batch.column(1)) if isinstance(sent.value, dict) else np.full(len(batch), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, score double")
