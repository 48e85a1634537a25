"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (runs of letters, lower-cased) are read in windows of WINDOW words that overlap by half and cover all of it.
A word has two inputs: a learned vector, where it is in the vocabulary (else that of unknown words), and the mean of
learned vectors of its character trigrams (by a hash of their bytes, word ends included). A gated recurrent layer runs over
each window in either direction, attention pools its states, and a dense unit gives the window's probability. A document
has that of its most toxic window.

Labels are of documents, so training has to find the windows: first those of toxic documents that hold the words most
telling of the label, then, after some epochs, those that the network itself scores highest. Windows of clean documents
are all negative: some at random, and those that the network likes most.

Training takes a bounded sample of labelled rows on the driver: `rows` for each label, of longer texts `longest` characters. Scoring is one pass without a shuffle;
the input side of the gates is computed once for each different word of a batch.

Cases: null text, or text without a word, is scored as one empty window (0 words, score from the bias alone); without labels of both
kinds every score is the share of the label seen, or 0; very long texts are scored whole; equal texts get equal scores, so repeated rows do;
a null doc_id is scored like others and never learnt from; other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsluice.llm.common import columns, frugal, in_slices, joined, labelled_texts, mix64, span_hashes, word_spans
from logsluice.llm.nn import Adam, Params, normal, sigmoid

WINDOW, HOP = 24, 12
WORD_DIMS, CHAR_DIMS, STATE, ATTENTION = 8, 8, 10, 8
BUCKETS = 4096
#: All ASCII but letters parts words; bytes of other letters don't.
GAPS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
GATES = 3 * STATE


class Words:
    """The words of some texts: each different one once, with its trigrams, and the sequence of all."""

    def __init__(self, texts: pa.Array) -> None:
        data, ends = joined(texts)
        data = LOWER[data]
        begin, end, self.counts = word_spans(data, ends, GAPS)
        hashes = span_hashes(data, begin, end)
        self.hashes, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        begin, end = begin[first], end[first]
        # Trigrams of a word with an end mark on either side: as many as it has bytes.
        size = end - begin
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        left = np.where(place > np.repeat(begin, size), data[place - 1], 0).astype(np.uint64)
        right = np.where(place + 1 < np.repeat(end, size), data[np.minimum(place + 1, len(data) - 1)], 0).astype(np.uint64)
        gram = left << np.uint64(16) | data[place].astype(np.uint64) << np.uint64(8) | right
        self.gram = (mix64(gram) % np.uint64(BUCKETS)).astype(np.int64)
        self.size, self.edge = size, np.cumsum(size) - size


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word among all words, length) of each window; a text has one at least."""
    n = np.maximum(1, -(-(counts - (WINDOW - HOP)) // HOP))
    of = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(counts) - counts)[of] + nth * HOP
    return of, begin, np.clip(counts[of] - nth * HOP, 0, WINDOW)


def inputs(p: Params, vocabulary: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Input vector of each different word, and its row in the table of words (0: unknown)."""
    row = np.searchsorted(vocabulary, words.hashes)
    row = np.where(vocabulary[np.minimum(row, len(vocabulary) - 1)] == words.hashes, row + 1, 0) if len(vocabulary) else np.zeros(len(words.hashes), dtype=np.int64)
    chars = np.add.reduceat(p["chars"][words.gram], words.edge, axis=0) / words.size[:, None] if len(words.size) else np.zeros((0, CHAR_DIMS), np.float32)
    return np.concatenate([p["words"][row], chars], axis=1).astype(np.float32), row


def recurrent(p: Params, side: str, x: np.ndarray, there: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time x windows x STATE) for the inputs' share of the gates x (time x windows x GATES); there: 0 past a window's end."""
    u, un = p[f"u_{side}"][:, : 2 * STATE], p[f"u_{side}"][:, 2 * STATE :]
    out = np.empty((*x.shape[:2], STATE), dtype=np.float32)
    h = np.zeros((x.shape[1], STATE), dtype=np.float32)
    kept = []
    for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
        gates = h @ u
        gates += x[t, :, : 2 * STATE]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :STATE], gates[:, STATE:]
        rh = r * h
        n = rh @ un
        n += x[t, :, 2 * STATE :]
        np.tanh(n, out=n)
        step = (n - h) * z
        step *= there[t]
        if keep:
            kept.append((t, h, z, r, rh, n))
        h = h + step
        out[t] = h
    return out, kept


def pooled(p: Params, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Window probabilities from the states of both directions (time x windows x 2 * STATE)."""
    key = np.tanh(states @ p["key"] + p["key_bias"])
    weight = np.exp(key @ p["query"])[..., 0] * there[..., 0]
    weight /= np.maximum(weight.sum(axis=0, keepdims=True), 1e-9)
    pool = np.einsum("tw,tws->ws", weight, states)
    return sigmoid(pool @ p["out"] + p["out_bias"])[:, 0], (key, weight, pool)


def forward(p: Params, x: np.ndarray, at: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """x: inputs of the different words; at: (time x windows) which word."""
    there = (np.arange(len(at))[:, None] < size[None, :]).astype(np.float32)[..., None]
    states, kept = [], []
    for side in "fb":
        gates = x @ p[f"w_{side}"] + p[f"b_{side}"]
        s, k = recurrent(p, side, gates[at], there, keep)
        states.append(s)
        kept.append(k)
    both = np.concatenate(states, axis=2)
    score, rest = pooled(p, both, there)
    return score, (there, both, kept, *rest)


def backward(p: Params, x: np.ndarray, at: np.ndarray, cache: tuple, d_out: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients, and that of x; d_out: of the loss by the last sum, per window."""
    there, both, kept, key, weight, pool = cache
    g: Params = {"out": pool.T @ d_out[:, None], "out_bias": np.array([d_out.sum()])}
    d_pool = d_out[:, None] * p["out"].T
    d_states = weight[..., None] * d_pool[None]
    d_weight = np.einsum("ws,tws->tw", d_pool, both)
    d_logit = weight * (d_weight - (weight * d_weight).sum(axis=0, keepdims=True))
    flat_key, flat_states = key.reshape(-1, ATTENTION), both.reshape(-1, 2 * STATE)
    g["query"] = flat_key.T @ d_logit.reshape(-1, 1)
    d_key = d_logit.reshape(-1, 1) * p["query"].T * (1 - flat_key * flat_key)
    g["key"], g["key_bias"] = flat_states.T @ d_key, d_key.sum(axis=0)
    d_states = d_states + (d_key @ p["key"].T).reshape(both.shape)
    d_x = np.zeros_like(x)
    for k, side in enumerate("fb"):
        u, un = p[f"u_{side}"][:, : 2 * STATE], p[f"u_{side}"][:, 2 * STATE :]
        d_u = np.zeros_like(p[f"u_{side}"])
        d_gates = np.zeros((*at.shape, GATES), dtype=np.float32)
        d_h = np.zeros((at.shape[1], STATE), dtype=np.float32)
        for t, h, z, r, rh, n in reversed(kept[k]):
            d_h = d_h + d_states[t, :, k * STATE : (k + 1) * STATE]
            d_step = d_h * there[t]
            d_n = d_step * z * (1 - n * n)
            d_rh = d_n @ un.T
            d_z = d_step * (n - h) * z * (1 - z)
            d_r = d_rh * h * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u[:, : 2 * STATE] += h.T @ d_gates[t][:, : 2 * STATE]
            d_u[:, 2 * STATE :] += rh.T @ d_n
            d_h = d_h - d_step * z + d_rh * r + d_gates[t][:, : 2 * STATE] @ u.T
        flat = d_gates.reshape(-1, GATES)
        g[f"u_{side}"], g[f"b_{side}"] = d_u, flat.sum(axis=0)
        per_word = np.zeros((len(x), GATES), dtype=np.float32)
        np.add.at(per_word, at.ravel(), flat)
        g[f"w_{side}"] = x.T @ per_word
        d_x += per_word @ p[f"w_{side}"].T
    return g, d_x


class Reader:
    """Windows of some texts as indices of their different words."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = Words(texts)
        self.of, self.begin, self.size = windows_of(self.words.counts)

    def at(self, chosen: np.ndarray) -> np.ndarray:
        place = self.begin[chosen][None, :] + np.arange(WINDOW)[:, None]
        return self.words.at[np.minimum(place, max(0, len(self.words.at) - 1))] if len(self.words.at) else np.zeros(place.shape, dtype=np.int64)


def window_scores(p: Params, vocabulary: np.ndarray, reader: Reader) -> np.ndarray:
    x, _ = inputs(p, vocabulary, reader.words)
    if not len(x):
        x = np.zeros((1, WORD_DIMS + CHAR_DIMS), dtype=np.float32)
    out = np.empty(len(reader.of))
    gates = {side: x @ p[f"w_{side}"] + p[f"b_{side}"] for side in "fb"}
    for a in range(0, len(out), 1024):  # so many that a step's arrays stay in the cache
        chosen = np.arange(a, min(a + 1024, len(out)))
        at = reader.at(chosen)
        there = (np.arange(WINDOW)[:, None] < reader.size[chosen][None, :]).astype(np.float32)[..., None]
        states = np.concatenate([recurrent(p, side, gates[side][at], there, False)[0] for side in "fb"], axis=2)
        out[chosen] = pooled(p, states, there)[0]
    return out


def document_scores(p: Params, vocabulary: np.ndarray, texts: pa.Array) -> np.ndarray:
    reader = Reader(texts)
    score = window_scores(p, vocabulary, reader)
    return np.maximum.reduceat(score, np.flatnonzero(np.diff(reader.of, prepend=-1))) if len(score) else score


def fit(texts: list[str], labels: np.ndarray, *, rounds: int = 4, steps: int = 70, batch: int = 192, words: int = 20_000, seed: int = 1) -> tuple[Params, np.ndarray]:
    """Weights and the vocabulary (sorted hashes of the words of three training texts or more)."""
    rng = np.random.default_rng(seed)
    reader = Reader(pa.array(texts, pa.string()))
    w = reader.words
    toxic = labels.astype(bool)
    doc = np.repeat(np.arange(len(texts)), w.counts)
    pairs = np.unique(doc * len(w.hashes) + w.at)
    in_docs = np.bincount(pairs % len(w.hashes), minlength=len(w.hashes))
    in_toxic = np.bincount(pairs % len(w.hashes), weights=toxic[pairs // len(w.hashes)], minlength=len(w.hashes))
    telling = np.log((in_toxic + 0.1) / (toxic.sum() + 1)) - np.log((in_docs - in_toxic + 0.1) / ((~toxic).sum() + 1))
    # Few texts say little of a word: its weight shrinks with them.
    telling *= in_docs / (in_docs + 3)
    frequent = np.argsort(-in_docs, kind="stable")[:words]
    clearest = np.argsort(-np.abs(telling), kind="stable")[: words // 4]
    kept = np.union1d(frequent, clearest)
    vocabulary = np.sort(w.hashes[kept[in_docs[kept] >= 3]])
    d = WORD_DIMS + CHAR_DIMS
    p: Params = {"words": normal(rng, len(vocabulary) + 1, WORD_DIMS, scale=0.3), "chars": normal(rng, BUCKETS, CHAR_DIMS, scale=0.3)}
    for side in "fb":
        p |= {f"w_{side}": normal(rng, d, GATES), f"u_{side}": normal(rng, STATE, GATES), f"b_{side}": np.zeros(GATES, np.float32)}
    p |= {"key": normal(rng, 2 * STATE, ATTENTION), "key_bias": np.zeros(ATTENTION, np.float32), "query": normal(rng, ATTENTION, 1), "out": normal(rng, 2 * STATE, 1), "out_bias": np.full(1, -1, np.float32)}
    adam = Adam(p, rate=0.01)
    all_at = reader.at(np.arange(len(reader.of)))
    inside = np.arange(WINDOW)[:, None] < reader.size[None, :]
    liked = np.where(inside, telling[all_at], -9).max(axis=0)
    bad = toxic[reader.of]
    edge = np.flatnonzero(np.diff(reader.of, prepend=-1))
    for again in range(rounds):
        best = np.maximum.reduceat(liked, edge)[reader.of]
        # The windows of a toxic text that are as telling as its clearest one, or nearly; the others are left out, and so
        # are texts in which nothing tells, unless all are such.
        near = bad & (liked >= best - (0.05 if again else 0.5))
        positive = np.flatnonzero(near & (best >= (0.25 if again else 0.4 * np.quantile(best[near], 0.9))))
        positive = positive if len(positive) >= 10 else np.flatnonzero(near)
        clean = np.flatnonzero(~bad)
        hard = clean[np.argsort(-liked[clean], kind="stable")[: len(positive) // 2]]
        for step in range(steps):
            adam.rate = 0.01 * (1 - 0.8 * (again * steps + step) / (rounds * steps))
            n = batch // 3
            chosen = np.concatenate([rng.choice(positive, n), rng.choice(clean, batch - 2 * n), rng.choice(hard if len(hard) else clean, n)])
            y = bad[chosen].astype(np.float32)
            used, at = np.unique(all_at[:, chosen], return_inverse=True)
            at = at.reshape(WINDOW, -1)
            part = _part(w, used)
            x, row = inputs(p, vocabulary, part)
            score, cache = forward(p, x, at, reader.size[chosen], keep=True)
            g, d_x = backward(p, x, at, cache, ((score - y) / len(chosen)).astype(np.float32))
            g["words"] = np.zeros_like(p["words"])
            np.add.at(g["words"], row, d_x[:, :WORD_DIMS])
            g["chars"] = np.zeros_like(p["chars"])
            np.add.at(g["chars"], part.gram, np.repeat(d_x[:, WORD_DIMS:] / part.size[:, None], part.size, axis=0))
            adam.step(g)
        liked = window_scores(p, vocabulary, reader)
    # Document scores are the largest of many windows': the bias is moved so that 0.5 parts the training texts best.
    most = np.maximum.reduceat(liked, edge)
    order = np.sort(most)
    between = (order[1:] + order[:-1]) / 2
    error = np.array([((most >= c) != toxic).sum() for c in between]) if len(between) else np.zeros(0)
    if len(error):
        good = between[error == error.min()]
        cut = float(np.clip(good[len(good) // 2], 1e-6, 1 - 1e-6))
        p["out_bias"] = (p["out_bias"] - np.log(cut / (1 - cut))).astype(np.float32)
    return p, vocabulary


def _part(w: Words, used: np.ndarray) -> Words:
    part = object.__new__(Words)
    part.hashes, part.size = w.hashes[used], w.size[used]
    part.edge = np.cumsum(part.size) - part.size
    part.gram = w.gram[np.repeat(w.edge[used] - part.edge, part.size) + np.arange(part.size.sum())]
    return part


def train(docs: DataFrame, labels: DataFrame, *, rows: int = 2000, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> tuple[Params, np.ndarray] | float:
    """The network from about `rows` texts of each label, of longer texts a window of `longest` characters; a number where one label is missing."""
    texts, y = labelled_texts(docs, labels, label_col, rows, longest, id_col, text_col)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    return fit(texts, y, **how)


def score(docs: DataFrame, model: tuple[Params, np.ndarray] | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 1, 1 << 21):
                got = document_scores(*sent.value, batch.column(1)) if isinstance(sent.value, tuple) else np.full(len(batch), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, score double")
