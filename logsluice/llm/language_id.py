"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from left to right into phrases, each the
longest match that occurs in the language's text; the fewer phrases, each costing log2 of that text's length in bits, the nearer the
language. The language with the fewest bits wins, the score is its share of the likelihood 2 ** -bits.

The automata are completed into tables: where no transition exists, the parse starts a phrase anew at the root, and the
entry says so. Texts are cut into segments, so that thousands advance together, one character of each at a time. A segment is first
parsed from the root; then from the state in which the segment before it ends, until both parses are in one state: from there
they are the same, so the phrases counted are those of one parse of the whole text. Letters are lower-cased, all between words is one space.
Each letter of the training text is a symbol; a language's automaton has those that it uses. Up to DENSE bytes for all languages
together they are full tables; beyond that all are sorted keys, which cost a binary search a letter. Letters that no language has seen are one symbol.

Training takes a bounded sample: of the `languages` most frequent languages about `rows_per_language` labelled texts each, of a
longer text a window of `window` characters, `chars` characters in all. That text is broadcast (chars times the number of
languages), each Python worker builds the automata from it once.

Cases: null text, or text without a letter, is `und` with score 0; so is everything where nothing is labelled; a tie goes
to the language that sorts first; a text in letters no language has seen gets the tied languages' first, with an equal share as score; long
texts are read whole; a null doc_id is a document like others; repeated rows get the same result each; other columns, whatever
their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import columns, frugal, in_slices, sampled_rows, window_of

UNKNOWN = "und"
#: Bytes that full tables of all languages may take.
DENSE = 1 << 28
SEGMENT = 512
#: Segments that advance together: their states fit a fast cache.
LANES = 8192
_letter: list[np.ndarray] = []
_built: dict[bytes, Automata] = {}


def is_letter() -> np.ndarray:
    """By code point, whether it is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letter[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each followed by a gap, and the lengths with that gap."""
    low = [t.lower() for t in texts]
    both = "\n".join([*low, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(both, dtype=np.uint32), np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text, by state; state 0 is the root."""
    most = 2 * len(text) + 2
    link, length = [-1] * most, [0] * most
    step: list[dict[int, int]] = [{}]
    last, n = 0, 1
    for c in text:
        new = n
        n += 1
        step.append({})
        length[new] = length[last] + 1
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = n
                n += 1
                step.append(dict(step[q]))
                length[copy] = length[p] + 1
                link[copy] = link[q]
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Table:
    """A language's transitions over its own symbols, completed: next state times symbols, the sign bit where this symbol begins a phrase."""

    def __init__(self, step: list[dict[int, int]], symbols: int) -> None:
        to = np.full((len(step), symbols), -1, dtype=np.int32)
        for s, d in enumerate(step):
            if d:
                to[s, list(d)] = list(d.values())
        # After the states comes one in which every symbol starts a phrase: where a parse begins, and after an unseen symbol.
        to = np.concatenate([to, np.full((1, symbols), -1, dtype=np.int32)])
        anew = np.where(to[0] >= 0, to[0], len(to) - 1)
        table = np.where(to >= 0, to, anew[None, :]).astype(np.int32) * symbols
        table[to < 0] |= np.int32(-(1 << 31))
        self.next, self.start = table.ravel(), (len(to) - 1) * symbols

    def begun(self, block: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each lane, and its last state. block: symbols by place and lane; live: by place, how many lanes have it."""
        lanes = block.shape[1]
        state, begun, v = np.full(lanes, self.start, dtype=np.int32), np.zeros(lanes, dtype=np.int32), np.empty(lanes, dtype=np.int32)
        for t, m in enumerate(live):
            s, w = state[:m], v[:m]
            np.add(s, block[t, :m], out=s)
            np.take(self.next, s, out=w, mode="clip")
            np.bitwise_and(w, 0x7FFFFFFF, out=s)
            np.right_shift(w, 31, out=w)
            np.subtract(begun[:m], w, out=begun[:m])
        return begun, state

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where a phrase begins."""
        v = self.next[state + symbol]
        return v & 0x7FFFFFFF, v < 0


class Sparse:
    """The same for any number of symbols: only the transitions that there are, by sorted keys of state times symbols and symbol."""

    def __init__(self, step: list[dict[int, int]], symbols: int) -> None:
        self.start = len(step) * symbols
        key = np.array([s * symbols + c for s, d in enumerate(step) for c in d], dtype=np.int64)
        to = np.array([x for d in step for x in d.values()], dtype=np.int64) * symbols
        order = np.argsort(key)
        # One key more than any that is asked for, so that every search ends at a key.
        self.key, self.next = np.append(key[order], np.iinfo(np.int64).max), np.append(to[order], 0)
        self.anew = np.full(symbols, self.start, dtype=np.int64)
        self.anew[list(step[0])] = np.array(list(step[0].values()), dtype=np.int64) * symbols

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = state + symbol
        at = np.searchsorted(self.key, want)
        found = self.key[at] == want
        return np.where(found, self.next[at], self.anew[symbol]), ~found

    def begun(self, block: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, begun = np.full(block.shape[1], self.start, dtype=np.int64), np.zeros(block.shape[1], dtype=np.int32)
        for t, m in enumerate(live):
            state[:m], new = self.step(state[:m], block[t, :m])
            begun[:m] += new
        return begun, state


@dataclass
class Automata:
    languages: list[str]
    #: Symbol by code point: the gap 0, any letter that no language has seen 1.
    symbol: np.ndarray
    #: For each language its own symbol by that symbol, and its transitions.
    own: list[np.ndarray]
    tables: list[Table | Sparse]
    bits: list[float]

    @classmethod
    def build(cls, texts: dict[str, str]) -> Automata:
        languages = sorted(texts)
        letter = is_letter()
        known = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        symbol = letter.astype(np.int32)
        symbol[[ord(c) for c in known]] = np.arange(2, 2 + len(known))
        symbols = 2 + len(known)
        own, steps, bits = [], [], []
        for lang in languages:
            seq = _gaps_closed(symbol[code_points([texts[lang]])[0]])
            used = np.unique(seq[seq > 1])
            mine = np.minimum(np.arange(symbols, dtype=np.int32), 1)
            mine[used] = np.arange(2, 2 + len(used))
            steps.append((suffix_automaton(mine[seq].tolist()), 2 + len(used)))
            own.append(mine)
            bits.append(math.log2(max(2, len(seq))))
        kind = Table if sum(4 * (len(step) + 1) * n for step, n in steps) <= DENSE else Sparse
        return cls(languages, symbol, own, [kind(step, n) for step, n in steps], bits)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text (texts x languages), symbols of each text, whether it has a letter."""
        points, sizes = code_points(texts)
        seq = self.symbol[points]
        of = np.repeat(np.arange(len(texts)), sizes)
        keep = (seq != 0) | np.diff(seq, prepend=0).astype(bool)
        seq, of = seq[keep], of[keep]
        n = np.bincount(of, minlength=len(texts))
        has_letter = np.bincount(of, weights=seq != 0, minlength=len(texts)) > 0
        pieces = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(n) - n)[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, n[owner] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(texts), len(self.languages)))
        ends = [np.zeros(len(order), dtype=np.int64) for _ in self.languages]
        for a in range(0, len(order), LANES):
            lanes = order[a : a + LANES]
            size = length[lanes]
            longest = int(size[0])
            at = np.minimum(start[lanes][None, :] + np.arange(longest)[:, None], len(seq) - 1)
            block = seq[at]
            live = np.searchsorted(-size, -np.arange(longest), side="left")
            for k, (mine, table) in enumerate(zip(self.own, self.tables, strict=True)):
                begun, ends[k][lanes] = table.begun(mine[block], live)
                out[:, k] += np.bincount(owner[lanes], weights=begun, minlength=len(texts))
        later = np.flatnonzero(nth > 0)
        for k, (mine, table) in enumerate(zip(self.own, self.tables, strict=True)):
            again = later
            before = np.full(len(order), -1, dtype=np.int64)  # the state that a segment has been continued from
            counted = np.zeros(len(order), dtype=np.int64)
            while len(again):
                before[again] = ends[k][again - 1]
                more, end = _continued(table, mine, seq, start[again], length[again], before[again])
                counted[again] = more
                ends[k][again[end >= 0]] = end[end >= 0]
                # Where a segment's own end has changed, the one behind it goes on from there.
                again = again[end >= 0] + 1
                again = again[(again < len(nth)) & (nth[np.minimum(again, len(nth) - 1)] > 0)]
                again = again[ends[k][again - 1] != before[again]]
            out[:, k] += np.bincount(owner, weights=counted, minlength=len(texts))
        return out, n, has_letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a symbol of each text."""
        phrases, n, has_letter = self.phrases(texts)
        bits = phrases * np.array(self.bits)
        best = np.argmin(bits, axis=1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        lang = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has_letter, strict=True)]
        return lang, np.where(has_letter, share, 0.0), np.where(has_letter, bits[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)


def _continued(table: Table | Sparse, mine: np.ndarray, seq: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments parsed from these states rather than the root: how many more phrases begin in them, and the last state where it is another one (else -1)."""
    more, end = np.zeros(len(start), dtype=np.int64), np.full(len(start), -1, dtype=np.int64)
    live, root, t = np.arange(len(start)), np.full(len(start), table.start, dtype=np.int64), 0
    state = state.astype(np.int64)
    while len(live):
        symbol = mine[seq[start[live] + t]]
        root, new_root = table.step(root, symbol)
        state, new = table.step(state, symbol)
        more[live] += new.astype(np.int64) - new_root
        t += 1
        over = length[live] == t
        apart = root != state
        end[live[over & apart]] = state[over & apart]
        go = apart & ~over
        live, root, state = live[go], root[go], state[go]
    return more, end


def _gaps_closed(seq: np.ndarray) -> np.ndarray:
    return seq[(seq != 0) | np.diff(seq, prepend=0).astype(bool)]


def training_texts(rows: DataFrame, *, languages: int = 1000, rows_per_language: int = 300, chars: int = 50_000, window: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Per language up to `chars` characters of labelled texts, a line each, in the order of a hash: a row for each language reaches the driver.

    Of a text longer than `window` characters a window of that size is taken. At most `languages` languages, the most frequent ones, are learnt.
    """
    df = columns(rows, text_=(text_col, "string"), lang_=(lang_col, "string")).where("text_ IS NOT NULL AND lang_ IS NOT NULL")
    df = sampled_rows(df, "lang_", rows_per_language, languages).select("lang_", F.struct("order_", window_of(F.col("text_"), F.col("order_"), window).alias("t")).alias("x"))
    # About rows_per_language windows a group: bounded whatever the language's share.
    joined = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n"), 1, chars)
    return {r["lang_"]: r["t"] for r in df.groupBy("lang_").agg(joined.alias("t")).collect()}


def identify(docs: DataFrame, texts: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score, bits_per_char (the winner's cross-entropy). texts: labelled text by language."""
    sent = docs.sparkSession.sparkContext.broadcast(dict(sorted(texts.items())))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for batch in in_slices(whole, 1, 1 << 22):
                if model is None and sent.value:
                    key = hashlib.sha256(repr(sent.value).encode("utf-8", "surrogatepass")).digest()
                    if key not in _built:
                        _built.clear()
                        _built[key] = Automata.build(sent.value)
                    model = _built[key]
                found = [x or "" for x in batch.column(1).to_pylist()]
                lang, score, bits = model.predict(found) if model else ([UNKNOWN] * len(found), np.zeros(len(found)), np.zeros(len(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_char"])

    return columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_char double")
