"""Packing of tokenised documents into sequences by power-of-two decomposition.

Each document's ids (its text's, then an end id) are cut into pieces of max_len and of the powers of two in the binary
form of what is left. A piece is a sequence of its own and belongs to the bucket of its length, so training batches of one
length need no padding and no sequence crosses documents. The work is one pass without a shuffle: sequence ids are handed
out per task, and buckets are a column by which a writer can partition.

Cases: null or empty text has the end id alone; null doc_id and repeated rows are packed as they come; an empty table
gives no rows; very long texts are tokenised whole; texts of one length share a bucket, not a sequence; other columns, whatever their
names, are not looked at; text that holds a special token's string is tokenised as the tokenizer itself would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import columns, frugal, trim

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: The split into pieces that byte-level BPE files with "use_regex" mean (a fixed, published value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Ids in a batch of pieces, about: a batch takes several times its size, in the worker and in the JVM that reads it.
SENT = 1 << 18


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as the tokenizers library gives them; where the file allows, by tiktoken, which is three times as fast.

    The library's own tokenizer takes as much memory again, so it is made only when a text needs it.
    """

    def __init__(self, file: str) -> None:
        self.file, self.fast, self.special = file, None, []
        spec = json.loads(file)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        if model.get("type") == "BPE" and plain and not model.get("ignore_merges") and not model.get("dropout"):
            self.special = [t["content"] for t in spec.get("added_tokens", [])]
            of = _byte_of_char()
            merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
            ids = [model["vocab"].get(m, -1) for m in merges]
            if all(a < b for a, b in zip(ids, ids[1:], strict=False)) and len(set(merges)) == len(merges):
                import tiktoken

                ranks = {bytes(of[c] for c in w): i for w, i in model["vocab"].items() if w not in self.special}
                self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self) -> Tokenizer:
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file)

    def ids(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # its regex engine gives up on some endless runs, with a panic that is no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return self.exact.encode(text, add_special_tokens=False).ids


def cuts(n: int, max_len: int) -> list[int]:
    """Piece lengths of a document of n ids: max_len as often as it fits, then falling powers of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_file: str, *, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length (its bucket), doc_tokens, ids (little-endian uint32), sequence_id, offset.

    tokenizer_file: path of a tokenizers JSON file, read by the driver alone and sent to the executors (a few MB whatever the data).
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    with open(tokenizer_file, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(file.value)
            trim()
            out: list[list] = [[], [], [], [], []]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.array([*(encoder.ids(text) if text else ()), end_id], dtype="<u4")
                at = 0
                for n in cuts(len(ids), max_len):
                    for values, x in zip(out, (doc, at, n, len(ids), ids[at : at + n].tobytes()), strict=True):
                        values.append(x)
                    at += n
                held += at
                if held >= SENT:
                    yield _batch(out)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield _batch(out)

    pieces = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])
