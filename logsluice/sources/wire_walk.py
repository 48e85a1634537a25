"""Many protobuf messages read at once: a step reads one field of each, by numpy.

Messages are ranges of one buffer. What a loop over fields would do message by message is done here field by field, so the
number of steps is that of the fields in the longest message; once few messages are left, these are read one at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VARINT, FIXED64, LEN, FIXED32 = 0, 1, 2, 5
#: Messages left, below which the rest is read one at a time.
FEW = 16


@dataclass
class Fields:
    """Fields of messages, those of a message together and in order. lo, hi: payload of a field with a length; value: of a varint."""

    of: np.ndarray
    number: np.ndarray
    wire: np.ndarray
    start: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    value: np.ndarray
    #: By message, whether reading failed (the fields before that are there).
    bad: np.ndarray

    def where(self, mask: np.ndarray) -> Fields:
        return Fields(*(getattr(self, c)[mask] for c in ("of", "number", "wire", "start", "lo", "hi", "value")), self.bad)

    def messages(self, number: int) -> Fields:
        """Those with this number and a length."""
        return self.where((self.number == number) & (self.wire == LEN))


def varints(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, place behind it, whether it is whole) of the numbers at these places."""
    last = len(buf) - 1
    ok = at < end
    b = buf[np.minimum(at, last)]
    value, at = (b & 127).astype(np.uint64), at + 1
    more = np.flatnonzero(ok & (b > 127))
    shift = 7
    while len(more):
        there = (at[more] < end[more]) & (shift < 64)
        ok[more[~there]] = False
        more = more[there]
        b = buf[np.minimum(at[more], last)]
        value[more] |= (b & 127).astype(np.uint64) << np.uint64(shift)
        at[more] += 1
        more, shift = more[b > 127], shift + 7
    return value, at, ok


def walk(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Fields:
    """All fields of the messages buf[lo:hi]."""
    at, bad = lo.astype(np.int64), np.zeros(len(lo), dtype=bool)
    hi = hi.astype(np.int64)
    rows: list[tuple[np.ndarray, ...]] = []
    live = np.flatnonzero(at < hi)
    while len(live) > FEW:
        start, end = at[live], hi[live]
        tag, place, ok = varints(buf, start, end)
        number, wire = (tag >> np.uint64(3)).astype(np.int64) & 0xFFFFFFFF, (tag & np.uint64(7)).astype(np.int64)
        value, begin = np.zeros(len(live), dtype=np.uint64), place.copy()
        sized = np.flatnonzero(ok & ((wire == LEN) | (wire == VARINT)))
        value[sized], begin[sized], whole = varints(buf, place[sized], end[sized])
        ok[sized] &= whole
        is_len = wire == LEN
        ok &= ~is_len | (value <= np.maximum(end - begin, 0).astype(np.uint64))
        size = np.where(is_len & ok, value, 0).astype(np.int64)
        size += np.where(wire == FIXED64, 8, 0) + np.where(wire == FIXED32, 4, 0)
        stop = begin + size
        ok &= is_len | (wire == VARINT) | (((wire == FIXED64) | (wire == FIXED32)) & (stop <= end))
        good = np.flatnonzero(ok)
        rows.append((live[good], number[good], wire[good], start[good], begin[good], stop[good], value[good]))
        bad[live[~ok]] = True
        at[live] = np.where(ok, stop, end)
        live = live[ok & (stop < end)]
    if len(live):
        rows.append(_one_by_one(buf, live, at, hi, bad))
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return Fields(none, none, none, none, none, none, none.astype(np.uint64), bad)
    of, number, wire, start, begin, stop, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((start, of))
    return Fields(of[order], number[order], wire[order], start[order], begin[order], stop[order], value[order], bad)


def _one_by_one(buf: np.ndarray, live: np.ndarray, at: np.ndarray, hi: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, ...]:
    out: list[tuple[int, int, int, int, int, int, int]] = []
    for m in live.tolist():
        base, end = int(at[m]), int(hi[m])
        data, place, n = buf[base:end].tobytes(), 0, end - base

        def number() -> int:
            nonlocal place
            value = shift = 0
            while place < n and shift < 64:
                b = data[place]
                place += 1
                value |= (b & 127) << shift
                if b < 128:
                    return value & (1 << 64) - 1
                shift += 7
            return -1

        while place < n:
            start = place
            tag = number()
            wire, value = tag & 7, 0
            if tag >= 0 and wire in (VARINT, LEN):
                value = number()
            begin = place
            size = value if wire == LEN else 8 if wire == FIXED64 else 4 if wire == FIXED32 else 0
            if tag < 0 or value < 0 or wire not in (VARINT, LEN, FIXED64, FIXED32) or size > n - place:
                bad[m] = True
                break
            place += size
            out.append((m, tag >> 3 & 0xFFFFFFFF, wire, base + start, base + begin, base + place, value))
    columns = list(zip(*out, strict=True)) or [()] * 7
    return (*(np.array(c, dtype=np.int64) for c in columns[:6]), np.array(columns[6], dtype=np.uint64))


def last_of(of: np.ndarray, n: int) -> np.ndarray:
    """By owner, the index of its last entry, or -1; entries of an owner are in order."""
    out = np.full(n, -1, dtype=np.int64)
    out[of] = np.arange(len(of))
    return out


def first_of(of: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -1, dtype=np.int64)
    out[of[::-1]] = np.arange(len(of))[::-1]
    return out


def header(number: int, size: int) -> bytes:
    """Tag and length of a field with a length."""
    return varint(number << 3 | LEN) + varint(size)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def varint_sizes(n: np.ndarray) -> np.ndarray:
    """Bytes of numbers (not negative) in base 128."""
    out = np.ones(len(n), dtype=np.int64)
    for bits in range(7, 63, 7):
        out += n >= 1 << bits
    return out
