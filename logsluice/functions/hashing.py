"""The sampling hash: xxHash64 with seed 0, as built-in expressions and, for the driver, in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 100
#: Spark's xxhash64 begins with seed 42 and hands each hash on as the next argument's seed; this bigint hashes to 0.
ZERO_SEED = -365884300664092260
_M = (1 << 64) - 1
# The primes of xxHash64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def xxh64(data: Column) -> Column:
    """Signed 64-bit xxHash64 (seed 0) of a binary column. Null hashes to 0: ask for null before."""
    return F.xxhash64(F.lit(ZERO_SEED).cast("long"), data.cast("binary"))


def bucket_of(h: Column) -> Column:
    """0 to 99: the hash as an unsigned number modulo 100."""
    return ((F.shiftrightunsigned(h, 1) % F.lit(50)) * 2 + h.bitwiseAND(F.lit(1).cast("long"))).cast("int")


def trace_bucket(trace_id: Column) -> Column:
    return bucket_of(xxh64(trace_id))


def fallback_key(service: Column, body: Column) -> Column:
    """Hash of service, a zero byte, body; absent and empty are the same."""
    part = lambda c: F.coalesce(c.cast("binary"), F.lit(b""))
    return xxh64(F.concat(part(service), F.lit(b"\x00"), part(body)))


def normal_trace_id(raw: Column) -> Column:
    """16 bytes as they are, 32 as hexadecimal digits of either case, anything else (bad digits too) null."""
    size = F.octet_length(raw)
    return F.when(size == 16, raw.cast("binary")).when(size == 32, F.unhex(F.when(F.decode(raw.cast("binary"), "ISO-8859-1").rlike(r"\A[0-9A-Fa-f]{32}\z"), F.decode(raw.cast("binary"), "ISO-8859-1"))))


def py_xxh64(data: bytes, seed: int = 0) -> int:
    """The same hash, unsigned, for the driver (policy fingerprints)."""

    def turn(x: int, r: int) -> int:
        return (x << r | x >> (64 - r)) & _M

    def lane(a: int, w: int) -> int:
        return turn((a + w * P2) & _M, 31) * P1 & _M

    def word(at: int, n: int) -> int:
        return int.from_bytes(data[at : at + n], "little")

    at, n = 0, len(data)
    if n >= 32:
        lanes = [(seed + P1 + P2) & _M, (seed + P2) & _M, seed, (seed - P1) & _M]
        for at in range(0, n - 31, 32):
            lanes = [lane(v, word(at + 8 * k, 8)) for k, v in enumerate(lanes)]
        at = n // 32 * 32
        h = sum(turn(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True)) & _M
        for v in lanes:
            h = ((h ^ lane(0, v)) * P1 + P4) & _M
    else:
        h = (seed + P5) & _M
    h = (h + n) & _M
    while at + 8 <= n:
        h = (turn(h ^ lane(0, word(at, 8)), 27) * P1 + P4) & _M
        at += 8
    if at + 4 <= n:
        h = (turn(h ^ word(at, 4) * P1 & _M, 23) * P2 + P3) & _M
        at += 4
    for k in range(at, n):
        h = turn(h ^ data[k] * P5 & _M, 11) * P1 & _M
    h = (h ^ h >> 33) * P2 & _M
    h = (h ^ h >> 29) * P3 & _M
    return h ^ h >> 32
