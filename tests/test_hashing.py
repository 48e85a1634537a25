import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsluice.functions import hashing

# Golden values, as published with the decision: trace id, hash, bucket.
TRACED = [
    ("00000000000000000000000000000000", "af09f71516247c32", 34),
    ("ffffffffffffffffffffffffffffffff", "a721445d6a57c444", 28),
    ("00000000000000000000000000000001", "f1dd97d1b9d614c7", 75),
    ("856d9c28a9741a0286ad14d4430c32b6", "b9a271e015f851ac", 96),
    ("bf1e5a8e8a5488475d0032063244d097", "bfb9a8b3d35ec12d", 1),
    ("34b45a1b6c93a22d0d44cc2956b5ae29", "40136f48f398d5d9", 21),
]
UNTRACED = [
    ("checkout-service", "user login succeeded", "da3f4f7b3a8cba12", 90),
    ("checkout-service", "", "ed1dff977ec367c7", 35),
    ("", "orphan record with empty service name", "011e6577fc6e6f9d", 81),
    ("payments", "request completed status=200 duration_ms=41", "3c6035de633d2b29", 5),
    ("batch-nightly", "job finished rows=100000", "090cc60e3867da82", 30),
]


def test_golden_vectors(spark):
    rows = spark.createDataFrame([(t,) for t, *_ in TRACED], "t string").select("t", F.lower(F.hex(hashing.xxh64(F.unhex("t")))).alias("h"), hashing.trace_bucket(F.unhex("t")).alias("b"))
    assert {(r["t"], r["h"].rjust(16, "0"), r["b"]) for r in rows.collect()} == set(TRACED)
    rows = spark.createDataFrame([(s, b) for s, b, *_ in UNTRACED], "s string, b string")
    key = hashing.fallback_key(F.col("s"), F.col("b"))
    got = {(r["s"], r["b"], r["h"].rjust(16, "0"), r["k"]) for r in rows.select("s", "b", F.lower(F.hex(key)).alias("h"), hashing.bucket_of(key).alias("k")).collect()}
    assert got == set(UNTRACED)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_python_hash(data):
    assert hashing.py_xxh64(data) == xxhash.xxh64_intdigest(data, seed=0)


def test_column_hash_of_any_length(spark):
    rng = random.Random(1)
    data = [bytes(rng.randrange(256) for _ in range(n)) for n in range(100)]
    rows = spark.createDataFrame([(d,) for d in data], "d binary").select("d", hashing.xxh64(F.col("d")).alias("h")).collect()
    assert all(r["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(bytes(r["d"])) for r in rows)


def test_trace_ids(spark):
    raw = [bytes(range(16)), b"00112233445566778899aabbccddeeff", b"00112233445566778899AABBCCDDEEFF", b"zz112233445566778899aabbccddeeff", b"\x01" * 5, b"", None, b"\xff" * 32]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r binary").select("i", hashing.normal_trace_id(F.col("r")).alias("t")).collect()
    got = {r["i"]: None if r["t"] is None else bytes(r["t"]) for r in rows}
    hexed = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert got == {0: bytes(range(16)), 1: hexed, 2: hexed, 3: None, 4: None, 5: None, 6: None, 7: None}


@pytest.mark.parametrize("percent", [10, 25, 50, 75])
def test_keep_rate(spark, percent):
    got = spark.range(200_000).select(hashing.trace_bucket(F.unhex(F.md5(F.col("id").cast("string")))).alias("b")).agg(F.avg((F.col("b") < percent).cast("int"))).first()[0]
    assert abs(100 * got - percent) < 0.5
