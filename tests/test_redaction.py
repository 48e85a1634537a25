import random
import re

from pyspark.sql import functions as F

from logsluice.operators import redaction as R
from logsluice.plans.policy import compile_policy, from_yaml

PEOPLE = r"""
redaction:
  regex_rules:
    - {name: badge, pattern: 'B-[0-9]{4}', mask: "<badge>", fields: [body, "attributes.who.*"]}
    - {name: desk, pattern: 'desk [0-9]+(?:/[0-9]+)?', mask: "desk $1", fields: [body]}
"""


def reference(text, rules):
    found = sorted((m.start(), m.end(), k) for k, (p, _) in enumerate(rules) for m in re.finditer(p, text, re.ASCII))
    out, at = [], 0
    for s, e, k in found:
        if s >= at:
            out += [text[at:s], rules[k][1]]
            at = e
    return "".join(out) + text[at:]


def test_overlaps_like_the_plain_rule(spark):
    rules = [("ab+", "<1>"), ("b+c", "<2>"), ("[abc]{3}", "<$3>"), ("a", "<4\\>"), ("c[0-9]", "")]
    yaml = "redaction:\n  regex_rules:\n" + "".join(f"    - {{name: r{k}, pattern: '{p}', mask: '{m}', fields: [body]}}\n" for k, (p, m) in enumerate(rules))
    policy = compile_policy(from_yaml(yaml), spark)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc1é ") for _ in range(rng.randrange(0, 25))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    got = df.select("i", R.redact_text(F.col("body"), policy.redaction).alias("t"), R.match_count(F.col("body"), policy.redaction[0]).alias("n")).orderBy("i").collect()
    assert [r["t"] for r in got] == [reference(t, rules) for t in texts]
    assert [r["n"] for r in got] == [len(re.findall("ab+", t)) for t in texts]


def test_single_rule_and_null(spark):
    policy = compile_policy(from_yaml(PEOPLE), spark)
    df = spark.createDataFrame([("lent to B-1234, back tomorrow",), (None,), ("",)], "body string")
    for rules in (policy.redaction[:1], policy.redaction):
        got = [r[0] for r in df.select(R.redact_text(F.col("body"), rules)).collect()]
        assert got == ["lent to <badge>, back tomorrow", None, ""]


def test_selected_fields_and_counts(spark):
    policy = compile_policy(from_yaml(PEOPLE), spark)
    attrs = [("who.lent", "B-7001"), ("remark", "ask B-7002"), ("who.lent", "B-7003 at desk 4"), ("who.else", None)]
    df = spark.createDataFrame([("B-7001 waits at desk 12/3", attrs)], "body string, attrs array<struct<key:string,value:string>>")
    row = R.redact(df, policy).first()
    assert row["body"] == "<badge> waits at desk $1"
    assert [(a["key"], a["value"]) for a in row["attrs"]] == [("who.lent", "<badge>"), ("remark", "ask B-7002"), ("who.lent", "<badge> at desk 4"), ("who.else", None)]
    assert row["n_redactions"] == 4
    assert {r["rule"]: r["matches"] for r in R.rule_counts(df, policy).collect()} == {"badge": 3, "desk": 1}
    unwanted = R.redact(df, policy, wanted=F.lit(False)).first()
    assert unwanted["body"].startswith("B-7001") and unwanted["attrs"][0]["value"] == "B-7001" and unwanted["n_redactions"] == 4


def test_bytes_that_are_not_utf8_stay(spark):
    policy = compile_policy(from_yaml(PEOPLE), spark)
    df = spark.createDataFrame([(b"\xc3\x28 B-0420 \xfe\xed",), ("Ünal B-0421".encode(),), (b"",), (None,)], "b binary")
    got = [None if r[0] is None else bytes(r[0]) for r in df.select(R.redact_bytes(F.col("b"), policy.redaction)).collect()]
    assert got == [b"\xc3\x28 <badge> \xfe\xed", "Ünal <badge>".encode(), b"", None]


def test_thousands_of_matches_in_one_text(spark):
    policy = compile_policy(from_yaml(PEOPLE), spark)
    for n in (127, 128, 129, 256, 257, 5000):
        text = "é ".join(f"B-{k % 10000:04d} desk {k}" for k in range(n))
        row = spark.createDataFrame([(text,)], "body string").select(R.redacted(F.col("body"), policy.redaction).alias("x")).first()["x"]
        assert row["n"] == 2 * n and row["new"] == "é ".join(["<badge> desk $1"] * n)


def test_plans_stay_in_the_engine(spark, sf_small):
    from logsluice.queries import QUERIES

    for name in ("govern_logs", "request_stats", "redact_multi_documents", "sample_keep_traced"):
        plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
    plan = QUERIES["govern_logs"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the spreading of a small file, if any
