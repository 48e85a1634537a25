import pytest
from pyspark.sql import functions as F

from logsluice.errors import BuildError, CompileError, ConfigError
from logsluice.functions import patterns
from logsluice.operators import sampling
from logsluice.plans import policy as P

RULES = """
sampling:
  default_target: 50
  rules:
    - {match: {namespace: payments}, target: 100}
    - {match: {severity_lte: debug}, target: 10}
    - {match: {namespace: "batch-*"}, target: 25}
"""


def test_defaults_and_sections():
    assert P.from_yaml("{}") == P.Policy() == P.from_yaml("")
    got = P.from_yaml("ingest: {channel_capacity: 5}\nexport: {otlp_endpoint: 'http://x'}\nlimits: {max_body_bytes: 9}")
    assert (got.channel_capacity, got.otlp_endpoint, got.max_body_bytes, got.spool_max_bytes) == (5, "http://x", 9, 512 << 20)


@pytest.mark.parametrize("text", [
    "sampling: {default_targets: 1}", "other: {}", "sampling: {default_target: 150}", "sampling: {default_target: 101}", "sampling: {default_target: -1}", "sampling: {default_target: x}",
    "sampling: {rules: [{match: {}, target: 101}]}", "sampling: {rules: [{match: {}}]}", "sampling: {rules: [{target: 1}]}", "sampling: {rules: [{match: {ns: a}, target: 1}]}",
    "ingest: {channel_capacity: 0}", "limits: {max_body_bytes: 0}", "redaction: {regex_rules: [{name: a, pattern: b, mask: c, fields: []}]}", "redaction: {regex_rules: [{name: a, pattern: b, mask: c, fields: [bodies]}]}",
    "redaction: {regex_rules: [{name: a, pattern: b, mask: c, fields: ['attributes.']}]}", "redaction: {regex_rules: [{name: a, pattern: b, mask: c}]}", "[1]", "a: [",
])
def test_rejected(text):
    with pytest.raises(ConfigError):
        P.from_yaml(text)


def test_load(tmp_path, monkeypatch):
    monkeypatch.setenv(P.ENV, "  ")
    assert P.load() == P.Policy()
    (tmp_path / "p.yaml").write_text(RULES)
    monkeypatch.setenv(P.ENV, str(tmp_path / "p.yaml"))
    assert P.load().default_target == 50
    with pytest.raises(ConfigError):
        P.load(str(tmp_path / "none.yaml"))


def test_fingerprint():
    a, b = P.from_yaml(RULES), P.from_yaml(RULES + "ingest: {channel_capacity: 7}\n")
    c = P.from_yaml(RULES.replace("25", "26"))
    assert a.fingerprint == b.fingerprint != c.fingerprint
    assert P.Policy().fingerprint == P.py_xxh64(b"\x64\x00\xff")


def test_unknown_severity(spark):
    with pytest.raises(BuildError):
        P.compile_policy(P.from_yaml("sampling: {rules: [{match: {severity_lte: LOUD}, target: 1}]}"), spark)
    assert P.severity_max("Warning") == 16


def test_first_match(spark):
    p = P.compile_policy(P.from_yaml(RULES), spark)
    rows = [(0, "payments", 5, 100), (1, "web", 5, 10), (2, "batch-nightly", 9, 25), (3, "web", 9, 50), (4, None, None, 50), (5, "payments", None, 100), (6, None, 8, 10), (7, None, -3, 10), (8, "x*", None, 50)]
    df = spark.createDataFrame(rows, "i int, namespace string, severity_number int, want int")
    got = df.withColumn("target", sampling.target(p, F.col("namespace"), F.col("severity_number")))
    assert [r["target"] for r in got.orderBy("i").collect()] == [r[3] for r in rows]
    table = sampling.target_by_table(df, sampling.rule_table(spark, p), p.default_target, "i")
    assert [r["target"] for r in table.orderBy("i").collect()] == [r[3] for r in rows]


def test_extremes(spark):
    df = spark.range(100).select(F.lit(None).cast("string").alias("namespace"), F.lit(1).alias("severity_number"), F.unhex(F.md5(F.col("id").cast("string"))).alias("trace_id"), F.lit("s").alias("service_name"), F.lit("b").alias("body"))
    for percent, n in ((0, 0), (100, 100)):
        p = P.compile_policy(P.from_yaml(f"sampling: {{default_target: {percent}}}"), spark)
        assert sampling.sample(df, p).where("keep").count() == n


GLOBS = [("*", "any", True), ("*", "", True), ("user.*", "user.email", True), ("user.*", "user", False), ("*.id", "a.id", True), ("a*c", "abc", True), ("a*c", "abd", False), ("a", "a", True), ("a", "A", False), ("a_c", "abc", False), ("50%", "50%", True), ("a\\b", "a\\b", True), ("**", "x", True)]


def test_globs(spark):
    for glob, value, want in GLOBS:
        assert patterns.glob_matches(glob, value) == want
        assert spark.range(1).select(patterns.matches_glob(F.lit(value), glob)).first()[0] == want


ENDLESS, BOUNDED = ["+", "*", "{3,}", "+?", "*?"], ["", "?", "{3}", "{2,7}"]
ITEMS = ["q", "[k-n7]", r"\d", "(?:uv)", "[+*(]", r"\)"]


@pytest.mark.parametrize("item", ITEMS)
def test_lint_goes_by_what_is_endless(item):
    for inner in ENDLESS + BOUNDED:
        for outer in ENDLESS + BOUNDED:
            for depth in (1, 2, 3):
                pattern = "z" + "(" * depth + item + inner + ")" * depth + outer + "z"
                assert (patterns.nested_repetition(pattern) is not None) == (inner in ENDLESS and outer in ENDLESS), pattern


def test_lint_sees_every_place_in_a_group(spark):
    for pattern in ("(w{2}x+y)*", "((?:r+)|s)+", "([0-9]+,?)*", "(?:(p*)q){2,}"):
        assert patterns.nested_repetition(pattern)
        with pytest.raises(CompileError):
            patterns.checked("r", pattern, spark)
    for pattern in ("(w{2}x+y)z*", r"\(r+\)+", "[(s+)*]+", "(t+)u+", r"v\{2,\}+", "{,4}x+"):
        assert patterns.nested_repetition(pattern) is None


def test_literals_that_every_match_holds():
    found = {"k[0-9]+@m": "@m", "(ab)?cd+": "c", "ef{0,2}gh": "gh", "i|j": None, "(?i)kl": None, "mn*op": "op", r"q\.r\d": "q.r", "[st]u": "u", r"\x41bc": None, "v{2,}": "v"}
    for pattern, want in found.items():
        assert patterns.required_literal(pattern) == want, pattern


def test_dialect(spark):
    assert patterns.java_pattern("r", r"(?P<n>a)[[:alpha:][:^digit:]]$\$[$]") == r"(?<n>a)[\p{Alpha}\P{Digit}]\z\$[$]"
    for bad in ("(?=a)b", "(?!a)b", "(?<=a)b", "(?<!a)b", r"(a)\1", r"(?P<x>a)\k<x>", "a*", "x" * 5000, "a{100000}", "(a", "[[:nope:]]"):
        with pytest.raises(CompileError):
            patterns.checked("r", bad, spark)
