"""Redaction: several rules over one text, their overlapping matches resolved by position.

All rules look at the original text. Matches are ordered by start, then end, then rule; one that begins before the last
kept one ended is dropped; the others are replaced by their rule's mask. This differs from replacing rule after rule, so
each rule's matches are gathered once: their number is the count, and only where there are any, and the text is wanted, do
they become spans (in bytes), from which it is put together. A pattern is not run over a text that lacks a literal which
all its matches hold. Folds go by blocks, so their cost is in proportion to the matches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.functions.patterns import applies_to_body, applies_to_key, replacement, required_literal
from logsluice.plans.policy import CompiledPolicy, CompiledRule

SPANS = "array<struct<s:int,e:int,r:int>>"
#: Items that one fold appends to one array.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def walked(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """struct<at, out>: goes through the items with a place in the text; step gives the next place, a value, and whether it counts.

    Appending copies an array, so long lists go block by block.
    """
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def add(a: Column, x: Column) -> Column:
        at, value, counts = step(a["at"], x)
        return F.struct(at.alias("at"), F.when(counts, F.array_append(a["out"], value)).otherwise(a["out"]).alias("out"))

    def fold(some: Column, start: Column) -> Column:
        return F.aggregate(some, F.struct(start.alias("at"), none.alias("out")), add)

    def block(a: Column, i: Column) -> Column:
        return let(fold(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), a["at"]), lambda x: F.struct(x["at"].alias("at"), F.array_append(a["out"], x["out"]).alias("out")))

    long = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), F.struct(F.lit(0).alias("at"), nested.alias("out")), block, lambda a: F.struct(a["at"].alias("at"), F.flatten(a["out"]).alias("out")))
    return F.when(F.size(items) <= BLOCK, fold(items, F.lit(0))).otherwise(long)


def may_match(text: Column, rule: CompiledRule) -> Column | None:
    """Whether the text holds what every match of the rule does: far cheaper than the pattern. None where nothing is known."""
    literal = required_literal(rule.pattern)
    return None if literal is None else F.contains(text, F.lit(literal))


def hits(text: Column, rule: CompiledRule) -> Column:
    """Whether the rule matches."""
    possible = may_match(text, rule)
    return text.rlike(rule.pattern) if possible is None else possible & text.rlike(rule.pattern)


def any_match(text: Column, rules: Sequence[CompiledRule]) -> Column:
    """Whether any rule matches."""
    return reduce(lambda a, b: a | b, [hits(text, r) for r in rules], F.lit(False))


def matches(text: Column, rule: CompiledRule) -> Column:
    """All matches, in order: one pass, and none over a text that can't have any."""
    found, possible = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), may_match(text, rule)
    return found if possible is None else F.when(possible, found).otherwise(F.array().cast("array<string>"))


def rule_spans(text: Column, rule: CompiledRule, found: Column, number: int) -> Column:
    """(start, end, number) of the rule's matches found, in bytes from 0: from the matches and the gaps before them."""
    span = lambda s, m: F.struct(s.alias("s"), (s + F.octet_length(m)).alias("e"), F.lit(number).alias("r"))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        s = at + F.octet_length(x["g"])
        return s + F.octet_length(x["m"]), span(s, x["m"]), F.lit(True)

    many = let(F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("g"), found.alias("m")), lambda p: walked(p, "struct<s:int,e:int,r:int>", step)["out"])
    one = F.array(span(F.octet_length(F.get(F.split(text, rule.pattern, 2), F.lit(0))), F.get(found, F.lit(0))))
    return F.when(F.size(found) == 0, F.array().cast(SPANS)).when(F.size(found) == 1, one).otherwise(many)


def spliced(text: Column, found: Column, masks: Sequence[str]) -> Column:
    """The text with the spans that win replaced by their rules' masks."""
    table = F.array(*map(F.lit, masks))

    def build(raw: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
            wins = x["s"] >= at
            return F.when(wins, x["e"]).otherwise(at), F.concat(F.substring(raw, at + 1, x["s"] - at).cast("string"), F.get(table, x["r"])), wins

        return let(walked(found, "string", step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(raw, a["at"] + 1, F.octet_length(raw)).cast("string")))

    return let(text.cast("binary"), build)


def redacted(text: Column, rules: Sequence[CompiledRule], conditions: Sequence[Column | None] | None = None, wanted: Column | None = None) -> Column:
    """struct<new, n>: the text redacted by all rules (conditions: where each applies), null if nothing changes; the number of all their matches.

    wanted: where the new text is needed; elsewhere matches are only counted.
    """
    nothing = F.struct(F.lit(None).cast("string").alias("new"), F.lit(0).cast("long").alias("n"))
    if not rules:
        return nothing
    conditions = conditions or [None] * len(rules)
    none = F.array().cast("array<string>")
    each = [matches(text, r) if ok is None else F.when(ok, matches(text, r)).otherwise(none) for r, ok in zip(rules, conditions, strict=True)]

    def done(found: Column) -> Column:
        n = reduce(lambda a, b: a + b, [F.size(found[f"m{k}"]) for k in range(len(rules))]).cast("long")
        if len(rules) == 1:
            new = F.regexp_replace(text, rules[0].pattern, replacement(rules[0].mask))
        else:
            spans = F.array_sort(F.concat(*[rule_spans(text, r, found[f"m{k}"], k) for k, r in enumerate(rules)]))
            new = let(spans, lambda x: spliced(text, x, [r.mask for r in rules]))
        return F.struct(F.when(n > 0 if wanted is None else (n > 0) & wanted, new).alias("new"), n.alias("n"))

    return F.when(text.isNull(), nothing).otherwise(let(F.struct(*[x.alias(f"m{k}") for k, x in enumerate(each)]), done))


def redact_text(text: Column, rules: Sequence[CompiledRule], conditions: Sequence[Column | None] | None = None) -> Column:
    """The text redacted by all rules (conditions: where each applies). Null stays null."""
    if not rules:
        return text
    if len(rules) == 1:
        done = F.regexp_replace(text, rules[0].pattern, replacement(rules[0].mask))
        return done if not conditions or conditions[0] is None else F.when(conditions[0], done).otherwise(text)
    return F.coalesce(redacted(text, rules, conditions)["new"], text)


def redacted_bytes(raw: Column, rules: Sequence[CompiledRule], conditions: Sequence[Column | None] | None = None, wanted: Column | None = None) -> Column:
    """struct<new, n> of a binary text: read as UTF-8 where it is that; else byte by byte, so that what no rule matches stays exactly as it was."""

    def as_text(text: Column) -> Column:
        whole = redacted(text, rules, conditions, wanted)
        latin = let(redacted(F.decode(raw, "ISO-8859-1"), rules, conditions, wanted), lambda x: F.struct(F.encode(x["new"], "ISO-8859-1").alias("new"), x["n"].alias("n")))
        utf8 = let(whole, lambda x: F.struct(x["new"].cast("binary").alias("new"), x["n"].alias("n")))
        return F.when(text.isNull() | F.is_valid_utf8(text), utf8).otherwise(latin)

    return let(raw.cast("string"), as_text)


def redact_bytes(raw: Column, rules: Sequence[CompiledRule]) -> Column:
    return F.coalesce(redacted_bytes(raw, rules)["new"], raw)


def body_rules(policy: CompiledPolicy) -> list[CompiledRule]:
    return [r for r in policy.redaction if applies_to_body(r.fields)]


def attribute_rules(policy: CompiledPolicy, key: Column) -> tuple[list[CompiledRule], list[Column]]:
    """The rules that may apply to attributes, and whether each does to this key."""
    found = [(r, ok) for r in policy.redaction if (ok := applies_to_key(r.fields, key)) is not None]
    return [r for r, _ in found], [ok for _, ok in found]


def redacted_attributes(attrs: Column, policy: CompiledPolicy, wanted: Column | None = None, binary: bool = False) -> Column | None:
    """Per attribute struct<key, value, n>, order and repeated keys kept; None where no rule asks for attributes. binary: values are bytes."""
    if not any(f.key_glob is not None for r in policy.redaction for f in r.fields):
        return None

    def one(a: Column) -> Column:
        rules, conditions = attribute_rules(policy, a["key"])
        selected = reduce(lambda x, y: x | y, conditions)
        done = (redacted_bytes if binary else redacted)(a["value"], rules, conditions, wanted)
        new = let(done, lambda x: F.struct(a["key"].alias("key"), F.coalesce(x["new"], a["value"]).alias("value"), x["n"].alias("n")))
        return F.when(selected, new).otherwise(F.struct(a["key"].alias("key"), a["value"].alias("value"), F.lit(0).cast("long").alias("n")))

    return F.transform(attrs, one)


def redact_attributes(attrs: Column, policy: CompiledPolicy) -> Column:
    """Attributes (array of key and value) with the values of selected keys redacted."""
    done = redacted_attributes(attrs, policy)
    return attrs if done is None else F.transform(done, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value")))


def total(done: Column) -> Column:
    """Matches in all attributes."""
    return F.coalesce(F.aggregate(done, F.lit(0).cast("long"), lambda n, a: n + a["n"]), F.lit(0).cast("long"))


def match_count(text: Column, rule: CompiledRule) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(matches(text, rule))).cast("long")


def attribute_count(attrs: Column, rule: CompiledRule) -> Column | None:
    def one(n: Column, a: Column) -> Column:
        return n + F.when(applies_to_key(rule.fields, a["key"]), match_count(a["value"], rule)).otherwise(F.lit(0).cast("long"))

    if all(f.key_glob is None for f in rule.fields):
        return None
    return F.coalesce(F.aggregate(attrs, F.lit(0).cast("long"), one), F.lit(0).cast("long"))


def rule_match_count(df: DataFrame, rule: CompiledRule, attrs: str | None = "attrs") -> Column:
    """Matches of one rule in a record, those that lose to others included."""
    parts = [match_count(F.col("body"), rule)] if applies_to_body(rule.fields) else []
    if attrs and attrs in df.columns and (more := attribute_count(F.col(attrs), rule)) is not None:
        parts.append(more)
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def redact(df: DataFrame, policy: CompiledPolicy, wanted: Column | None = None) -> DataFrame:
    """Logs with body and attrs redacted, and n_redactions: all matches, of dropped records too if they are in df.

    wanted: records whose new text is needed; of the others only matches are counted.
    """
    one = "redacted_"
    parts = [redacted(F.col("body"), body_rules(policy), None, wanted).alias("body")]
    attrs = redacted_attributes(F.col("attrs"), policy, wanted) if "attrs" in df.columns else None
    if attrs is not None:
        parts.append(attrs.alias("attrs"))
    df = df.withColumn(one, F.struct(*parts))
    n, new = F.col(f"{one}.body.n"), {"body": F.coalesce(F.col(f"{one}.body.new"), F.col("body"))}
    if attrs is not None:
        done = F.col(f"{one}.attrs")
        n, new["attrs"] = n + total(done), F.transform(done, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value")))
    return df.withColumns(new | {"n_redactions": n}).drop(one)


def rule_counts(df: DataFrame, policy: CompiledPolicy) -> DataFrame:
    """rule, matches: over all records, by rule in the policy's order. One pass, one row shuffled a task."""
    sums = df.agg(*[F.coalesce(F.sum(rule_match_count(df, r)), F.lit(0)).cast("long").alias(f"c{k}") for k, r in enumerate(policy.redaction)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"c{k}").alias("matches")) for k, r in enumerate(policy.redaction)])
    return sums.select(F.inline(rows))
