"""Globs, selectors and regular expressions: from a policy's notation to Spark's."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logsluice.errors import CompileError, ConfigError

#: Longest pattern, and largest bounded repetition, that a rule may have.
MAX_PATTERN, MAX_REPEAT = 4096, 1000


def like_pattern(glob: str) -> str:
    """The LIKE form of a glob in which only * is special."""
    return "".join("%" if c == "*" else "\\" + c if c in "\\%_" else c for c in glob)


def matches_glob(col: Column, glob: str) -> Column:
    """Whole, case-sensitive match. (A literal * in the value is matched like any other character.)"""
    return col.like(like_pattern(glob))


def glob_matches(glob: str, value: str) -> bool:
    return re.fullmatch(".*".join(map(re.escape, glob.split("*"))), value, re.DOTALL) is not None


@dataclass(frozen=True)
class Selector:
    """body, or attributes by a glob over their keys."""

    key_glob: str | None

    @classmethod
    def parse(cls, text: str) -> Selector:
        if text == "body":
            return cls(None)
        if text.startswith("attributes.") and len(text) > len("attributes."):
            return cls(text.removeprefix("attributes."))
        raise ConfigError(f"field {text!r} is neither body nor attributes.<glob>")


def applies_to_body(fields: tuple[Selector, ...]) -> bool:
    return any(f.key_glob is None for f in fields)


def applies_to_key(fields: tuple[Selector, ...], key: Column) -> Column | None:
    """Whether any selector takes the attribute; None: none ever does."""
    found = None
    for f in fields:
        if f.key_glob is not None:
            one = F.lit(True) if f.key_glob == "*" else matches_glob(key, f.key_glob)
            found = one if found is None else found | one
    return found


def nested_repetition(pattern: str) -> str | None:
    """Why a pattern may take exponential time: an endless repetition of a group that itself holds one. None if it can't."""
    groups: list[bool] = [False]  # whether an endless repetition was seen, in each group that is open
    last_group = False  # whether the item just read is a group with one inside
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        endless, width = _quantifier(pattern, i)
        if width:
            if endless:
                if last_group:
                    return f"endless repetition within an endless repetition at {i}"
                groups[-1] = True
            i += width
            last_group = False
            continue
        last_group = False
        if c == "\\":
            i += 2
        elif c == "[":
            i = _class_end(pattern, i)
        elif c == "(":
            groups.append(False)
            i += 1
            if i < n and pattern[i] == "?":  # what kind of group this is, is not a quantifier
                i += 1
        elif c == ")" and len(groups) > 1:
            last_group = groups.pop()
            groups[-1] |= last_group
            i += 1
        else:
            i += 1
    return None


def _quantifier(p: str, i: int) -> tuple[bool, int]:
    """(endless, characters) of the quantifier at i; 0 characters if there is none. A malformed brace is literal."""
    if p[i] in "*+?":
        width, endless = 1, p[i] != "?"
    elif m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(p, i):
        width, endless = len(m[0]), bool(m[2]) and not m[3]
    else:
        return False, 0
    if p[i + width : i + width + 1] in ("?", "+"):
        width += 1
    return endless, width


def _class_end(p: str, i: int) -> int:
    """Behind the character class that opens at i."""
    i += 1
    if p[i : i + 1] == "^":
        i += 1
    if p[i : i + 1] == "]":
        i += 1
    while i < len(p) and p[i] != "]":
        if p[i] == "\\":
            i += 1
        elif p.startswith("[:", i) and (end := p.find(":]", i)) > 0:
            i = end + 1
        i += 1
    return i + 1


# POSIX class names and their equivalents.
POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "graph": r"\p{Graph}",
    "print": r"\p{Print}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "space": r"\s", "word": r"\w",
}


def java_pattern(name: str, pattern: str) -> str:
    """The pattern as Java has to be told it, with the dialect of linear-time engines: no look-around, no back-references."""
    if len(pattern) > MAX_PATTERN or any(int(x) > MAX_REPEAT for x in re.findall(r"\{(\d+)", pattern)) or any(int(x) > MAX_REPEAT for x in re.findall(r",(\d+)\}", pattern)):
        raise CompileError(name, "the pattern is too large")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2].isdigit() and pattern[i + 1] != "0" or pattern[i + 1 : i + 2] == "k":
                raise CompileError(name, "back-references are not supported")
            out.append(pattern[i : i + 2])
            i += 2
        elif c == "[":
            end = _class_end(pattern, i)
            out.append(re.sub(r"\[:(\^?)(\w+):\]", lambda m: _posix(name, m), pattern[i:end]))
            i = end
        elif pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
            raise CompileError(name, "look-around is not supported")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif c == "$" and not re.search(r"\(\?[a-z]*m", pattern):
            out.append(r"\z")
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _posix(rule: str, m: re.Match[str]) -> str:
    if m[2] not in POSIX:
        raise CompileError(rule, f"unknown class {m[2]}")
    found = POSIX[m[2]]
    return (found.replace("p", "P", 1) if found.startswith(r"\p") else found.upper()) if m[1] else found


def checked(name: str, pattern: str, spark: SparkSession | None = None) -> str:
    """The Java pattern, once it is known to compile, to be safe from endless backtracking and never to match nothing."""
    if why := nested_repetition(pattern):
        raise CompileError(name, why)
    java = java_pattern(name, pattern)
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise CompileError(name, "a Spark session is needed to check patterns")
    try:
        empty = spark._jvm.java.util.regex.Pattern.compile(java).matcher("").find()
    except Exception as e:
        raise CompileError(name, str(e).splitlines()[0]) from e
    if empty:
        raise CompileError(name, "the pattern matches the empty string")
    return java


def required_literal(java: str) -> str | None:
    """A text that every match holds, the longest that stands outside of groups and classes; None where none is sure."""
    if "(?" in java.replace("(?:", "").replace("(?<", "") or "\\Q" in java:  # flags may change what a letter means
        return None
    runs, run, depth, i, n = [], "", 0, 0, len(java)
    while i < n:
        c, end, literal = java[i], i + 1, None
        if c == "\\":
            end = i + 2
            literal = java[i + 1] if i + 1 < n and not java[i + 1].isalnum() else None
            if java[i + 1 : i + 2] in ("p", "P", "x", "u", "c", "k", "N", "0"):
                return None
        elif c == "[":
            end = _class_end(java, i)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|":
            if depth == 0:
                return None
        elif c not in "^$.*+?{}":
            literal = c
        endless, width = _quantifier(java, end) if end < n and c not in "(|" else (False, 0)
        if depth or literal is None or c in "()":
            runs, run = runs + [run], ""
        elif width:
            # Repeated: once at least it is there, unless it may be left out.
            least = 1 if java[end] == "+" else 0 if java[end] in "*?" else int(java[end + 1 : end + width].split(",")[0].split("}")[0] or 0)
            runs, run = runs + [run + literal if least == 1 and not endless else run, literal if least else ""], ""
        else:
            run += literal
        i = end + width
    return _best(runs + [run])


def _best(runs: list[str]) -> str | None:
    return max(runs, key=len, default="") or None


def replacement(mask: str) -> str:
    """A mask as regexp_replace needs it to be taken literally."""
    return mask.replace("\\", "\\\\").replace("$", "\\$")
