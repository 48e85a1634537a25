"""Policy documents: reading, validation, defaults, fingerprint, and their compiled form."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from logsluice.errors import BuildError, CompileError, ConfigError
from logsluice.functions.hashing import py_xxh64
from logsluice.functions.patterns import Selector, checked

#: Environment variable that names the policy file; blank or unset: all defaults.
ENV = "LOGSLUICE_CONFIG"
# The largest severity number of each band.
BANDS = {"TRACE": 4, "DEBUG": 8, "INFO": 12, "WARN": 16, "WARNING": 16, "ERROR": 20, "FATAL": 24}


@dataclass(frozen=True)
class SamplingRule:
    target: int
    namespace: str | None = None
    severity_lte: str | None = None


@dataclass(frozen=True)
class RedactionRule:
    name: str
    pattern: str
    mask: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Policy:
    grpc_endpoint: str = "0.0.0.0:4317"
    http_endpoint: str = "0.0.0.0:4318"
    channel_capacity: int = 8192
    default_target: int = 100
    sampling_rules: tuple[SamplingRule, ...] = ()
    redaction_rules: tuple[RedactionRule, ...] = ()
    otlp_endpoint: str | None = None
    spool_dir: str = "/var/lib/logsluice/spool"
    spool_max_bytes: int = 512 << 20
    max_body_bytes: int = 4 << 20

    @property
    def fingerprint(self) -> int:
        """Unsigned 64-bit number that changes with what is decided (sampling and redaction), in order, and nothing else."""
        z = b"\x00"
        out = [self.default_target.to_bytes(2, "little")]
        for r in self.sampling_rules:
            out += [(r.namespace or "").encode(), z, (r.severity_lte or "").encode(), z, r.target.to_bytes(2, "little")]
        out.append(b"\xff")
        for r in self.redaction_rules:
            out += [r.name.encode(), z, r.pattern.encode(), z, r.mask.encode(), z, *[x for f in r.fields for x in (f.encode(), z)], b"\xfe"]
        return py_xxh64(b"".join(out))


@dataclass(frozen=True)
class CompiledRule:
    name: str
    pattern: str  # in Java's dialect
    mask: str
    fields: tuple[Selector, ...]


@dataclass(frozen=True)
class CompiledPolicy:
    """What expressions are built from: severities as numbers, patterns checked."""

    default_target: int
    sampling: tuple[tuple[str | None, int | None, int], ...]  # namespace glob, largest severity, target
    redaction: tuple[CompiledRule, ...]
    fingerprint: int
    masks: tuple[str, ...] = field(default=())

    @property
    def rule_names(self) -> tuple[str, ...]:
        return tuple(r.name for r in self.redaction)


def severity_max(name: str) -> int:
    try:
        return BANDS[name.upper()]
    except KeyError:
        raise BuildError(f"unknown severity {name!r}") from None


def compile_policy(policy: Policy, spark: SparkSession | None = None) -> CompiledPolicy:
    sampling = tuple((r.namespace, None if r.severity_lte is None else severity_max(r.severity_lte), r.target) for r in policy.sampling_rules)
    redaction = []
    for r in policy.redaction_rules:
        if not r.fields:
            raise CompileError(r.name, "no fields")
        redaction.append(CompiledRule(r.name, checked(r.name, r.pattern, spark), r.mask, tuple(map(Selector.parse, r.fields))))
    return CompiledPolicy(policy.default_target, sampling, tuple(redaction), policy.fingerprint, tuple(dict.fromkeys(r.mask for r in policy.redaction_rules)))


def _section(doc: Any, where: str, allowed: set[str], required: set[str] = frozenset()) -> dict[str, Any]:
    doc = {} if doc is None else doc
    if not isinstance(doc, dict):
        raise ConfigError(f"{where} is not a mapping")
    if extra := set(doc) - allowed:
        raise ConfigError(f"unknown key in {where}: {', '.join(sorted(map(str, extra)))}")
    if missing := required - set(doc):
        raise ConfigError(f"{where} lacks {', '.join(sorted(missing))}")
    return doc


def _list(doc: Any, where: str) -> list[Any]:
    if doc is None:
        return []
    if not isinstance(doc, list):
        raise ConfigError(f"{where} is not a list")
    return doc


def _text(x: Any, where: str, optional: bool = False) -> str | None:
    if x is None and optional or isinstance(x, str):
        return x
    raise ConfigError(f"{where} is not a string")


def _number(x: Any, where: str, least: int, most: int | None = None) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least or most is not None and x > most:
        raise ConfigError(f"{where} is {x!r}, not a whole number from {least}" + (f" to {most}" if most is not None else ""))
    return x


def from_dict(doc: Any) -> Policy:
    top = _section(doc, "the document", {"ingest", "sampling", "redaction", "export", "limits"})
    ingest = _section(top.get("ingest"), "ingest", {"grpc_endpoint", "http_endpoint", "channel_capacity"})
    sampling = _section(top.get("sampling"), "sampling", {"default_target", "rules"})
    redaction = _section(top.get("redaction"), "redaction", {"regex_rules"})
    export = _section(top.get("export"), "export", {"otlp_endpoint", "spool_dir", "spool_max_bytes"})
    limits = _section(top.get("limits"), "limits", {"max_body_bytes"})
    rules = []
    for k, r in enumerate(_list(sampling.get("rules"), "sampling.rules")):
        r = _section(r, f"sampling.rules[{k}]", {"match", "target"}, {"match", "target"})
        match = _section(r["match"], f"sampling.rules[{k}].match", {"namespace", "severity_lte"})
        rules.append(SamplingRule(_number(r["target"], f"sampling.rules[{k}].target", 0, 100), _text(match.get("namespace"), "namespace", True), _text(match.get("severity_lte"), "severity_lte", True)))
    masks = []
    for k, r in enumerate(_list(redaction.get("regex_rules"), "redaction.regex_rules")):
        where = f"redaction.regex_rules[{k}]"
        r = _section(r, where, {"name", "pattern", "mask", "fields"}, {"name", "pattern", "mask", "fields"})
        fields = tuple(_text(f, f"{where}.fields") for f in _list(r["fields"], f"{where}.fields"))
        if not fields:
            raise ConfigError(f"{where}.fields is empty")
        for f in fields:
            Selector.parse(f)
        masks.append(RedactionRule(_text(r["name"], f"{where}.name"), _text(r["pattern"], f"{where}.pattern"), _text(r["mask"], f"{where}.mask"), fields))
    base = Policy()
    return Policy(
        grpc_endpoint=_text(ingest.get("grpc_endpoint", base.grpc_endpoint), "ingest.grpc_endpoint"),
        http_endpoint=_text(ingest.get("http_endpoint", base.http_endpoint), "ingest.http_endpoint"),
        channel_capacity=_number(ingest.get("channel_capacity", base.channel_capacity), "ingest.channel_capacity", 1),
        default_target=_number(sampling.get("default_target", base.default_target), "sampling.default_target", 0, 100),
        sampling_rules=tuple(rules),
        redaction_rules=tuple(masks),
        otlp_endpoint=_text(export.get("otlp_endpoint"), "export.otlp_endpoint", True),
        spool_dir=_text(export.get("spool_dir", base.spool_dir), "export.spool_dir"),
        spool_max_bytes=_number(export.get("spool_max_bytes", base.spool_max_bytes), "export.spool_max_bytes", 0),
        max_body_bytes=_number(limits.get("max_body_bytes", base.max_body_bytes), "limits.max_body_bytes", 1),
    )


def from_yaml(text: str) -> Policy:
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e
    return from_dict(doc)


def load(path: str | None = None) -> Policy:
    """The policy in a file, or in the one that the environment names; all defaults where it names none."""
    path = path or os.environ.get(ENV, "").strip()
    if not path:
        return Policy()
    try:
        with open(path, encoding="utf-8") as f:
            return from_yaml(f.read())
    except OSError as e:
        raise ConfigError(str(e)) from e
