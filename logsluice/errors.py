"""Errors of the engine, by the step that raises them."""

from __future__ import annotations


class GovernanceError(Exception):
    """Any error of this package."""


class ConfigError(GovernanceError):
    """A policy document that can't be read or breaks its schema or ranges."""


class BuildError(GovernanceError):
    """A valid document that can't be compiled (an unknown severity)."""


class CompileError(BuildError):
    """A redaction rule that can't be compiled; names the rule."""

    def __init__(self, rule: str, why: str) -> None:
        super().__init__(f"redaction rule {rule!r}: {why}")
        self.rule = rule


class ParseError(GovernanceError):
    """A payload that is not a well-formed request; at is the byte where reading stopped."""

    def __init__(self, why: str, at: int) -> None:
        super().__init__(f"{why} at byte {at}")
        self.at = at


class AssembleError(GovernanceError):
    """A payload that was read but can't be written back."""


class ForwardError(GovernanceError):
    """A destination that can't be reached or answers other than 2xx."""


class SpoolError(GovernanceError):
    """A spool that is full or unreadable."""


class SinkError(GovernanceError):
    """An aggregate that could not be delivered."""
