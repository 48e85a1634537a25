"""Failing open: a step that breaks lets the data through as it came."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")


@dataclass
class Outcome[T]:
    value: T
    bypassed: bool
    why: str | None = None


def guarded(step: Callable[[], T], otherwise: Callable[[], T]) -> Outcome[T]:
    """What the step gives, or, if it raises, what stands in for it."""
    try:
        return Outcome(step(), False)
    except Exception as e:
        return Outcome(otherwise(), True, f"{type(e).__name__}: {e}"[:500])


class Breaker:
    """Opens after `faults` within a window, for a while; then all is forgotten.

    The window begins with the breaker, or with the first fault that comes more than `window` after it began.
    """

    def __init__(self, faults: int = 5, window: float = 10, cooldown: float = 30, clock: Callable[[], float] = time.monotonic) -> None:
        self.limit, self.window, self.cooldown, self.clock = faults, window, cooldown, clock
        self.began, self.count, self.opened = clock(), 0, None

    def allows(self) -> bool:
        if self.opened is None:
            return True
        if self.clock() - self.opened < self.cooldown:
            return False
        self.opened, self.count, self.began = None, 0, self.clock()
        return True

    def fault(self) -> None:
        now = self.clock()
        if now - self.began > self.window:
            self.began, self.count = now, 0
        self.count += 1
        if self.count >= self.limit and self.opened is None:
            self.opened = now
