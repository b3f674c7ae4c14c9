"""Retries and a circuit breaker for calls to models and stores, made from the driver."""

from __future__ import annotations

import time
from collections.abc import Callable


class CircuitOpen(RuntimeError):
    """Too many failures in a row; calls are refused for a while."""


class Guarded:
    """Calls with retries: the delay doubles up to 30 seconds; after 5 failures in a row nothing is called for 60 seconds."""

    def __init__(self, call: Callable, attempts: int = 3, delay: float = 1.0, most_delay: float = 30.0, failures: int = 5, rest: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.call, self.attempts, self.delay, self.most_delay, self.limit, self.rest, self.clock, self.sleep = call, attempts, delay, most_delay, failures, rest, clock, sleep
        self.failed, self.since = 0, 0.0
        self.calls = self.errors = 0

    def __call__(self, *args, **kwargs):
        if self.failed >= self.limit and self.clock() - self.since < self.rest:
            raise CircuitOpen(f"{self.failed} failures in a row")
        wait = self.delay
        for attempt in range(self.attempts):
            self.calls += 1
            try:
                out = self.call(*args, **kwargs)
            except Exception:
                self.errors += 1
                self.failed += 1
                self.since = self.clock()
                if attempt + 1 == self.attempts or self.failed >= self.limit:
                    raise
                self.sleep(wait)
                wait = min(wait * 2, self.most_delay)
            else:
                self.failed = 0
                return out

    @property
    def error_rate(self) -> float:
        return self.errors / self.calls if self.calls else 0.0
