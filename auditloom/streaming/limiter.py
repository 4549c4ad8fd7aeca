"""Token bucket, retries and time limits of model calls, as pure logic on a given clock."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from typing import Any

# Limits of the model steps.
REVIEW_WORKERS, EXTRACTION_WORKERS, INGEST_WORKERS = 8, 40, 4
REQUESTS_PER_MINUTE, TIMEOUT_SECONDS = 600, 300


@dataclass
class TokenBucket:
    """`rate` tokens a second up to `capacity` (at least 1; by default the rate); rate 0 limits nothing.

    A cluster-wide rate is shared out: each task takes rate / parallel tasks.
    """

    rate: float
    capacity: float | None = None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    tokens: float = field(init=False)
    at: float = field(init=False)

    def __post_init__(self) -> None:
        self.capacity = max(1.0, self.rate if self.capacity is None else self.capacity)
        self.tokens, self.at = self.capacity, self.clock()

    def refill(self) -> None:
        now = self.clock()
        self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
        self.at = now

    def acquire(self, n: float = 1.0) -> float:
        """Take n tokens (at most the capacity), waiting as long as needed; gives the time waited."""
        if self.rate <= 0:
            return 0.0
        n, waited = min(n, self.capacity), 0.0
        while True:
            self.refill()
            if self.tokens >= n:
                self.tokens -= n
                return waited
            pause = (n - self.tokens) / self.rate
            self.sleep(pause)
            waited += pause


def shared(rpm: float, parallel: int, **more: Any) -> TokenBucket:
    return TokenBucket(rpm / 60 / max(1, parallel), **more)


def with_retries(call: Callable[[], Any], transient: Callable[[str], bool], attempts: int = 5, base: float = 4.0, most: float = 60.0, jitter: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Call again after a transient error, waiting base, 2 base, 4 base … up to `most`, plus jitter."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not transient(str(e)):
                raise
            sleep(min(most, base * 2**k) + random.uniform(0, jitter))
    raise AssertionError("attempts must be positive")


def with_timeout(call: Callable[[], Any], seconds: float, late: Any) -> Any:
    """The call's result, or `late` when it takes longer; its thread runs on."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(timeout=seconds)
    except Late:
        return late
    finally:
        pool.shutdown(wait=False)
