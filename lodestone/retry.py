"""Retries with growing, jittered delays, for calls that leave the cluster."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable


def delay(attempt: int, base: float = 1.0, factor: float = 2.0, most: float = 30.0, jitter: float = 0.3) -> float:
    """Seconds to wait after failed attempt number `attempt`, from 1."""
    return max(0.0, min(base * factor ** (attempt - 1), most) * (1 + random.uniform(-jitter, jitter)))


def retry_with_backoff(max_retries: int = 3, base_delay: float = 1.0, backoff_factor: float = 2.0, max_delay: float = 30.0, jitter: float = 0.3, exceptions: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """Decorator: up to max_retries further attempts; the last failure is raised."""

    def wrap(call):
        @functools.wraps(call)
        def run(*args, **kwargs):
            for attempt in range(1, max_retries + 1):
                try:
                    return call(*args, **kwargs)
                except exceptions:
                    sleep(delay(attempt, base_delay, backoff_factor, max_delay, jitter))
            return call(*args, **kwargs)

        return run

    return wrap
