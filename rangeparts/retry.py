"""Retry of catalog actions."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def with_retry(attempts: int, action: Callable[[], T], sleep: Callable[[float], None] = time.sleep) -> T:
    """Result of the first call that does not raise; after the k-th that does, waits k seconds, after the last as well."""
    failure: Exception | None = None
    for k in range(1, attempts + 1):
        try:
            return action()
        except Exception as e:  # whatever the catalog raises
            failure = e
            sleep(k)
    assert failure is not None, "at least one attempt"
    raise failure
