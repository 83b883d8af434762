"""Memory that Python workers keep from task to task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_CLEARING: list[Callable[[], None]] = []
_LAST: list[str] = [""]


def forgets(clear: Callable[[], None]) -> None:
    """Register what empties a cache that lives as long as the worker."""
    _CLEARING.append(clear)


def enter(operator: str) -> None:
    """Called when a task of an operator begins in this worker.

    A worker outlives its tasks. What another operator remembered is dropped,
    and memory that earlier tasks have freed goes back to the system, so that
    the stages of a pipeline do not add up.
    """
    if _LAST[0] != operator:
        for clear in _CLEARING:
            clear()
        _LAST[0] = operator
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, without that call
