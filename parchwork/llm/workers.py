"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict = {}


def _give_back() -> None:
    """Return memory that is free but kept, by Arrow's pool and the C library, to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def shared(key: tuple, make: Callable):
    """What ``make`` made for ``key`` in this worker; whatever was kept for another key goes.

    Workers are reused by all operators of a session, so only the one at work
    may hold a cache. Asked for once a task.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    _give_back()
    return _held[key]
