"""Hands memory that Python workers no longer use back to the system, so that idle workers stay small."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys

import pyarrow as pa

_LIBC = ctypes.CDLL(None) if sys.platform.startswith("linux") else None


def give_back() -> None:
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def released(function):
    """A generator function that hands memory back at its end."""

    @functools.wraps(function)
    def run(*args, **named):
        try:
            yield from function(*args, **named)
        finally:
            give_back()

    return run
