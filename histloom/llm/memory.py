"""Memory of Python workers, which outlive their tasks and are shared by all later ones."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not this C library
        return lambda _: 0


def give_back() -> None:
    """Return freed memory of this process to the system, at the end of a task that used much."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
