"""What Python workers hold: one large object at a time, and nothing that a task has freed.

Spark reuses workers for tasks of any operator.  An encoder that one operator keeps
between its tasks would stay beside the arrays of the next, and allocators keep
memory that is free; an executor's limit counts both.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object that this worker keeps under ``key``; it takes the place of any other."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what is kept."""
    _held.clear()
    trim()


def trim() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU allocator
        pass


def tidy(work: Callable[[Iterable], Iterator], keeps: bool = False) -> Callable[[Iterable], Iterator]:
    """``work`` for ``mapInArrow``, which frees what other operators keep before it, and trims after it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        try:
            yield from work(batches)
        finally:
            trim()

    return run
