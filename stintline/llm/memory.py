"""What Python workers give back to the system.

Spark keeps its Python workers from one task and one stage to the next, and what numpy and Arrow have freed stays with them:
an executor would pay in every stage for the largest batch of all stages before.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not the GNU C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system. Never changes a result."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives its memory back when it ends, also by a failure."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
