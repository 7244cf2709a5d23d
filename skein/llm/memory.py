"""What a Python worker gives back when a task of it ends: workers stay, idle, beside those of later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system, where the C library can; else each worker keeps the most it ever had."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` on a task's batches, trimming once they are done."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim()

    return run
