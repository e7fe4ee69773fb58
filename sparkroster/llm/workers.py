"""What a Python worker keeps from task to task, and how it gives memory back.

Spark uses a worker again for the tasks of later stages, which may belong to other operators. Models and caches are
kept for one operator at a time, and memory that a task has freed goes back to the machine when it ends.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object] = lambda: None) -> object:
    """What `make` gives, made once as long as no other key is asked for; another key's is dropped."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Only one C library has it; others give memory back by themselves.
        return


def thrifty(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over batches that gives its memory back after the last one."""

    @wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return run
