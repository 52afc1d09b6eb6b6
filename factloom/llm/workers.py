"""What a Python worker keeps from one task to the next.

Spark reuses workers for all stages of an application, so a worker holds the state of one operator only: asking for
another's drops it, and stages that keep nothing of their own drop it when they start.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import pyarrow as pa

_state: dict = {}


def kept(key: Hashable, make: Callable[[], object]):
    """The state under ``key``, made where this worker lacks it; any other state is dropped."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def forget() -> None:
    """Drop what a task of an earlier stage has left."""
    _state.clear()


def give_back() -> None:
    """Return freed memory to the system: an idle worker counts with all that its allocators hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that keeps nothing: what earlier stages left goes when it starts, what it used itself when it ends."""
    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        forget()
        yield from run(batches)
        give_back()

    return task
