"""What a Python worker remembers between batches."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[Hashable, object] = {}


def release() -> None:
    """Forget what an earlier stage left; for functions that hold nothing themselves."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def held(key: Hashable, make: Callable[[], object]):
    """The object of ``key``, made where the worker has none.

    A worker serves one stage after another. Only the latest operator's object stays, so the words or tokens that an
    earlier stage remembers do not take the memory of the next.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]
