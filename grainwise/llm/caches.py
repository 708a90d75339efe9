"""What a Python worker remembers between tasks: values of pure functions, in bounded memory."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None]) -> None:
    """Note that this worker keeps memory for ``owner``, and how to give it back."""
    _held[owner] = release


def claim(owner: str) -> None:
    """Called when a task of ``owner`` starts: what other operators' tasks left in this worker goes."""
    others = [n for n in _held if n != owner]
    for name in others:
        _held.pop(name)()
    if others:
        give_back()


def give_back() -> None:
    """Return what this worker has freed to the system: its allocators would keep it for themselves."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a system without glibc
        ctypes.CDLL(None).malloc_trim(0)


class Generations:
    """A map of bounded size: when the young generation is full it becomes the old one, and the former old one goes."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
