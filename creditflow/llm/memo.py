"""A bounded memory of pieces of text that a Python worker has already worked out."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable


class Memo:
    """key -> value of ``compute``, for at most about ``2 * size`` keys: what was used lately survives a clean-out.

    Keys of more than ``longest`` characters are worked out each time.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], size: int = 250_000, longest: int = 64):
        self.compute, self.size, self.longest = compute, size, longest
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: list[str]) -> list:
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        found = self._found({k for k, v in zip(keys, out, strict=True) if v is None})
        return [found[k] if v is None else v for k, v in zip(keys, out, strict=True)]

    def _found(self, keys: set[str]) -> dict:
        old = self.old
        found = {k: old[k] for k in keys if k in old}
        if unseen := [k for k in keys if k not in found]:
            found.update(zip(unseen, self.compute(unseen), strict=True))
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        return found


_resident: dict[str, object] = {}


def forget() -> None:
    """Drop what is resident and hand its pages back; for operators that need no models, as workers outlive a query."""
    _resident.clear()
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def resident(key: str, make: Callable[[], object]):
    """What ``make`` gives, kept for the worker's next batches and tasks until another operator needs the room.

    Workers outlive a query; one operator's models and memories at a time stay in them.
    """
    if key not in _resident:
        forget()
        _resident[key] = make()
    return _resident[key]
