"""What a worker remembers about the chunks of text it has met."""

from __future__ import annotations

from collections.abc import Callable

MOST_KEYS = 300_000
LONGEST_KEY = 80


class Memo(dict):
    """Results of ``compute`` by chunk, forgotten when there are too many."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        found = self.compute(key)
        if len(key) <= LONGEST_KEY:
            self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > MOST_KEYS:
            self.clear()


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """An object of this worker process that lives as long as it is asked for by the same name.

    Only one object per kind (the part of the name before the colon) is kept.
    """
    if name not in _KEPT:
        kind = name.partition(":")[0]
        for old in [k for k in _KEPT if k.partition(":")[0] == kind]:
            del _KEPT[old]
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Give up what earlier steps kept in this worker process."""
    _KEPT.clear()
