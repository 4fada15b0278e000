"""A bounded memo of a function of strings for a worker's hot loop."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` is ``make(key)``, computed once while the key stays in use.

    Two generations of at most ``entries`` each: when the young one is full it becomes the old one, and what is
    asked for again moves back, so common keys stay while rare ones go. Memory is bounded, results never change.
    """

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
