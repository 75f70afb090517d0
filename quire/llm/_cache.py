"""A bounded memory of computed values."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` computes a missing value with ``make``. At ``most`` entries, or at ``BYTES`` of
    keys and values, the present ones become the old generation, from which used entries come
    back; what the generation before held is forgotten. So at most twice that is held. A key
    is text or bytes, and a value at most four bytes for each unit of it."""

    BYTES = 64 << 20

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old, self.held = make, most, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        self.put(key, self.make(key) if value is None else value)
        return self[key]

    def put(self, key, value) -> None:
        self._age()
        self.held += 5 * len(key) + 150
        self[key] = value

    def fill(self, keys, make_all: Callable) -> None:
        """Hold all of ``keys``, a chunk's, until the next call: none of them ages before. Missing
        values come from one call of ``make_all`` with a list. What is held can exceed the bounds
        by a chunk."""
        self._age()
        absent = [k for k in keys if k not in self]
        new = [k for k in absent if k not in self.old]
        self.update((k, self.old[k]) for k in absent if k in self.old)
        self.update(zip(new, make_all(new)))
        self.held += 5 * sum(map(len, absent)) + 150 * len(absent)

    def _age(self) -> None:
        if len(self) >= self.most or self.held > self.BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
