"""A memory of results that is bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice
from sys import getsizeof
from typing import Any

SLOT = 100  # bytes that an entry takes in the table itself, spare room included


def weight(x: Any) -> int:
    """Bytes of a value and of what it holds."""
    own = getsizeof(x)
    return own + sum(map(getsizeof, x)) if isinstance(x, (tuple, list, set, frozenset)) else own


class Memo(dict):
    """Two generations of at most about ``limit`` bytes each: a full young one takes the old one's place, and what is found in the
    old one moves up. So what is asked for often stays. Values are never None."""

    def __init__(self, limit: int = 20 << 20):
        super().__init__()
        self.limit, self.held = limit, 0
        self.old: dict = {}

    def _make_room(self) -> None:
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0

    def find(self, key: Any) -> Any:
        found = self.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.keep(key, found)
        return found

    def keep(self, key: Any, value: Any) -> None:
        self._make_room()
        self.held += getsizeof(key) + weight(value) + SLOT
        self[key] = value

    def find_all(self, keys: Iterable[Any]) -> dict:
        """What is known of each key, None of the others."""
        out = {k: self.get(k) for k in keys}
        if self.old:
            older = {k: v for k, x in out.items() if x is None and (v := self.old.get(k)) is not None}
            self.keep_all(older)
            out |= older
        return out

    def keep_all(self, found: dict) -> None:
        """Several entries, whose values hold nothing but themselves; so few at once that the limit holds."""
        items, step = iter(found.items()), max(1, self.limit >> 12)
        while part := dict(islice(items, step)):
            self._make_room()
            self.held += sum(map(getsizeof, part)) + sum(map(getsizeof, part.values())) + SLOT * len(part)
            self.update(part)
