"""A bounded memory of results by key, for work that meets the same words again and again."""

from __future__ import annotations

from collections.abc import Iterable
from sys import getsizeof

#: Bytes of an entry besides its key and value.
ENTRY = 110


class Recent(dict):
    """Keys found lately, of about ``limit`` bytes with their values. When half of that is held, what was there goes to the older
    half, which the next such turn lets go; a key that is met again stays."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older, self.held = limit, {}, 0

    def remember(self, found: Iterable[tuple]) -> None:
        for key, value in found:
            self[key] = value
            self.held += getsizeof(key) + getsizeof(value) + ENTRY

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are not held; the others are ready to be looked up until the next call."""
        if self.held > self.limit // 2:
            # what alone is larger than the limit is not worth its room
            self.older = dict(self) if self.held <= self.limit else {}
            self.clear()
            self.held = 0
        unknown = {k for k in keys if k not in self}
        if self.older and unknown:
            older = self.older
            again = {k for k in unknown if k in older}
            self.remember((k, older[k]) for k in again)
            unknown -= again
        return unknown

    def __reduce__(self):
        return Recent, (self.limit,)
