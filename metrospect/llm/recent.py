"""A memory of a bounded number of bytes for results that recur within a task."""

from __future__ import annotations

from sys import getsizeof


class Recent(dict):
    """What was asked for lately, in two generations: a full one becomes the old one, and what is asked for
    again moves to the new one. Both together hold about `most` bytes, an entry's own and its key's.

    The new generation is the dictionary itself, so that a hit costs one plain lookup.
    """

    #: What a dictionary takes for an entry, about.
    OVERHEAD = 64

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def __missing__(self, key):
        """The entry in the old generation, which it leaves, or None."""
        entry = self.old.pop(key, None)
        if entry is not None:
            self.put(key, entry)
        return entry

    def put(self, key: str, entry: bytes | tuple[bytes, ...]) -> None:
        self.held += getsizeof(key) + getsizeof(entry) + self.OVERHEAD
        if type(entry) is tuple:
            self.held += sum(map(getsizeof, entry))
        if 2 * self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = entry
