"""A bounded memory of what was computed per word, kept by a Python worker across tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordCache:
    """Maps words to values; ``fill`` computes the values of many new words at once.

    Two generations of at most ``limit`` words each bound the memory (about 200 bytes a word).
    A word that is found only in the older generation moves to the newer one, so frequent
    words stay.  Words over ``longest`` bytes are computed each time and never kept.
    """

    def __init__(self, fill: Callable[[list], list], limit: int = 300_000, longest: int = 200):
        self._fill, self._limit, self._longest = fill, limit, longest
        self._new: dict = {}
        self._old: dict = {}

    def lookup(self, words: Iterable) -> dict:
        """A mapping that holds at least ``words``."""
        wanted = set(words)
        if len(self._new) + len(wanted) > self._limit:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        missing = []
        for word in wanted.difference(new):
            value = old.get(word)
            if value is None:
                missing.append(word)
            else:
                new[word] = value
        if not missing:
            return new
        values = self._fill(missing)
        if all(len(w) <= self._longest for w in missing):
            new.update(zip(missing, values))
            return new
        once = dict(zip(missing, values))
        new.update((w, v) for w, v in once.items() if len(w) <= self._longest)
        return {w: once[w] if w in once else new[w] for w in wanted}
