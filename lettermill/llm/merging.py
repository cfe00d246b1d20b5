"""Merging sorted runs with a tree of losers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class LoserTree:
    """Merges ``k`` sorted runs; each item costs about log2(k) comparisons.

    The inner nodes hold the run that lost the match there, the top the overall winner.  When
    the winner moves on, only the matches on its way up are played again.
    """

    def __init__(self, runs: Sequence[Iterator]):
        self._runs = list(runs)
        self._heads = [next(run, None) for run in self._runs]
        k = len(self._runs)
        self._losers = [-1] * max(k, 1)
        winners = [0] * k + list(range(k))  # leaves at k .. 2k - 1
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self._losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self._winner = winners[1] if k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        left, right = self._heads[a], self._heads[b]
        if left is None or right is None:
            return right is None and (left is not None or a < b)
        return left < right or (left == right and a < b)

    def __iter__(self) -> Iterator[tuple[int, object]]:
        """(run, item) in ascending order; equal items in the order of the runs."""
        if not self._runs:
            return
        k, losers = len(self._runs), self._losers
        while True:
            winner = self._winner
            head = self._heads[winner]
            if head is None:
                return
            yield winner, head
            after = next(self._runs[winner], None)
            if after is not None and after < head:
                raise ValueError(f"run {winner} is not sorted")
            self._heads[winner] = after
            node = (winner + k) // 2
            while node:
                if self._beats(losers[node], winner):
                    losers[node], winner = winner, losers[node]
                node //= 2
            self._winner = winner
