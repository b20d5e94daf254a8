"""Byte-pair segmentation as the shortest path through a lattice of pieces.

Merging the best adjacent pair until none is left gives exactly one segmentation, and it can
be told from all others locally: a sequence of pieces is that segmentation if, for each two
neighbours, no merge across their border would have come before the merges that built them.
So the segmentation is the one path of finite weight through the lattice of pieces in which an
arc costs 0 after a piece it may follow and infinity after any other, and a path is found from
left to right, since every prefix has one last piece.
"""

from __future__ import annotations

from collections.abc import Callable

INFINITE = float("inf")


class MergeLattice:
    """``ids``: piece -> id. ``rank(a, b)``: when the pair merges (lower is sooner) or None.
    ``symbols(text)``: the units that merging starts from; joined, they are the text."""

    def __init__(self, ids: dict[str, int], rank: Callable[[str, str], float | None], symbols: Callable[[str], list[str]] = list):
        self.ids, self.rank, self.symbols = ids, rank, symbols
        self._last: dict[str, tuple[str, str, float] | None] = {}
        self._spines: tuple[dict[str, list], dict[str, list]] = ({}, {})

    def greedy(self, text: str) -> tuple[list[str], tuple[str, str, float] | None]:
        """Merge the soonest pair, the leftmost of equals, until none is left; the last merge."""
        parts, last = self.symbols(text), None
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not found:
                break
            r, i = min(found)
            last = (parts[i], parts[i + 1], r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def last_merge(self, piece: str) -> tuple[str, str, float] | None:
        """How merging ends on ``piece``; None for a unit; ValueError if it never gets there."""
        if piece not in self._last:
            parts, last = self.greedy(piece)
            self._last[piece] = last if len(parts) == 1 else ("", "", INFINITE)
        last = self._last[piece]
        if last and last[2] == INFINITE:
            raise ValueError(piece)
        return last

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The pieces at this end of ``piece`` as it grew, each with the rank of its merge."""
        if piece not in self._spines[side]:
            out, at = [], piece
            while last := self.last_merge(at):
                out.append((at, last[2]))
                at = last[side]
            out.append((at, -INFINITE))
            self._spines[side][piece] = out[::-1]
        return self._spines[side][piece]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the two pieces' text ends in exactly these two."""
        try:
            left, right = self._spine(a, 1), self._spine(b, 0)
        except ValueError:
            return False
        i = j = 0
        while True:
            grow_a = left[i + 1][1] if i + 1 < len(left) else INFINITE
            grow_b = right[j + 1][1] if j + 1 < len(right) else INFINITE
            across = self.rank(left[i][0], right[j][0])
            if across is not None and across < grow_a and across <= grow_b:
                return False
            if grow_a == grow_b == INFINITE:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1
