"""Blockwise suffix sorting with a difference cover, for strings of bounded length.

A difference cover D of period v has, for any two positions i and j, a shift under v that takes both into the
sample {p : p mod v in D}. The sample's suffixes are ranked once. After that any set of suffixes can be
sorted by itself: by its first v bytes and, where those tie, by the ranks at the shift, however long
the tie goes on. Only the text, its sample ranks and one block of suffixes are held.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np

PERIOD = 32


def cover(period: int) -> np.ndarray:
    """A difference cover: with r = ceil(sqrt(period)), {0..r-1} and the multiples of r; d = r*ceil(d/r) - b for some b < r."""
    r = int(np.ceil(np.sqrt(period)))
    return np.array(sorted({*range(min(r, period)), *range(0, period, r)}))


def shifts(period: int) -> np.ndarray:
    """The least shift that takes residues i and j both into the cover."""
    inside = np.zeros(period, bool)
    inside[cover(period)] = True
    out = np.zeros((period, period), np.int64)
    for i in range(period):
        for j in range(period):
            out[i, j] = next(s for s in range(period) if inside[(i + s) % period] and inside[(j + s) % period])
    return out


_SHIFTS = shifts(PERIOD)
_COVER = cover(PERIOD)


def words(text: np.ndarray) -> np.ndarray:
    """At each position the next 8 bytes as a big-endian number, zeros after the end: numbers order as the bytes do."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place, where its run begins; new marks the first of each run."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def tell_apart(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks (how many come before) of members that tie are raised in place by key; those that still tie are returned."""
    if not len(some):
        return some
    r = rank[some]
    order = np.lexsort((key, r))
    some, r, k = some[order], r[order], key[order]
    new_rank = np.concatenate([[True], r[1:] != r[:-1]])
    new = new_rank.copy()
    new[1:] |= k[1:] != k[:-1]
    rank[some] = r + _starts(new) - _starts(new_rank)
    last = np.append(new[1:], True)
    return some[~(new & last)]


class CoverSample:
    """The ranks, by `depth` bytes and a word more, of the sample positions of a text that lie where `inside` holds."""

    def __init__(self, text: np.ndarray, depth: int, inside: np.ndarray | None = None):
        self.depth = depth
        self.text = np.concatenate([text, np.zeros(depth + PERIOD + 8, np.uint8)])
        self.word = words(self.text)
        chosen = np.zeros(PERIOD, bool)
        chosen[_COVER] = True
        chosen = np.tile(chosen, -(-len(self.text) // PERIOD))[: len(text) + PERIOD]
        if inside is not None:
            chosen[: len(text)] &= inside
            chosen[len(text) :] = False
        at = np.flatnonzero(chosen)
        rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
        for offset in range(0, depth, 8):
            tied = tell_apart(rank, tied, self.word[at[tied] + offset])
        self.rank = np.zeros(len(self.text), np.int64)
        self.rank[at] = rank

    def sort(self, starts: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of starts by bucket and suffix, and for each place in it whether bucket and `depth` bytes are those of the one before."""
        rank = np.zeros(len(starts), np.int64)
        tied = tell_apart(rank, np.arange(len(starts)), bucket)
        for offset in range(0, PERIOD, 8):
            tied = tell_apart(rank, tied, self.word[starts[tied] + offset])
        self._resolve(starts, rank, tied)
        order = np.argsort(rank, kind="stable")
        same = np.concatenate([[False], bucket[order[1:]] == bucket[order[:-1]]])[: len(order)]
        for offset in range(0, self.depth, 8):
            at = np.flatnonzero(same)
            a, b = self.word[starts[order[at]] + offset], self.word[starts[order[at - 1]] + offset]
            if offset + 8 > self.depth:
                cut = np.uint64(8 * (offset + 8 - self.depth))
                a, b = a >> cut, b >> cut
            same[at] = a == b
        return order, same

    def _resolve(self, starts: np.ndarray, rank: np.ndarray, tied: np.ndarray) -> None:
        """Ranks of suffixes whose first bytes tie, by the cover's ranks."""
        if not len(tied):
            return
        tied = tied[np.argsort(rank[tied], kind="stable")]
        r, residue = rank[tied], starts[tied] % PERIOD
        begins = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        sizes = np.diff(np.append(begins, len(r)))
        mixed = np.minimum.reduceat(residue, begins) != np.maximum.reduceat(residue, begins)
        # Suffixes at one residue share a shift, so their ranks there sort them; others are compared by pairs.
        alike = ~np.repeat(mixed, sizes)
        tell_apart(rank, tied[alike], self.rank[starts[tied[alike]] + _SHIFTS[residue[alike], residue[alike]]])

        def compare(i: int, j: int) -> int:
            a, b = int(starts[i]), int(starts[j])
            s = int(_SHIFTS[a % PERIOD, b % PERIOD])
            return int(self.rank[a + s] - self.rank[b + s])

        for a, n in zip(begins[mixed].tolist(), sizes[mixed].tolist(), strict=True):
            members = sorted(tied[a : a + n].tolist(), key=cmp_to_key(compare))
            rank[members] = r[a] + np.arange(n)
