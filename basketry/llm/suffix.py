"""External induced sorting of the suffixes of many byte strings, with common-prefix values.

The strings stand in one text, each ended by a separator 0 (smaller than any
byte); suffixes are compared up to their separator and common prefixes are
counted up to a cap.  The text, its marks and the seeds' names are held at once (tens of
bytes for each of its bytes), so the caller bounds the text; queues work on blocks:

- ``Scratch`` keeps arrays and queue blocks in memory up to a budget and in
  task-private files beyond it (removed when the task ends, also on failure; like
  Spark's own spill nobody else reads them, and a repeated task starts anew);
- the queue of an induction is a priority queue over the first character:
  one first-in first-out run for each character, blocks of (position, common
  prefix) tuples, spilled by the scratch;
- ``_left`` and ``_right`` scan the suffixes in ascending and in descending order and
  push the tuple of each scanned suffix's left neighbour, block by block.
  The common prefix of two neighbours in a run is one more than the smallest
  value scanned between their sources, so it travels with the tuples.

The start positions of the local minima (seeds) are sorted by a first
induction, named, and the reduced string of their names is ranked by the same
sorter, recursively, while its alphabet stays small; the base case ranks
names by doubling with sorted runs.  Names cover at least two bytes, so
doubling ends after a few rounds at the cap.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from basketry.llm import text as tx

BLOCK = 1 << 19
SMALL_ALPHABET = 1 << 12


class Scratch:
    """Arrays and blocks in memory up to a budget, beyond it in a folder of this task's own."""

    def __init__(self, memory: int = 256 << 20):
        self.left = memory
        self._folder: str | None = None
        self._files = 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        if self._folder:
            shutil.rmtree(self._folder, ignore_errors=True)

    def _path(self) -> str:
        self._folder = self._folder or tempfile.mkdtemp(prefix="suffix-")
        self._files += 1
        return os.path.join(self._folder, str(self._files))

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if n and size > self.left:
            return np.memmap(self._path(), dtype, "w+", shape=(n,))
        self.left -= size
        return np.zeros(n, dtype)

    def keep(self, block: np.ndarray) -> np.ndarray | tuple:
        """The block itself, or the file that holds it."""
        if block.nbytes <= self.left:
            self.left -= block.nbytes
            return block
        path = self._path()
        block.tofile(path)
        return path, block.dtype

    def take(self, kept) -> np.ndarray:
        if isinstance(kept, tuple):
            block = np.fromfile(*kept)
            os.unlink(kept[0])
            return block
        self.left += kept.nbytes
        return kept


class Run:
    """First-in first-out blocks of one character: positions and common prefixes."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.blocks, self.last = scratch, deque(), -1

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.last = int(pos[-1])
        for k in range(0, len(pos), BLOCK):
            self.blocks.append((self.scratch.keep(pos[k:k + BLOCK].copy()), self.scratch.keep(lcp[k:k + BLOCK].copy())))

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What waits, in order and in pieces of up to a block, also what is pushed meanwhile."""
        while self.blocks:
            some, size = [], 0
            while self.blocks and size < BLOCK:
                pos, lcp = self.blocks.popleft()
                some.append((self.scratch.take(pos), self.scratch.take(lcp)))
                size += len(some[-1][0])
            yield some[0] if len(some) == 1 else (np.concatenate([p for p, _ in some]), np.concatenate([c for _, c in some]))


class _Minima:
    """Smallest scanned value since the last push to each character's run."""

    def __init__(self, sigma: int, cap: int):
        self.since = np.full(sigma, cap, np.uint8)
        self.cap = cap

    def pushed(self, lcp: np.ndarray, a: np.ndarray, c: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """For sources ``a`` of a scanned block, by character ``c`` in runs that start at ``cuts``: the minimum since the character's last source."""
        low = np.empty(len(c), np.uint8)
        before = np.minimum.accumulate(lcp)
        heads, tails = cuts[:-1], cuts[1:] - 1
        low[heads] = np.minimum(self.since[c[heads]], before[a[heads]])
        rest = np.ones(len(c), bool)
        rest[heads] = False
        rest = np.flatnonzero(rest)
        if len(rest):
            low[rest] = _range_min(lcp, a[rest - 1] + 1, a[rest])
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap)
        np.minimum(self.since, before[-1], out=self.since)
        self.since[c[tails]] = after[a[tails] + 1]
        return low


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi] for each pair, by levels of doubled width."""
    width = hi - lo + 1
    level = np.frexp(width)[1] - 1
    out = np.empty(len(lo), np.uint8)
    table, k = values, 0
    for want in range(int(level.max()) + 1):
        if want:
            step = 1 << (want - 1)
            table = np.minimum(table[:-step], table[step:])
        at = np.flatnonzero(level == want)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << want) + 1])
    return out


class Suffixes:
    """Sorter of a text of small integers with separators 0; the text ends with one."""

    def __init__(self, text: np.ndarray, cap: int, scratch: Scratch):
        self.x, self.cap, self.scratch = text, cap, scratch
        self.n = len(text)
        self.left_of = scratch.array(self.n, text.dtype)  # the character before each position
        self.left_of[1:] = text[:-1]
        self.sigma = int(text.max()) + 1 if self.n else 1
        ends = np.flatnonzero(text[:-1] != text[1:])
        rising = np.append(text[ends] < text[ends + 1], True)
        lengths = np.diff(np.concatenate([[-1], ends, [self.n - 1]]))
        self.small = np.repeat(rising, lengths)  # smaller than its right neighbour
        self.small[text == 0] = True
        seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.place = np.int32 if self.n < 1 << 31 else np.int64
        is_seed = text == 0
        is_seed[seeds] = True
        self.seeds = np.flatnonzero(is_seed).astype(self.place)
        self.is_seed = is_seed

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and at b, up to the cap, not past a separator."""
        out = np.zeros(len(a), np.uint8)
        open_ = np.arange(len(a))
        for k in range(self.cap):
            if not len(open_):
                break
            p, q = a[open_] + k, b[open_] + k
            ok = (p < self.n) & (q < self.n)
            p, q, open_ = p[ok], q[ok], open_[ok]
            same = (self.x[p] == self.x[q]) & (self.x[p] != 0)
            open_ = open_[same]
            out[open_] = k + 1
        return out

    def _one(self, a: int, b: int) -> int:
        return int(self.common(np.array([a]), np.array([b]))[0])

    def _push(self, runs: list[Run], pos: np.ndarray, lcp: np.ndarray, before: np.ndarray, take: np.ndarray, minima: _Minima | None) -> None:
        at = np.flatnonzero(take)
        if not len(at):
            if minima is not None and len(lcp):
                np.minimum(minima.since, lcp.min(), out=minima.since)
            return
        chars = before[at]
        order = np.argsort(chars, kind="stable")
        at, chars = at[order], chars[order]
        left = pos[at] - 1
        cuts = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1, [len(chars)]])
        low = np.minimum(minima.pushed(lcp, at, chars, cuts), self.cap - 1) + np.uint8(1) if minima is not None else np.zeros(len(at), np.uint8)
        for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
            run, some = runs[int(chars[a])], low[a:z]
            if run.last < 0:
                some = some.copy()
                some[0] = 0  # the first of its character
            run.push(left[a:z], some)

    def _left(self, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> list[list]:
        """Ascending scan over larger suffixes and seeds; the larger suffixes of each character, as kept blocks."""
        runs = [Run(self.scratch) for _ in range(self.sigma)]
        minima = _Minima(self.sigma, self.cap) if seed_lcp is not None else None
        starts = np.searchsorted(self.x[seeds], np.arange(self.sigma + 1))
        found: list[list] = [[] for _ in range(self.sigma)]
        for c in range(self.sigma):
            last = -1
            for pos, lcp in runs[c].drain():
                before = self.left_of[pos]
                self._push(runs, pos, lcp, before, before >= max(c, 1), minima)
                found[c].append((self.scratch.keep(pos), self.scratch.keep(lcp)))
                last = int(pos[-1])
            for a in range(starts[c], starts[c + 1], BLOCK):
                z = min(a + BLOCK, starts[c + 1])
                pos = seeds[a:z]
                lcp = seed_lcp[a:z].copy() if seed_lcp is not None else np.zeros(z - a, np.uint8)
                if seed_lcp is not None and a == starts[c]:
                    lcp[0] = self._one(last, int(pos[0])) if last >= 0 else 0
                before = self.left_of[pos]
                self._push(runs, pos, lcp, before, before > c, minima)
        return found

    def _right(self, larger: list[list], with_lcp: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Descending scan; yields all suffixes (but those at separators) from the largest to the smallest with the common prefix with the one before."""
        runs = [Run(self.scratch) for _ in range(self.sigma)]
        minima = _Minima(self.sigma, self.cap) if with_lcp else None
        for c in range(self.sigma - 1, 0, -1):
            last = -1
            for pos, lcp in runs[c].drain():
                before = self.left_of[pos]
                self._push(runs, pos, lcp, before, (before > 0) & (before <= c), minima)
                last = int(pos[-1])
                yield pos, lcp
            carry = None  # the common prefix of the next block's last suffix with the one above it
            while larger[c]:
                pos, lcp = larger[c].pop()
                pos, lcp = self.scratch.take(pos)[::-1], self.scratch.take(lcp)[::-1]
                above = np.empty(len(lcp), np.uint8)  # descending: the value with the larger neighbour
                above[1:] = lcp[:-1]
                if carry is not None:
                    above[0] = carry
                else:
                    above[0] = self._one(last, int(pos[0])) if with_lcp and last >= 0 else 0
                carry = lcp[-1]
                before = self.left_of[pos]
                self._push(runs, pos, above, before, (before > 0) & (before < c), minima)
                yield pos, above

    def _names(self) -> tuple[np.ndarray, np.ndarray]:
        """The seeds in text order, and the order-keeping name of the text from each seed to the next (0 at separators)."""
        seeds = self.seeds
        by_char = seeds[np.argsort(self.x[seeds], kind="stable")]
        parts = [pos[self.is_seed[pos]] for pos, _ in self._right(self._left(by_char, None), False)]
        ordered = np.concatenate(parts)[::-1] if parts else np.zeros(0, self.place)
        nxt = np.append(seeds[1:], self.n - 1)
        number = np.cumsum(self.is_seed, dtype=self.place) - 1  # of each seed, in text order
        end = nxt[number[ordered]] + 1
        value = (np.arange(self.sigma, dtype=np.uint64) + np.uint64(1)) * np.uint64(tx.splitmix(77))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(value)[self.x] * tx._powers(tx._BASE, self.n))])
        shape = tx.mix((sums[end] - sums[ordered]) * tx._powers(tx._UNBASE, self.n + 1)[ordered]) ^ (end - ordered).astype(np.uint64)
        new = np.ones(len(ordered), np.int64)
        new[1:] = shape[1:] != shape[:-1]
        names = np.zeros(len(seeds), np.int64)
        names[number[ordered]] = np.cumsum(new)
        return seeds, names

    def _ordered_seeds(self) -> np.ndarray:
        """Seeds in suffix order (up to the cap)."""
        seeds, names = self._names()
        if len(names) and names.max() < len(names) - (names == 0).sum():  # names repeat
            if int(names.max()) < SMALL_ALPHABET and len(names) > SMALL_ALPHABET:
                deeper = Suffixes(names.astype(np.uint16), self.cap, self.scratch)
                order = np.concatenate([pos for pos, _ in deeper._all()])[::-1]
                stops = np.flatnonzero(names == 0)
                return seeds[np.concatenate([stops, order])]
            names = _doubled(names, self.cap)
        return seeds[np.argsort(names, kind="stable")]

    def _all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seeds = self._ordered_seeds()
        lcp = np.zeros(len(seeds), np.uint8)
        if len(seeds) > 1:
            lcp[1:] = self.common(seeds[:-1], seeds[1:])
        return self._right(self._left(seeds, lcp), True)

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (positions, common prefix with the suffix before) of all suffixes, from the largest to the smallest."""
        yield from self._all() if self.n else ()


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names with separators 0, exact up to ``cap`` names."""
    stop = np.flatnonzero(names == 0)
    reach = stop[np.searchsorted(stop, np.arange(len(names)))]  # the separator of each position's string
    rank, h = names.astype(np.uint64), 1
    while h < cap:
        ahead = np.arange(len(names)) + h
        second = np.where(ahead < reach, rank[np.minimum(ahead, len(names) - 1)], 0).astype(np.uint64)
        keys = (rank << np.uint64(32)) | second
        keys[stop] = 0
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.zeros(len(keys), np.uint64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(new)
        if int(rank[order[-1]]) >= len(names) - len(stop):
            break
        h *= 2
    return rank.astype(np.int64)
