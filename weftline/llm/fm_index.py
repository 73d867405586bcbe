"""A compressed FM-index over a sequence of symbols, searched backwards for many patterns at a time.

The Burrows-Wheeler transform lies in a wavelet tree stored level by level as packed bits with a running count for every 64
of them (a wavelet matrix), so that a rank costs two lookups a level. Suffixes are sorted by their first ``depth`` symbols or
more, which makes the intervals of patterns up to that length exact; longer patterns are refused. Besides, an index of n
symbols keeps the owner of each suffix and minima over blocks of owners: about three integers of 32 bits a symbol.
"""

from __future__ import annotations

import numpy as np

_ONE, _LOW = np.uint64(1), np.uint64(63)
#: Rows of a block of owners, as a power of two.
_BLOCK = 5


class Bits:
    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.zeros(n // 64 + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed))))[:-1].astype(np.int64)
        self.zeros = n - int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (_ONE << (i.astype(np.uint64) & _LOW)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Of ``symbols`` (0 to sigma - 1; 0 separates texts). ``owner``: a number for each position; intervals know their smallest."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, sigma: int, depth: int) -> None:
        n = len(symbols)
        self.n, self.depth = n, depth
        order = _sorted_suffixes(symbols, depth)
        bwt = symbols[order - 1]  # before position 0 stands the last symbol, a separator
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        self.levels: list[Bits] = []
        self.shifts = range(max(1, (sigma - 1).bit_length()) - 1, -1, -1)
        cur = bwt
        for s in self.shifts:
            bit = ((cur >> s) & 1).astype(bool)
            self.levels.append(Bits(bit))
            cur = np.concatenate((cur[~bit], cur[bit]))
        # Where a symbol's run starts at the foot of the tree.
        at_foot = _foot_order(sigma, len(self.shifts))
        self.foot = np.empty(sigma, np.int64)
        self.foot[at_foot] = np.concatenate(([0], np.cumsum(np.bincount(cur, minlength=sigma)[at_foot])))[:-1]
        # Smallest owner of any interval: from each row to the ends of its block, and minima of 2**k whole blocks.
        size = 1 << _BLOCK
        padded = np.full(-(-n // size) * size, np.iinfo(owner.dtype).max, owner.dtype)
        padded[:n] = owner[order]
        self.owner = padded
        grid = padded.reshape(-1, size)
        self.to_end = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.from_start = np.minimum.accumulate(grid, 1).ravel()
        self.blocks = [grid.min(1)] if n else []
        while len(self.blocks[-1:]) and len(self.blocks[-1]) > (half := 1 << (len(self.blocks) - 1)):
            self.blocks.append(np.minimum(self.blocks[-1][:-half], self.blocks[-1][half:]))

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns after the symbols c are put before them."""
        m = len(c)
        i = np.concatenate((lo, hi))
        cc = np.concatenate((c, c))
        for level, s in zip(self.levels, self.shifts, strict=True):
            ones = level.rank1(i)
            i = np.where((cc >> s) & 1, level.zeros + ones, i - ones)
        offset = self.starts[c] - self.foot[c]
        return i[:m] + offset, i[m:] + offset

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner in each interval, none of which is empty."""
        last = hi - 1
        a, b = lo >> _BLOCK, last >> _BLOCK
        out = np.minimum(self.to_end[lo], self.from_start[last])
        inside = np.flatnonzero(a == b)
        if len(inside):
            first, size = lo[inside], hi[inside] - lo[inside]
            least = self.owner[first]
            for k in range(1, int(size.max())):
                least = np.minimum(least, self.owner[first + np.minimum(k, size - 1)])
            out[inside] = least
        between = b - a - 1
        level = np.frexp(between.astype(np.float64))[1] - 1
        for k in np.unique(level[between > 0]).tolist():
            rows = np.flatnonzero((level == k) & (between > 0))
            m = self.blocks[k]
            out[rows] = np.minimum(out[rows], np.minimum(m[a[rows] + 1], m[b[rows] - (1 << k)]))
        return out


def _foot_order(sigma: int, bits: int) -> np.ndarray:
    """Symbols in the order in which their runs stand at the foot: by their bits, the last level first."""
    s = np.arange(sigma)
    r = np.zeros(sigma, np.int64)
    for b in range(bits):
        r |= ((s >> b) & 1) << (bits - 1 - b)
    return np.argsort(r, kind="stable")


def _sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols or more, by doubling; beyond that, by position."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    size = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        rank = new
        if size >= depth or (n and rank[order[-1]] == n - 1):
            return order
        after = np.full(n, 0, np.int64)
        after[: n - size] = rank[size:] + 1
        rank = rank * np.int64(n + 1) + after
        order = np.argsort(rank, kind="stable")
        size *= 2


def matching_statistics(index: FMIndex, symbols: np.ndarray, owner: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """For positions of ``symbols``: the length, up to ``width``, of the longest match that ends there and also stands at a smaller owner.

    Streams are symbols[first:end], each of one owner. Positions that can add nothing to what matches of ``width`` cover hold
    -1 and are not searched: once a match that ends at e is shorter than ``width``, none of that length holds the symbol
    before it, and the next end tried lies ``width`` behind that symbol. After a match of ``width`` the search leaps a whole
    width, and half as far each time that the leap fails, so that nothing between is left untried.
    """
    if width > index.depth:
        raise ValueError(f"the index is exact for patterns of up to {index.depth} symbols, not {width}")
    lengths = np.full(len(symbols), -1, np.int32)
    # At: start of the window. Held: start of the last window that matched, or -1. Leap: how far the window is from it.
    at, held, leap = first.astype(np.int64), np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
    stop = end.astype(np.int64) - width
    ids = np.flatnonzero(at <= stop)
    at, held, leap, stop = at[ids], held[ids], leap[ids], stop[ids]
    own = owner[at] if len(at) else at
    pos = at + width - 1
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    while len(at):
        nlo, nhi = index.step(symbols[pos], lo, hi)
        ok = nlo < nhi
        some = np.flatnonzero(ok)
        ok[some] = index.smallest(nlo[some], nhi[some]) < own[some]
        done = ok & (pos == at)
        lo, hi = nlo, nhi
        new = np.flatnonzero(done | ~ok)
        move = ok & ~done
        pos[move] -= 1
        if len(new):
            won = done[new]
            w, f = new[won], new[~won]
            lengths[at[w] + width - 1] = width
            lengths[at[f] + width - 1] = at[f] + width - 1 - pos[f]
            leap[w] = np.where(held[w] < 0, width, np.maximum(1, leap[w]))
            held[w] = at[w]
            at[w] = held[w] + leap[w]
            # A failed leap of over 1 is halved; otherwise all windows over pos..end are out.
            short = leap[f] > 1
            s, g = f[short], f[~short]
            leap[s] //= 2
            at[s] = held[s] + leap[s]
            at[g] = pos[g] + 1
            held[g], leap[g] = -1, 0
            # A leap over the end is shortened to the last window, unless that is the one that matched.
            over = new[(at[new] > stop[new]) & (held[new] >= 0) & (held[new] < stop[new])]
            leap[over] = stop[over] - held[over]
            at[over] = stop[over]
            pos[new] = at[new] + width - 1
            lo[new], hi[new] = 0, index.n
            if (at[new] > stop[new]).any():
                live = at <= stop
                at, held, leap, stop, own, pos, lo, hi = (x[live] for x in (at, held, leap, stop, own, pos, lo, hi))
    return lengths


def intervals(lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of what matches of at least ``least`` cover, given the matching statistics by end; overlapping ones are one."""
    at = np.flatnonzero(lengths >= least)
    step = np.zeros(len(lengths) + 2, np.int64)
    np.add.at(step, at - lengths[at] + 1, 1)
    np.add.at(step, at + 1, -1)
    inside = np.concatenate(([False], np.cumsum(step) > 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]
