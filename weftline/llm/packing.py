"""Best-fit packing of token sequences by bin completion over a histogram of lengths.

Pieces of one length are interchangeable, so the search works on counts of lengths: at most ``capacity`` numbers, however
many documents there are. Its plan (patterns of lengths, each with a multiplicity) is dealt out by the rank of each piece
among those of its length, which two bounded passes find without a global sort.

Null texts count as empty; every document ends with one id 0, so that each has a piece. Rows that repeat are packed as often
as they occur; pieces of one length are dealt out by their partition and their order there. A null id is an id like others.
An empty table gives an empty result. Columns other than the id and the text are not carried, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import batch, cut

#: Search nodes for each bin completion and in all; beyond them the incumbent stays. They bound the driver's time, not the rows.
NODES_A_BIN, NODES = 1000, 200_000
#: Drawn plans: so many are tried, and each filling takes at most one of so many parts of what is left of a length.
DRAWS, PARTS = 4, 8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ord long"


def pieces(docs: DataFrame, ranks: Broadcast, pattern: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of each document, with their checksums and their place among the pieces of the same length in their partition.

    Documents of over ``capacity`` ids are cut so that all pieces but the first are full.
    """
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("ord", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = bpe.encoding(ranks, pattern), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                rows = []
                s = b.slice(lo, 512)
                for d, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                    ids = np.array([*bpe.encode_text(enc, t or "", added), end_id], "<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((d, k, x, y - x, zlib.crc32(ids[x:y].tobytes()), part, int(seen[y - x])))
                        seen[y - x] += 1
                if rows:
                    yield batch(out, *zip(*rows, strict=True))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _PIECES)


def fillings(sizes: list[int], left: dict[int, int], gap: int, waste: int, nodes: list[int], reach: dict[int, int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``gap`` that leave at most ``waste``, the fullest of each branch first.

    A filling is dominated if one of its members, or the room it leaves, could be exchanged for a larger single size that
    is still there; sizes come in falling order. ``reach`` has the sums of each size and smaller ones, as bits.
    """

    def grow(i: int, room: int, chosen: list[int]) -> Iterator[tuple[int, ...]]:
        nodes[0] -= 1
        if nodes[0] < 0:
            return
        at = max(i, int(np.searchsorted(neg, -room, "left")))
        if room <= waste and not (chosen and _dominated(chosen, room, sizes, left, neg)):
            yield tuple(chosen)
            if room == 0:
                return
        for j in range(at, len(sizes)):
            s, least = sizes[j], max(0, room - waste)
            # Sums of the sizes from here on; where none comes near enough, too much waste is left.
            if not reach[s] >> least & (1 << room - least + 1) - 1:
                return
            for k in range(min(left[s], room // s), 0, -1):
                yield from grow(j + 1, room - k * s, [*chosen, *[s] * k])
                if nodes[0] < 0:
                    return

    neg = -np.array(sizes)
    yield from grow(0, gap, [])


def _reach(sizes: tuple[int, ...], most: int) -> list[int]:
    """For each place in ``sizes``, as bits: the sums up to ``most`` of any numbers of the sizes from there on."""
    bits, out, mask = 1, [], (1 << most + 1) - 1
    for s in reversed(sizes):
        step = s
        while step <= most:
            bits |= bits << step & mask
            step *= 2
        out.append(bits)
    return out[::-1]


def _dominated(chosen: list[int], room: int, sizes: list[int], left: dict[int, int], neg: np.ndarray) -> bool:
    for s in set(chosen):
        i = int(np.searchsorted(neg, -(s + room), "left"))
        if i < len(sizes) and sizes[i] > s and left[sizes[i]] > chosen.count(sizes[i]):
            return True
    return False


def plan(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """(how many bins, lengths in each) that hold all ``counts`` pieces in as few bins as the search finds.

    Branch and bound completes bin after bin, largest length first, over undominated fillings; a branch dies once its waste
    exceeds that of the number of bins aimed at. It first aims at the volume bound, where a plan is optimal. If the nodes end
    before, best fit is the incumbent, or drawn plans as long as each has fewer bins, and the search aims at one bin fewer
    again and again; the incumbent stands where it finds none.
    """
    total = sum(s * c for s, c in counts.items())
    bound = max(-(-total // capacity), sum(c for s, c in counts.items() if 2 * s > capacity))
    found = _complete(counts, capacity, bound * capacity - total, [nodes])
    if found is not None:
        return found
    best = _best_fit(counts, capacity)
    for k in range(DRAWS):
        drawn = _drawn(counts, capacity, k) if sum(m for m, _ in best) > bound else best
        if sum(m for m, _ in drawn) >= sum(m for m, _ in best):
            break
        best = drawn
    budget = [nodes]
    while (target := sum(m for m, _ in best) - 1) > bound:
        found = _complete(counts, capacity, target * capacity - total, budget)
        if found is None:
            break
        best = found
    return best


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Largest length first, each bin filled with the largest that fit; as many equal bins at a time as the counts allow."""
    left = {s: c for s, c in counts.items() if c}
    sizes = sorted(left)
    out = []
    while left:
        chosen, room, hi = [], capacity, len(sizes)
        while room and (hi := bisect.bisect_right(sizes, room, 0, hi)):
            hi -= 1
            k = min(room // sizes[hi], left[sizes[hi]])
            chosen += [sizes[hi]] * k
            room -= sizes[hi] * k
        out.append(_take(left, chosen))
        sizes = [s for s in sizes if s in left] if len(left) < len(sizes) else sizes
    return out


def _drawn(counts: dict[int, int], capacity: int, seed: int) -> list[tuple[int, tuple[int, ...]]]:
    """Each bin filled as full as sums of the lengths allow, by lengths drawn by what is left of them, so that the mixture lasts.

    Even seeds begin a bin with the largest length, odd ones with any. The number of draws grows with the lengths and the
    logarithm of their counts.
    """
    r = np.random.default_rng(seed)
    sizes = np.array(sorted(s for s, c in counts.items() if c), np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    out, reach = [], None
    while len(sizes):
        if reach is None:
            bits = _reach(tuple(sizes[::-1].tolist()), capacity)[0]
            reach = np.array([bits >> x & 1 for x in range(capacity + 1)], bool)
            under = np.maximum.accumulate(np.where(reach, np.arange(capacity + 1), 0))
        used, room = np.zeros(len(sizes), np.int64), capacity
        if seed % 2 == 0:
            used[-1], room = 1, capacity - int(sizes[-1])
        while room:
            fit = int(np.searchsorted(sizes, room, "right"))
            free = (left - used)[:fit]
            weight = np.where(reach[under[room] - np.minimum(sizes[:fit], under[room])] & (sizes[:fit] <= under[room]), free, 0)
            if not weight.any():
                weight = free
            total = np.cumsum(weight)
            if not fit or not total[-1]:
                break
            i = int(np.searchsorted(total, r.integers(total[-1]), "right"))
            used[i] += 1
            room -= int(sizes[i])
        took = used > 0
        times = max(1, int((left[took] // used[took]).min()) // PARTS)
        out.append((times, tuple(np.repeat(sizes, used)[::-1].tolist())))
        left = left - times * used
        if not left[took].all():
            sizes, left, reach = sizes[left > 0], left[left > 0], None
    return out


def _take(left: dict[int, int], chosen: list[int]) -> tuple[int, tuple[int, ...]]:
    times = min(left[s] // chosen.count(s) for s in set(chosen))
    for s in set(chosen):
        left[s] -= times * chosen.count(s)
        if not left[s]:
            del left[s]
    return times, tuple(chosen)


def _option(left: dict[int, int], capacity: int, waste: int, number: int, budget: list[int], reach: dict[int, int]) -> tuple[int, ...] | None:
    """The bin with the largest length of ``left`` that is tried as number ``number``: full bins in the order of the search, then the fullest. None if there are no more."""
    sizes = sorted(left, reverse=True)
    largest, gap = sizes[0], capacity - sizes[0]
    nodes = [given := min(NODES_A_BIN, budget[0])]
    left[largest] -= 1
    others = []
    try:
        for f in fillings([s for s in sizes if left[s]], left, gap, min(waste, capacity), nodes, reach):
            if sum(f) < gap:
                others.append(f)
            elif number == 0:
                return (largest, *f)
            else:
                number -= 1
    finally:
        left[largest] += 1
        budget[0] -= 1 + given - max(0, nodes[0])
    others.sort(key=lambda f: (-sum(f), len(f)))
    return (largest, *others[number]) if number < len(others) else None


def _complete(counts: dict[int, int], capacity: int, waste: int, budget: list[int]) -> list[tuple[int, tuple[int, ...]]] | None:
    """A plan that wastes at most ``waste`` in all, or None if there is none within the node budget. Depth first; a bin is as often repeated as the counts allow."""
    left = {s: c for s, c in counts.items() if c}
    volume = sum(s * c for s, c in left.items())
    order = tuple(sorted(left, reverse=True))
    reach = dict(zip(order, _reach(order, capacity), strict=True))
    path: list[tuple[int, tuple[int, ...], int]] = []
    number = 0

    def put(f: tuple[int, ...], times: int) -> None:
        for s in f:
            left[s] = left.get(s, 0) - times
        for s in set(f):
            if not left[s]:
                del left[s]

    while left:
        f = _option(left, capacity, waste, number, budget, reach) if budget[0] > 0 else None
        if f is None:
            if budget[0] <= 0 or not path:
                return None
            times, f, number = path.pop()
            put(f, -times)
            volume += times * sum(f)
            waste += times * (capacity - sum(f))
            number += 1
            continue
        idle = capacity - sum(f)
        times = min(min(left[s] // f.count(s) for s in set(f)), waste // idle if idle else 1 << 60)
        after = volume - times * sum(f)
        if waste - times * idle < -after % capacity:
            number += 1
            continue
        put(f, times)
        volume, waste = after, waste - times * idle
        path.append((times, f, number))
        number = 0
    return [(times, f) for times, f, _ in path]


def _slots(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, in order of rank: first rank, first bin, pieces a bin, first offset of those runs of bins."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for times, chosen in bins:
        at = 0
        for s in sorted(set(chosen), reverse=True):
            k = chosen.count(s)
            runs.setdefault(s, []).append((seen.get(s, 0), first, k, at))
            seen[s] = seen.get(s, 0) + times * k
            at += s * k
        first += times
    return {s: tuple(np.array(x, np.int64).T) for s, x in runs.items()}


def pack(docs: DataFrame, ranks: Broadcast, pattern: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there. ``added``: tokens beside the ranks, as `bpe.added_tokens` reads them."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    all_pieces = cut(pieces(docs, ranks, pattern, capacity, end_id, doc_id, text, added))
    by_part = all_pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most `capacity` rows reach the driver, whatever the corpus.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = all_pieces.sparkSession.sparkContext.broadcast(_slots(plan(counts, capacity)))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(rows):
                    continue
                s = int(length[rows[0]])
                start, first, k, at = slots.value[s]
                i = np.searchsorted(start, rank[rows], "right") - 1
                inside = rank[rows] - start[i]
                sequence[rows] = first[i] + inside // k[i]
                offset[rows] = at[i] + inside % k[i] * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=cols)

    ranked = all_pieces.join(before, ["part", "length"]).select(*cols[:5], (F.col("before") + F.col("ord")).alias("rank"))
    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
