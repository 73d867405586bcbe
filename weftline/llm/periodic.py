"""Periodic runs of words by matching aligned power-of-two blocks, and their collapse to one period.

A run is a stretch of words with smallest period q (words q apart are identical) of at least four periods and six words that no
neighbouring word extends. At scale b the words are cut into aligned blocks of b. A run of period b <= q < 2b holds a whole
block that stands again q words later, inside the run. So the blocks of a scale become keys of an Aho-Corasick automaton of
integer sequences, which is run over the words around them; an occurrence b to 2b - 1 words after its block is a seed, which
is extended word by word to both sides. Only blocks whose every word stands again within the next 2b - 1 words can seed a run,
and only those become keys; blocks that lie with all their seeds inside a run of smaller period tell nothing new.

Null texts have no words. Whole texts are searched, of any length; a long text is one slice of one task. Rows that repeat give
the same result each; an empty table gives an empty result. Other columns pass through, whatever their names; only those named
as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import words as W
from weftline.llm.common import nested, text_slices

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Longest key of an automaton; longer blocks are keyed by the hashes of their equal parts.
LONGEST_KEY = 1 << 12

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def _recurrence(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the distance to its next occurrence in the same text, or a very large number."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    order = np.lexsort((h, text))
    out = np.full(len(h), 1 << 62, np.int64)
    same = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


class _Runs:
    """Runs found so far: (start, end) -> smallest period."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        if self.period.get((start, end), period + 1) > period:
            self.period[start, end] = period

    def covers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts in order, and the furthest end of a run that starts there or before, with its period."""
        found = sorted((s, e, q) for (s, e), q in self.period.items())
        starts, ends, periods = (np.array(x, np.int64) for x in zip(*found, strict=True))
        furthest = np.maximum.accumulate(ends)
        at = np.maximum.accumulate(np.where(ends == furthest, np.arange(len(ends)), 0))
        return starts, furthest, periods[at]


def _inside(runs: _Runs, start: np.ndarray, end: np.ndarray, distance: np.ndarray | None = None) -> np.ndarray:
    """Whether a run known so far reaches over start to end; with a distance, only if its period divides that."""
    if not runs.period:
        return np.zeros(len(start), bool)
    starts, ends, periods = runs.covers()
    at = np.searchsorted(starts, start, "right") - 1
    ok = (at >= 0) & (ends[at] >= end)
    return ok if distance is None else ok & (distance % periods[at] == 0)


def _seeds(ids: np.ndarray, first: np.ndarray, blocks: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of every given block of b words that stands again b to 2b - 1 words later in the same text."""
    import ahocorasick

    part = max(1, b // LONGEST_KEY)
    names = ids
    if part > 1:  # the hash of the words from each place on, by doubling
        size = 1
        names = ids.astype(np.uint64)
        while size < part:
            names = W.mix(names[: len(names) - size] * np.uint64(0x9E3779B97F4A7C15) + names[size:])
            size *= 2
        names = np.unique(names, return_inverse=True)[1]
    text_end = first[np.searchsorted(first, blocks, "right")]
    keys: dict[tuple[int, ...], int] = {}
    number = np.full(int(blocks[-1]) // b + 1, -1, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i in blocks.tolist():
        key = tuple(names[i : i + b : part].tolist())
        if key not in keys:
            keys[key] = len(keys)
            automaton.add_word(key, keys[key])
        number[i // b] = keys[key]
    automaton.make_automaton()
    # The places searched: from b words after each block to the end of its last possible occurrence, overlaps merged.
    lo, hi = blocks + b, np.minimum(blocks + 3 * b - 1, text_end)
    lo, hi = lo[hi - lo >= b], hi[hi - lo >= b]
    if not len(lo):
        return lo, lo
    new = np.concatenate(([True], lo[1:] > np.maximum.accumulate(hi)[:-1]))
    spans = zip(lo[new].tolist(), np.maximum.reduceat(hi, np.flatnonzero(new)).tolist(), strict=True)
    at, which = [], []
    for x, y in spans:
        for r in range(part):
            for end, key in automaton.iter(tuple(names[x + r : max(x + r, y - part + 1) : part].tolist())):
                at.append(x + r + part * (end + 1) - b)
                which.append(key)
    place = np.array(at, np.int64)
    block = place // b - 1
    ok = (block >= 0) & (block < len(number))
    ok[ok] = number[block[ok]] == np.array(which, np.int64)[ok]
    block, place = block[ok] * b, place[ok]
    same = first[np.searchsorted(first, block, "right")] >= place + b
    return block[same], (place - block)[same]


def _same(ids: np.ndarray, at: int, distance: int, step: int, most: int) -> int:
    """How many words from ``at`` on, forwards or backwards, equal those ``distance`` later; ``most`` at most."""
    done, size = 0, 16
    while done < most:
        n = min(size, most - done)
        lo = at + done if step > 0 else at - done - n + 1
        differ = np.flatnonzero(ids[lo : lo + n] != ids[lo + distance : lo + distance + n])
        if len(differ):
            return done + int(differ[0] if step > 0 else n - 1 - differ[-1])
        done += n
        size *= 2
    return done


def _extend(runs: _Runs, ids: np.ndarray, first: np.ndarray, place: np.ndarray, b: int, d: int) -> None:
    """Extends the seeds of distance ``d`` at ``place`` (in order) to both sides, and keeps those that are runs."""
    least = max(LEAST_WORDS, LEAST_PERIODS * d) - d
    if len(place) * 64 > len(ids):  # so many that one pass over all words is cheaper
        equal = np.concatenate(([0], ids[:-d] == ids[d:], [0])).astype(np.int8)
        bounds = first[1:-1]
        for k in bounds[bounds < len(ids)].tolist():
            equal[max(1, k - d + 1) : k + 1] = 0
        edge = np.flatnonzero(np.diff(equal))
        lo, hi = edge[::2], edge[1::2]
        keep = (hi - lo >= least) & (np.searchsorted(place, hi - b, "right") > np.searchsorted(place, lo))
        for s, e in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True):
            runs.add(s, e + d, d)
        return
    reached = -1
    for i in place.tolist():
        if i + b <= reached:
            continue
        k = int(np.searchsorted(first, i, "right"))
        right = i + b + _same(ids, i + b, d, 1, int(first[k]) - d - i - b)
        left = i - _same(ids, i - 1, d, -1, i - int(first[k - 1]))
        reached = right
        if right - left >= least:
            runs.add(left, right + d, d)


def find_runs(h: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each text, by start, then period. ``h``: the words of all texts, ``first``: the first word of each, and the end."""
    first = np.asarray(first, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    if not len(h):
        return out
    recur, b, runs, ids = _recurrence(h, first), 1, _Runs(), None
    longest = int(np.diff(first).max())
    while b * LEAST_PERIODS <= longest:
        at = np.flatnonzero(recur < 2 * b) * b
        if len(at):
            at = at[first[np.searchsorted(first, at, "right")] >= at + b]
            at = at[~_inside(runs, at, at + 3 * b)]
        if len(at):
            if ids is None:
                ids = np.unique(h, return_inverse=True)[1]
            place, distance = _seeds(ids, first, at, b)
            fresh = ~_inside(runs, place, place + distance + b, distance)
            place, distance = place[fresh], distance[fresh]
            order = np.lexsort((place, distance))
            place, distance = place[order], distance[order]
            for group in np.split(np.arange(len(place)), np.flatnonzero(np.diff(distance)) + 1):
                if len(group):
                    _extend(runs, ids, first, place[group], b, int(distance[group[0]]))
        even = len(recur) // 2 * 2
        recur = np.maximum(recur[:even:2], recur[1:even:2])
        b *= 2
    for (s, e), q in sorted(runs.period.items(), key=lambda x: (x[0][0], x[1])):
        k = int(np.searchsorted(first, s, "right")) - 1
        out[k].append((s - int(first[k]), e - s, q))
    return out


def collapse(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", words: str = "n_words") -> DataFrame:
    """``df`` with the runs of each text, the text with each run cut to its first period (kept words joined by one blank), and the number of words."""
    extra = [T.StructField(runs, T.ArrayType(RUN, False), False), T.StructField(collapsed, T.StringType(), False), T.StructField(words, T.LongType(), False)]
    keep = [f.name for f in df.schema if f.name not in {e.name for e in extra}]
    schema = T.StructType([*(df.schema[n] for n in keep), *extra])
    kind = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]))

    def of_batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in text_slices(b.column(1)):
            h, _, _, first = W.words(data, offsets)
            found, left = find_runs(h, first), []
            for k, r in enumerate(found):
                w = data[offsets[k] : offsets[k + 1]].tobytes().split()
                if r:
                    gone = np.zeros(len(w) + 1, np.int64)
                    for s, n, q in r:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    w = [x for x, g in zip(w, np.cumsum(gone).tolist(), strict=False) if not g]
                left.append(b" ".join(w).decode())
            flat = [dict(zip(("start", "length", "period"), x, strict=True)) for r in found for x in r]
            ends = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind.value_type))
            row = b.column(0).slice(i, j - i)
            arrays = [row.field(n) for n in keep] + [lists, pa.array(left, pa.string()), pa.array(np.diff(first), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(e.name for e in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from of_batch(b)

    return nested(df, text=F.col(text)).mapInArrow(run, schema)


def summary(df: DataFrame, doc_id: str = "doc_id", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Per document the number of runs, the one of greatest length by period (then smallest start, then period), and digests."""
    order = F.array_sort(runs, lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.signum(b["length"] * a["period"] - a["length"] * b["period"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    best = F.get(order, F.lit(0))
    lines = F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    with_best = df.select(F.col(doc_id).alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(collapsed, 256).alias("collapsed_sha256"))
    return with_best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
