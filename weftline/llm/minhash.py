"""MinHash near-duplicates with HyperMinHash sketches.

A text is the set of its distinct 5-word shingles (fewer words: their whole sequence). A sketch splits the shingle hashes
over 256 buckets by their first bits and keeps, of each bucket's smallest hash, the count of leading zeros and ten mantissa
bits in 16 bits. Empty buckets borrow the register of another, found by a fixed probe order, so that short texts can be
banded as well. Bands of six compressed registers propose candidates; a Jaccard estimate from the sketches, corrected for
chance collisions of registers, thins them out, five standard deviations below the threshold; the full sets decide.

Texts of one shingle set are one class from the start, so that copies meet nothing. A band's bucket emits a spanning forest of
its candidates, whose components are clusters; each cluster is then searched on the full sets. Neither step emits pairs.
Buckets of over ``BLOCK`` sketches, and clusters of over ``BLOCK_SHINGLES`` shingles, are split into blocks that meet in pairs,
so that a task holds two blocks (a text of its own is never split); a cluster of N blocks ships each of its sets N times.

Null texts, and texts without words, have no shingles and link with nothing. Rows that share an id are one vertex. Rows
without an id are classed by their set but link with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.common import batch, binary_rows, cut, nested, own_exchange, text_slices
from weftline.llm.components import components, forest

SHINGLE, BUCKETS, MANTISSA = 5, 256, 10
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**6)**42 < 4e-6, at 0.85 < 3e-9.
BAND_ROWS, BANDS = 6, 42
EMPTY = np.uint16(0xFFFF)
#: Expected share of equal registers among those of different hashes, for ten mantissa bits.
COLLISION = 0.17 * 2.0**-MANTISSA
#: Sketches of a bucket (256 bytes each), and shingles of a cluster (8 bytes each), in a block; a task holds two.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
#: Below this many ids a list of documents to verify is broadcast (8 bytes each); above it is joined by a shuffle.
BROADCAST_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(7))
_PROBE = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])
_ODD = _rng.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = W.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    h, _, _, first = W.words(data, offsets, lower=True)
    g = W.grams(h, SHINGLE)
    for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
        if hi - lo >= SHINGLE:
            x = g[lo : hi - SHINGLE + 1].copy()
            x.sort()
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            yield W.grams(h[lo:hi], hi - lo) + np.uint64(hi - lo) if hi > lo else h[:0]


def registers(s: np.ndarray, bits: int = 8) -> np.ndarray:
    """The 2**bits registers of a sorted set of hashes; EMPTY where a bucket has none."""
    out = np.full(1 << bits, EMPTY)
    bucket = (s >> np.uint64(64 - bits)).astype(np.int64)
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    m, e = np.frexp((s[first] << np.uint64(bits)).astype(np.float64))
    out[bucket[first]] = (64 - e) * (1 << MANTISSA) + ((2 * m - 1) * (1 << MANTISSA)).astype(np.int64) % (1 << MANTISSA)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; empty buckets take the register, and the number, of the first filled one in their probe order."""
    source = np.arange(BUCKETS)
    empty = np.flatnonzero(regs == EMPTY)
    if len(empty):
        filled = regs != EMPTY
        source[empty] = _PROBE[empty, filled[_PROBE[empty]].argmax(1)]
    token = (regs[source].astype(np.uint64) << np.uint64(8)) + source.astype(np.uint64) + np.uint64(1)
    return W.mix((W.mix(token[: BANDS * BAND_ROWS]).reshape(BANDS, BAND_ROWS) * _ODD).sum(1) + _BAND)


def folded(regs: np.ndarray) -> np.ndarray:
    """Registers in one byte each, 0 where empty: enough to tell candidates apart."""
    return np.where(regs == EMPTY, 0, W.mix(regs.astype(np.uint64)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def likely(a: np.ndarray, b: np.ndarray, empty: int, collision: float, threshold: float) -> np.ndarray:
    """Whether the Jaccard estimate of the registers a with each row of b, less what collides by chance, is within five standard deviations of the threshold."""
    n = np.maximum(1, ((a != empty) | (b != empty)).sum(1))
    j = (((a == b) & (a != empty)).sum(1) / n - collision) / (1 - collision)
    return j >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / n)


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest over 0..n-1 by graph search. ``linked(u, rest)`` says which of the vertices not yet reached link to u."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            ok = linked(u, rest)
            found = rest[ok].tolist()
            out += [(u, v) for v in found]
            queue += found
            rest = rest[~ok]
    return out


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, d1, d2, regs, fold): set size, a 128-bit digest of the set, registers in two bytes and in one (null for an empty set)."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("regs", pa.binary()), ("fold", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(1)):
                sets = list(shingle_sets(data, offsets))
                d1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                d2 = np.array([W.mix(x).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                regs = [registers(x) if len(x) else None for x in sets]
                yield batch(out, b.column(0).slice(i, j - i), np.array([len(x) for x in sets]), d1, d2, [None if r is None else r.tobytes() for r in regs], [None if r is None else folded(r).tobytes() for r in regs])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, d1 long, d2 long, regs binary, fold binary")


def _bands(reps: DataFrame) -> DataFrame:
    out = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                keys = [band_keys(np.frombuffer(r, np.uint16)) for r in s.column(1).to_pylist()]
                yield batch(out, np.concatenate(keys).view(np.int64), np.repeat(s.column(0).to_numpy(), BANDS))

    return reps.select("id", "regs").mapInArrow(run, "key long, id long")


def _blocks(df: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """``df`` with block numbers i <= j: groups of a size over ``most`` are split, and each pair of blocks is a group of its own."""
    n = F.ceil(F.col(size) / most).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    return df.select("*", F.explode(pairs).alias("_p")).select(*df.columns, "_p.i", "_p.j").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys together, of batches sorted by them; no more than one batch and one group are held."""
    tail = None
    for b in batches:
        if not b.num_rows:
            continue
        if tail is not None:
            b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
        new = np.zeros(b.num_rows - 1, bool)
        for k in range(keys):
            x = b.column(k).to_numpy(zero_copy_only=False)
            new |= x[1:] != x[:-1]
        at = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(at, at[1:], strict=False):
            yield b.slice(lo, hi - lo)
        tail = b.slice(at[-1])
    if tail is not None:
        yield tail


def _edges(rows: Iterator[tuple[list[int], list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
    """The pairs of all groups of a task as a forest."""
    yield from forest(((ids[u], ids[v]) for ids, pairs in rows for u, v in pairs), ["a", "b"])


def clusters(reps: DataFrame, threshold: float) -> DataFrame:
    """(node, component): classes that chains of candidates connect. Candidates share a band, and their estimate is near the threshold.

    A bucket emits a spanning forest of its candidate graph, not its pairs.
    """
    bands = _bands(reps)
    shared = bands.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select(own_exchange("key"), "many")
    members = _blocks(bands.join(shared, "key").join(reps.select("id", "fold"), "id").select("key", "many", "id", "fold"), "key", "many", BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for g in _groups(batches, 3):
                x = np.frombuffer(b"".join(g.column(4).to_pylist()), np.uint8).reshape(-1, BUCKETS)
                yield g.column(3).to_pylist(), spanning(len(x), lambda u, rest: likely(x[u], x[rest], 0, 1 / 255, threshold))

        yield from _edges(each())

    return components(members.select("key", "i", "j", "id", "fold").mapInArrow(run, "a long, b long"), thin=True)


def _verified(cluster: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Links (a, b) with 100 * |intersection| >= percent * |union| on the full sets, a spanning forest of each cluster's.

    ``cluster`` has node, component, and the number n of the node's shingles. The sets of the cluster's documents are made anew and shipped once each. A search from document to document tests every
    pair of which one is not yet reached, thinned out by estimates from 256 and then 1024 registers of the full sets.
    """
    ids = cluster.select(F.col("node").alias("id"), F.col("component").alias("c"), "n")
    sized = cut(ids.drop("n").join(ids.groupBy("c").agg(F.sum("n").alias("many")).select(own_exchange("c"), "many"), "c"))
    few = F.broadcast(sized) if sized.count() <= BROADCAST_IDS else sized
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(few, "id")
    out = pa.schema([("c", pa.int64()), ("many", pa.int64()), ("id", pa.int64()), ("s", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(3)):
                got = list(shingle_sets(data, offsets))
                part = b.slice(i, j - i)
                yield batch(out, *part.columns[:3], binary_rows(np.concatenate(got) if got else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in got])))))

    full = _blocks(src.select("c", "many", "id", "text").mapInArrow(sets, "c long, many long, id long, s binary"), "c", "many", BLOCK_SHINGLES)
    threshold = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for g in _groups(batches, 3):
                s = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column(4)]
                coarse, fine = (np.stack([registers(x, bits) for x in s]) if len(s) > 2 else None for bits in (8, 10))
                size = np.array([len(x) for x in s])

                def linked(u, rest, s=s, coarse=coarse, fine=fine, size=size):
                    ok = 100 * np.minimum(size[u], size[rest]) >= percent * np.maximum(size[u], size[rest])
                    if coarse is not None:
                        for r in (coarse, fine):
                            ok[ok] = likely(r[u], r[rest[ok]], EMPTY, COLLISION, threshold)
                    for k in np.flatnonzero(ok):
                        x, y = s[u], s[rest[k]]
                        x, y = (x, y) if len(x) <= len(y) else (y, x)
                        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        ok[k] = 100 * common >= percent * (len(x) + len(y) - common)
                    return ok

                yield g.column(3).to_pylist(), spanning(len(s), linked)

        yield from _edges(each())

    return full.select("c", "i", "j", "id", "s").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. Links: Jaccard similarity of at least percent / 100."""
    sketch = cut(sketches(docs, doc_id, text))
    reps = cut(sketch.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.first("regs").alias("regs"), F.first("fold").alias("fold")))
    cluster = clusters(reps, percent / 100).join(reps.select(F.col("id").alias("node"), "n"), "node")
    links = _verified(cut(cluster), docs, doc_id, text, percent)
    whole = components(links, thin=True)
    by_set = reps.select("d1", "d2", "n", "id").join(whole.toDF("id", "c"), "id", "left").select("d1", "d2", "n", F.coalesce("c", "id").alias("c"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return sketch.drop("regs", "fold").join(by_set, ["d1", "d2", "n"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their component (among rows that share that id, all); columns stay as they are. Rows without an id stay."""
    drop = near_duplicates(docs, percent=percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    return nested(docs, key=F.col("doc_id").cast("long")).join(drop, F.col("key") == F.col("doc_id"), "left_anti").select("row.*")
