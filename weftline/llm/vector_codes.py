"""Product codes of integer vectors: one small codebook for each part position, searched through vantage-point trees.

Components become floor(scale * x); a vector is cut into equal consecutive parts, and each part is coded by the nearest entry of
its position's codebook (squared Euclidean distance, ties to the lower index). Codebooks start as the parts of the smallest ids
and are refined by rounds of assignment and componentwise floor of the mean; entries that no part uses stay.

Each codebook is a vantage-point tree. A node compares the queries with its entry by exact integers; a subtree is skipped where
the distance to the node's entry proves it farther than the best so far. That bound is taken in floating point, rounded so that
it never claims too much, and a subtree that might hold an equal distance is visited: a tie with a lower index is not lost.

A round is one pass over the vectors, which leaves per task, position and entry a count and sums; only these are shuffled, and
entries x dimensions numbers reach the driver, whatever the rows. Vectors that are null, hold null or non-finite components (or
components of 2^60 / scale and more, for which there is no 64-bit integer) or have another length than that of the smallest id
are dropped. Rows that repeat count and are coded as often as they occur; of repeated ids the smallest vector is that of the
start. Rows without an id are coded, and start nothing. Fewer ids than entries make smaller codebooks; a length that the parts
don't divide makes the first parts one longer; an empty table gives an empty result. Other columns pass through, whatever their
names; only those named as results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import cut, nested, unnested

#: Beyond this size of components squared distances are taken in integers of any length.
WIDE = 1 << 26
LARGEST = 1 << 60
#: Groups of labels up to this number are broadcast (16 bytes each); beyond it they are joined by a salted shuffle.
BROADCAST_LABELS, SALTS = 100_000, 64
_BATCH = 4096


def _root(squared: np.ndarray, up: bool) -> np.ndarray:
    """The square root, rounded so that it is not too small (up) or not too large."""
    x = np.sqrt(squared.astype(np.float64))
    return np.nextafter(x * (1 + 1e-14), np.inf) if up else np.maximum(0.0, np.nextafter(x * (1 - 1e-14), -np.inf))


def _squared(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = rows - entry
    return (gap * gap).sum(axis=1) if len(rows) else np.zeros(0, rows.dtype)


class VantageTree:
    """Nearest entries of many queries at once. ``entries``: integers, one row each."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._grow(list(range(len(entries))))

    def _grow(self, members: list[int]):
        """(index, inner, outer), each subtree with the least and largest distance of its members to the entry."""
        if not members:
            return None
        vantage, rest = members[0], members[1:]
        if not rest:
            return vantage, None, None
        d = _squared(self.entries[rest], self.entries[vantage])
        order = sorted(range(len(rest)), key=lambda k: (d[k], rest[k]))
        half = (len(order) + 1) // 2
        sides = []
        for part in (order[:half], order[half:]):
            if not part:
                sides.append(None)
                continue
            near, far = np.array([d[part[0]]]), np.array([d[part[-1]]])
            sides.append((float(_root(near, False)[0]), float(_root(far, True)[0]), self._grow([rest[k] for k in part])))
        return vantage, sides[0], sides[1]

    def nearest(self, rows: np.ndarray, visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; ``visits`` counts the distances taken."""
        self.best = np.full(len(rows), len(self.entries), np.int64)
        self.least = _squared(rows, self.entries[0]) if len(rows) else np.zeros(0, np.int64)
        if len(rows):
            self.best[:] = 0
            self._visit(self.root, np.arange(len(rows)), rows, visits)
        return self.best, self.least

    def _visit(self, node, at: np.ndarray, rows: np.ndarray, visits: list[int] | None) -> None:
        vantage, inner, outer = node
        d = _squared(rows[at], self.entries[vantage])
        if visits is not None:
            visits[0] += len(at)
        better = (d < self.least[at]) | ((d == self.least[at]) & (vantage < self.best[at]))
        better = better.astype(bool)
        self.least[at[better]], self.best[at[better]] = d[better], vantage
        low, high = _root(d, False), _root(d, True)
        nearer = inner is None or outer is None or low.mean() <= (inner[1] + outer[0]) / 2
        for side in (inner, outer) if nearer else (outer, inner):
            if side is None:
                continue
            bound = np.maximum(low - side[1], side[0] - high)
            open_ = bound <= _root(self.least[at], True)
            if open_.any():
                self._visit(side[2], at[open_], rows, visits)


def integers(column: pa.Array, scale: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their integer vectors) of a list column; ``size``: the only length that counts."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    usable = lengths == size
    if not size or not usable.any():
        return np.zeros(0, np.int64), np.zeros((0, size or 0), np.int64)
    values = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values * scale)
        good = (np.isfinite(x) & (np.abs(x) < LARGEST)).all(axis=1)
    return np.flatnonzero(usable)[good], x[good].astype(np.int64)


def _wide(*arrays: np.ndarray) -> bool:
    return any(len(a) and int(np.abs(a).max()) > WIDE for a in arrays)


def _parts(size: int, parts: int) -> list[slice]:
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(size), parts))]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def assign(vectors: np.ndarray, codebooks: list[np.ndarray], parts: list[slice], visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distance) of each vector and part."""
    codes = np.zeros((len(vectors), len(parts)), np.int64)
    wide = _wide(vectors, *codebooks)
    distances = np.zeros(codes.shape, object if wide else np.int64)
    for k, (book, s) in enumerate(zip(codebooks, parts, strict=True)):
        tree = VantageTree(book.astype(object) if wide else book)
        rows = vectors[:, s].astype(object) if wide else vectors[:, s]
        codes[:, k], distances[:, k] = tree.nearest(rows, visits)
    return codes, distances


def _start(src: DataFrame, entries: int, scale: int) -> np.ndarray:
    """The integer vectors of the smallest ids that are kept, in order of the ids."""
    usable = F.expr(f"v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) * {float(scale)}D >= {float(LARGEST)}D)")
    kept = src.where(usable & F.col("id").isNotNull())
    size = kept.agg(F.min(F.struct("id", "v")).alias("m")).select(F.size("m.v")).first()[0]
    if size is None or size < 1:
        return np.zeros((0, 0), np.int64)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i not in found or v < found[i]:
                    found[i] = v
            found = {i: found[i] for i in sorted(found)[:entries]}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), b.schema.field(0).type), pa.array(list(found.values()), b.schema.field(1).type)], names=["id", "v"])

    of_size = kept.where(F.size("v") == size).select("id", "v")
    rows = of_size.mapInArrow(smallest, of_size.schema).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    return np.array([[int(np.floor(np.float64(x) * scale)) for x in r["v"]] for r in rows], np.int64)


def _sums(src: DataFrame, codebooks: list[np.ndarray], parts: list[slice], scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (count, sums)} of one assignment. Tasks add up first; entries x dimensions rows are collected."""
    size = parts[-1].stop
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in codebooks]
        total = [np.zeros(b.shape, object) for b in codebooks]
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                _, x = integers(batch.column(0).slice(lo, _BATCH), scale, size)
                if not len(x):
                    continue
                codes, _ = assign(x, codebooks, parts)
                for k, s in enumerate(parts):
                    for e in np.unique(codes[:, k]).tolist():
                        mine = x[codes[:, k] == e, s]
                        n[k][e] += len(mine)
                        total[k][e] += (mine.astype(object) if _wide(mine) else mine).sum(axis=0)
        rows = [(k, e, i, int(n[k][e]), Decimal(int(t))) for k in range(len(parts)) for e in range(len(n[k])) if n[k][e] for i, t in enumerate(total[k][e])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    partial = src.select("v").mapInArrow(run, "part int, entry int, at int, n long, total decimal(38,0)")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in partial.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("part", "entry", "at").collect():
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["total"]))
    return out


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[list[np.ndarray], list[slice]]:
    """The final codebooks, one array (entry, component) for each part position, and the parts' places in a vector."""
    src = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"))
    first = _start(src, entries, scale)
    places = _parts(first.shape[1], parts)
    books = [first[:, s].copy() for s in places]
    for _ in range(rounds if len(first) else 0):
        for (k, e), (n, total) in _sums(src, books, places, scale).items():
            books[k][e] = [t // n for t in total]
    return books, places


def encode(vectors: DataFrame, codebooks: list[np.ndarray], places: list[slice], scale: int = 4096, embedding: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The kept rows with ``code`` (two hex digits for each part, in order) and ``error``, the squared distances in all (null beyond 64 bits)."""
    extra = [T.StructField(code, T.StringType(), False), T.StructField(error, T.LongType())]
    keep = [f.name for f in vectors.schema if f.name not in {code, error}]
    schema = T.StructType([*(vectors.schema[n] for n in keep), *extra])
    size = places[-1].stop if len(codebooks[0]) else 0
    digits = np.array([f"{i:02x}" for i in range(max(256, len(codebooks[0])))], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                part = batch.slice(lo, _BATCH)
                at, x = integers(part.column(1), scale, size)
                if not len(at):
                    continue
                codes, distances = assign(x, codebooks, places)
                row = part.column(0).take(pa.array(at))
                errors = [e if e < 1 << 63 else None for e in map(int, distances.sum(axis=1))]
                text = ["".join(r) for r in digits[codes].tolist()]
                yield pa.RecordBatch.from_arrays([*(row.field(n) for n in keep), pa.array(text, pa.string()), pa.array(errors, pa.int64())], names=[*keep, code, error])

    return nested(vectors, v=F.col(embedding)).mapInArrow(run, schema)


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in codebooks for row in book for x in row).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", total: str = "label_error") -> DataFrame:
    """``coded`` with the error summed over equal labels; rows without a label are one group; null beyond 64 bits. Labels are added up by task first."""
    rows = cut(nested(coded, key=F.col(label), e=F.col(error)))
    sums = cut(rows.groupBy("key").agg(F.when(F.count("*") == F.count("e"), F.sum(F.col("e").cast("decimal(38,0)")).try_cast("long")).alias("sum")).select(F.col("key").alias("other"), "sum"))
    on: Column = F.col("key").eqNullSafe(F.col("other"))
    if sums.count() <= BROADCAST_LABELS:
        joined = rows.join(F.broadcast(sums), on, "left")
    else:
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("own") == F.col("salt")), "left")
    return unnested(joined, **{total: F.col("sum")})
