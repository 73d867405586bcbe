"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, and no further in any projection. Vectors are projected to the leading
principal axes of a bounded sample, and to the length of what these leave out (which differs by no more either); they are
sorted by their grid cells of that size on the first axes and cut into sequence intervals of a fixed number of rows. Interval
pairs whose bounding boxes are within reach meet in one task each, which halves both intervals recursively and skips
sub-blocks, then rows, that are provably distant from the other block; what remains is compared by matrix products in single
precision, and all that come near the threshold again in double.

The axes only decide what is skipped: the links are exact. Where the leading axes hold little of the spread, boxes overlap,
little can be skipped, and the work grows with the square of the number of different vectors.

Equal vectors are one class from the start. Vectors that are null, empty, zero, hold a null or a non-finite component, or
have no id link with nothing; nor do vectors of different lengths. Rows that share an id are one vertex each time they link.
A cosine equal to the threshold links. An empty table gives an empty result. Other columns are not carried, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batch, cut
from weftline.llm.components import components

#: Rows of the sample for the axes, axes kept, rows of a sequence interval (a task holds two) and of the smallest block.
SAMPLE_ROWS, AXES, INTERVAL_ROWS, BLOCK_ROWS = 4096, 8, 8192, 512


def _axes(vectors: DataFrame) -> np.ndarray:
    """Principal axes (as columns) of a bounded sample, the rows of smallest hash, of the commonest length in it."""
    rows = [r[0] for r in vectors.select("v").orderBy(F.xxhash64("v"), "id").limit(SAMPLE_ROWS).collect()]
    if not rows:
        return np.zeros((0, AXES))
    size = max({len(r) for r in rows}, key=lambda n: sum(len(r) == n for r in rows))
    x = np.array([r for r in rows if len(r) == size], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(size, size))
    return axes[:, ::-1][:, :AXES]


def _project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, and in a last column the length of the rest."""
    out = np.zeros((len(x), AXES + 1))
    if x.shape[1] == len(axes):
        out[:, : axes.shape[1]] = x @ axes
        out[:, AXES] = np.sqrt(np.maximum(0, 1 - (out[:, :AXES] ** 2).sum(1)))
    return out


def _within(p: np.ndarray, box: np.ndarray, reach: float) -> np.ndarray:
    """The rows of p within reach of the bounding box of the rows of ``box``."""
    gap = np.maximum(0, np.maximum(p - box.max(0), box.min(0) - p))
    return np.flatnonzero((gap * gap).sum(1) <= reach * reach)


def _connect(least: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins what i and j are connected to; ``least`` holds for each vertex the smallest it is connected to."""
    while True:
        a, b = least[i], least[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least[:] = least[least]


def _unit(raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: rows, and their vectors scaled to length 1 in double precision."""
    sizes = np.array([len(r) // 4 for r in raw])
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        x = np.frombuffer(b"".join(raw[i] for i in rows), np.float32).reshape(len(rows), n).astype(float)
        out[int(n)] = rows, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _recurse(a: slice, b: slice, boxes, reach: float) -> Iterator[tuple[slice, slice]]:
    """Pairs of blocks of the intervals a and b whose boxes come within reach, halving the larger one each time."""
    p, q = boxes
    gap = np.maximum(0, np.maximum(p[a].min(0) - q[b].max(0), q[b].min(0) - p[a].max(0)))
    if gap @ gap > reach * reach:
        return
    na, nb = a.stop - a.start, b.stop - b.start
    if max(na, nb) <= BLOCK_ROWS:
        yield a, b
    elif na >= nb:
        m = a.start + na // 2
        yield from _recurse(slice(a.start, m), b, boxes, reach)
        yield from _recurse(slice(m, a.stop), b, boxes, reach)
    else:
        m = b.start + nb // 2
        yield from _recurse(a, slice(b.start, m), boxes, reach)
        yield from _recurse(a, slice(m, b.stop), boxes, reach)


def _compare(ids: np.ndarray, sizes: np.ndarray, side: np.ndarray, raw: list[bytes], axes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, linked vectors found here, smallest connected id) of the rows that link, of intervals 0 and 1 or of 0 with itself."""
    links = np.zeros(len(ids), np.int64)
    vertices, vertex = np.unique(ids, return_inverse=True)
    least = np.arange(len(vertices))
    alone = not (side == 1).any()
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    for rows, x in _unit(raw).values():
        p = _project(x, axes)
        first, second = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == (0 if alone else 1))
        if not len(first) or not len(second):
            continue
        low = x.astype(np.float32)
        for a, b in _recurse(slice(0, len(first)), slice(0, len(second)), (p[first], p[second]), reach):
            if alone and a.start > b.start:
                continue
            i, j = first[a], second[b]
            i, j = i[_within(p[i], p[j], reach)], j[_within(p[j], p[i], reach)]
            if not len(i) or not len(j):
                continue
            near = np.argwhere(low[i] @ low[j].T >= cosine - 1e-4)
            i, j = i[near[:, 0]], j[near[:, 1]]
            if alone:
                i, j = (k[i < j] for k in (i, j))
            exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            i, j = rows[i[exact >= cosine]], rows[j[exact >= cosine]]
            np.add.at(links, i, sizes[j])
            np.add.at(links, j, sizes[i])
            _connect(least, vertex[i], vertex[j])
    linked = np.flatnonzero(links)
    return ids[linked], links[linked], vertices[least[vertex[linked]]]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    classes = cut(rows.where(usable).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    axes = _axes(classes)
    cell = float(np.sqrt(max(1e-12, 2 - 2 * cosine)))
    packed = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("raw", pa.binary()), ("p", pa.list_(pa.float64()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                raw = [np.array(x, np.float32).tobytes() for x in s.column(0).to_pylist()]
                p = np.zeros((len(raw), AXES + 1))
                for i, x in _unit(raw).values():
                    p[i] = _project(x, axes)
                yield batch(packed, s.column(1), s.column(2), raw, p.tolist())

    points = classes.select("v", "id", "size").mapInArrow(project, "id long, size long, raw binary, p array<double>")
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.floor(F.col("p")[k] / cell) for k in range(3)] + [F.col("p")[0], F.col("id")]
    placed = pa.schema([*packed, ("part", pa.int32()), ("ord", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], schema=placed)
            n += b.num_rows

    spots = cut(points.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(place, "id long, size long, raw binary, p array<double>, part int, ord long"))
    # One row for each partition.
    starts = spots.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    ranked = spots.join(F.broadcast(starts), "part").select("id", "size", "raw", "p", F.floor((F.col("first") + F.col("ord")) / INTERVAL_ROWS).alias("block"))
    ends = [f(F.col("p")[k]).alias(f"{n}{k}") for k in range(AXES + 1) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = cut(ranked.groupBy("block").agg(*ends))
    # Boxes meet by an equi-join on the cells that the first axis' range reaches, then in all axes.
    reached = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long")))
    left = boxes.select("*", reached(F.col("lo0"), F.col("hi0")).alias("cell"))
    right = boxes.select(*[F.col(c).alias(f"r_{c}") for c in boxes.columns], reached(F.col("lo0") - cell, F.col("hi0") + cell).alias("cell"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"r_hi{k}"), F.col(f"r_lo{k}") - F.col(f"hi{k}")), 2) for k in range(AXES + 1)), F.lit(0.0))
    pairs = left.join(right, "cell").where((F.col("block") <= F.col("r_block")) & (gap <= cell * cell + 1e-6)).select(F.col("block").alias("i"), F.col("r_block").alias("j")).distinct()
    sides = pairs.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))).alias("s")).select("i", "j", "s.*")
    found = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        got = _compare(t["id"].to_numpy(), t["size"].to_numpy(), t["side"].to_numpy(), t["raw"].to_pylist(), axes, cosine)
        return pa.table([pa.array(x, pa.int64()) for x in got], schema=found)

    met = cut(ranked.select("id", "size", "raw", "block").join(sides, "block").groupBy("i", "j").applyInArrow(compare, "id long, links long, root long"))
    linked = met.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(met.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    by_class = classes.join(linked, "id", "left").join(comp, "id", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return (
        rows.withColumn("key", F.when(usable, F.col("v")))
        .join(by_class.withColumnRenamed("v", "key"), "key", "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"))
    )
