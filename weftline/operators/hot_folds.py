"""Ordered folds of keys that hold too many rows for one task.

The rows of such keys are dealt out by range of (key, order), so that a key spans many tasks, sorted where they land and kept.

- Batches: a block, the rows of a key in one task, is a function from the tokens that the open batch brings to those that it
  leaves and to the number of batches begun in between. The next start of every row comes from prefix sums, a chain's count
  and last start by pointer jumping. The function is constant on ranges, most of which chains that merge make one; one task a
  key applies the blocks' functions in order and reads nothing else, then each block numbers its rows.
- Budgets: what remains only falls. Up to the first row that overflows everything is taken; after it, only rows that cost no
  more than what remains can matter. A few rounds of that, each a sum by block and a search in one block, leave the rows that
  a fold in order needs to see: at most ``limit`` taken ones, one for each round, and the last round's candidates.

Costs must not be negative; keys that have such a cost are folded in one task (``hot_keys`` leaves them out). Rows alike in
key, order, id and cost can't be told apart and stay in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import checkpoints

#: Rows from which on a key is hot, rows of a block, rounds, and candidates of all keys at which no further round is worth its jobs.
HOT_ROWS, BLOCK_ROWS, ROUNDS, FEW = 4_000_000, 250_000, 16, 100_000


def hot_keys(df: DataFrame, key: str, cost: str, hot: int) -> DataFrame | None:
    """(key, n): keys of more rows than ``hot`` and without a negative cost; None if there is none. One aggregation."""
    found = checkpoints.cut(df.groupBy(key).agg(F.count("*").alias("_n"), F.min(cost).alias("_least")).where((F.col("_n") > hot) & (F.coalesce("_least", F.lit(0)) >= 0)).select(key, "_n"))
    return None if found.isEmpty() else found


def split(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the keys, and all others; null is a key like any other."""
    k = keys.select(F.col(key).alias("_hot"))
    same = df[key].eqNullSafe(k["_hot"])
    return df.join(k, same, "left_semi"), df.join(k, same, "left_anti")


def placed(df: DataFrame, key: str, order: list[str], n_rows: int, block: int) -> DataFrame:
    """The rows in ranges of (key, order), kept: ``_m`` rises along the order, ``_part`` names the task."""
    parts = max(1, -(-n_rows // block))
    by = [F.col(c) for c in [key, *order]]
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    return checkpoints.cut(rows.withColumn("_part", F.shiftright("_m", 33)))


def next_starts(p: np.ndarray, base: np.ndarray, capacity: int, full: int) -> np.ndarray:
    """The first row that begins a new batch, where the open one began at prefix sum ``base``; len(p) - 1 or more: none here."""
    filled = np.minimum(np.searchsorted(p, base + capacity, "right") - 1, np.searchsorted(p, base + full, "left"))
    return np.maximum(np.searchsorted(p, base, "right"), filled)


def block_function(cost: np.ndarray, capacity: int, full: int) -> list[tuple[int, int, int, bool]]:
    """(from, starts, used, carried) in order: what the open batch brings from ``from`` on begins so many batches and leaves ``used``, after what it brought if ``carried``."""
    n = len(cost)
    p = np.concatenate([[0], np.cumsum(cost)])
    count, last, after = np.ones(n, np.int64), np.arange(n), np.minimum(next_starts(p, p[:n], capacity, full), n)
    while (on := np.flatnonzero(after < n)).size:
        to = after[on]
        count[on], last[on], after[on] = count[on] + count[to], last[to], after[to]
    top = max(full, 1)
    lead = p[: np.searchsorted(p, capacity + 1, "right") + 1]
    at = np.unique(np.concatenate([[0, 1, top], capacity - lead + 1, full - lead]))
    at = at[(at >= 0) & (at <= top)]
    first = next_starts(p, -at, capacity, full)
    out: list[tuple[int, int, int, bool]] = []
    for u, j in zip(at.tolist(), first.tolist(), strict=True):
        piece = (0, int(p[n]), True) if j >= n else (int(count[j]), int(p[n] - p[last[j]]), False)
        if not out or out[-1][1:] != piece:
            out.append((u, *piece))
    return out


def numbered(cost: np.ndarray, used: int, batch: int, capacity: int, full: int) -> np.ndarray:
    """The batch of every row of a block that begins with so much used of batch ``batch``."""
    n = len(cost)
    p = np.concatenate([[0], np.cumsum(cost)])
    after = next_starts(p, p[:n], capacity, full)
    begins = np.zeros(n, np.int64)
    j = int(next_starts(p, np.array([-used]), capacity, full)[0])
    while j < n:
        begins[j] = 1
        j = int(after[j])
    return batch + np.cumsum(begins)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one task, key after key (column ``_key``, with ``_run`` its number in the task)."""
    got = list(batches)
    if not got:
        return
    table = pa.Table.from_batches(got)
    keys = table.column("_key").to_pylist()
    ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
    for a, b in zip([0, *ends], [*ends, len(keys)], strict=True):
        if b > a:
            yield table.slice(a, b - a)


def batches(rows: DataFrame, key: str, order: list[str], ids: str, n_rows: int, capacity: int, full: int, block: int, folded: Callable) -> DataFrame:
    """WIN-09 over the rows of hot keys, with their costs in ``_cost``: (key, id, batch_no)."""
    t = placed(rows, key, order, n_rows, block)
    kind = t.schema[key].dataType.simpleString()

    def cost_of(x: pa.Table) -> np.ndarray:
        return x.column("_cost").fill_null(0).to_numpy()

    def functions(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(b):
            got = block_function(cost_of(x), capacity, full)
            cols = [x.column("_key").slice(0, 1).combine_chunks().take(pa.array([0] * len(got))), pa.array([x.column("_part")[0].as_py()] * len(got), pa.int64())]
            cols += [pa.array([g[i] for g in got], ty) for i, ty in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays(cols, names=["_key", "_part", "_from", "_starts", "_used", "_carried"])

    pieces = t.select(F.col(key).alias("_key"), "_part", "_cost").mapInArrow(functions, f"_key {kind}, _part long, _from long, _starts long, _used long, _carried boolean")

    def fresh() -> Callable:
        now = then = (0, 1)

        def step(_: object, start: int, starts: int, used: int, carried: bool) -> tuple | None:
            nonlocal now, then
            begins = start == 0
            if begins:
                now = then
            if start <= now[0]:
                then = (now[0] + used if carried else used, now[1] + starts)
            return now if begins else None

        return step

    entries = checkpoints.cut(folded(pieces, "_key", ["_part", "_from"], ["_part", "_from", "_starts", "_used", "_carried"], fresh, "_in long, _batch long"))
    e = entries.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_in", "_batch")

    def number(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(b):
            no = numbered(cost_of(x), x.column("_in")[0].as_py(), x.column("_batch")[0].as_py(), capacity, full)
            yield from pa.Table.from_arrays([x.column("_key"), x.column("_id"), pa.array(no, pa.int32())], names=[key, ids, "batch_no"]).to_batches()

    # One entry a block: as many rows as tasks and hot keys together. A broadcast join leaves the rows where and as they lie.
    src = t.join(F.broadcast(e), t[key].eqNullSafe(e["_k"]) & (t["_part"] == e["_p"])).select(t[key].alias("_key"), t[ids].alias("_id"), "_cost", "_part", "_in", "_batch")
    return src.mapInArrow(number, f"{key} {kind}, {ids} {t.schema[ids].dataType.simpleString()}, batch_no int")


def relevant(t: DataFrame, key: str, start: DataFrame, may: Column, least: int) -> DataFrame:
    """The rows with a cost that a budget's fold has to see, of ``t`` (placed, ``_cost``), from ``start``: (key, _after, _left) where each key begins and what it has left."""
    t = t.withColumn("_may", F.coalesce(may, F.lit(False)))
    state, seen = checkpoints.cut(start.select(F.col(key).alias("_k"), "_after", "_left")), None

    def candidates(s: DataFrame) -> DataFrame:
        fits = (F.col("_cost") <= F.col("_left")) | (F.col("_may") & (F.col("_left") > least))
        return t.join(F.broadcast(s), t[key].eqNullSafe(s["_k"])).where((F.col("_m") > F.col("_after")) & (F.col("_cost") > 0) & (F.col("_left") > 0) & fits)

    for _ in range(ROUNDS):
        sums = checkpoints.cut(candidates(state).groupBy("_k", "_part").agg(F.sum("_cost").alias("_sum"), F.count("*").alias("_n"), F.first("_left").alias("_left")))
        if (sums.agg(F.sum("_n")).first()[0] or 0) <= FEW:
            break
        # One row a block: the first in which a key's sum passes what is left.
        upto = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        over = sums.withColumn("_upto", F.sum("_sum").over(upto)).where(F.col("_upto") > F.col("_left")).groupBy("_k").agg(F.min_by(F.struct("_part", (F.col("_upto") - F.col("_sum")).alias("_before")), "_part").alias("_at"))
        over = over.select(F.col("_k").alias("_ok"), "_at.*").withColumnRenamed("_part", "_op")
        c = candidates(state)
        inside = c.join(F.broadcast(over), c["_k"].eqNullSafe(over["_ok"]) & (c["_part"] == over["_op"])).withColumn("_upto", F.col("_before") + F.sum("_cost").over(Window.partitionBy("_k").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)))
        passed = inside.where(F.col("_upto") > F.col("_left")).groupBy("_k").agg(F.min_by(F.struct("_m", (F.col("_left") - F.col("_upto") + F.col("_cost")).alias("_rest"), "_may"), "_m").alias("_x")).select(F.col("_k").alias("_xk"), "_x.*").withColumnsRenamed({"_m": "_xm", "_may": "_xmay"})
        nxt = checkpoints.cut(state.join(passed, state["_k"].eqNullSafe(passed["_xk"]), "left"))
        ranges = nxt.select("_k", "_after", "_left", F.coalesce("_xm", F.lit(2**63 - 1)).alias("_upto_m"))
        seen = ranges if seen is None else seen.unionByName(ranges)
        cut = F.col("_xmay") & (F.col("_rest") > least)
        state = checkpoints.cut(nxt.select("_k", F.coalesce("_xm", F.lit(2**63 - 1)).alias("_after"), F.when(cut, 0).otherwise(F.coalesce("_rest", F.lit(0))).cast("long").alias("_left")))
    tail = state.select("_k", "_after", "_left", F.lit(2**63 - 1).alias("_upto_m"))
    seen = tail if seen is None else seen.unionByName(tail)
    return candidates(seen).where(F.col("_m") <= F.col("_upto_m")).drop("_k", "_after", "_left", "_upto_m", "_may")
