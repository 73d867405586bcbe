"""Windows and ordered folds.

Greedy folds are not associative: the rows of a key stream in order through one task, which holds one batch and a few numbers.
Keys of more rows than ``hot`` are spread over tasks instead (``hot_folds``), with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import checkpoints, graph, hot_folds


def top_and_rest(df: DataFrame, key: str, order: list[Column], k: int = 3, least: int = 3) -> DataFrame:
    """WIN-03: the first k of each group stand alone, the others share a bucket; a group of up to ``least`` rows is one bucket."""
    w = Window.partitionBy(key)
    ranked = df.withColumns({"_rank": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return ranked.withColumn("bucket", F.when(F.col("_n") <= least, 0).when(F.col("_rank") <= k, F.col("_rank")).otherwise(k + 1)).drop("_rank", "_n")


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """WIN-04: the last n rows of each group; ``order`` is from the last on."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def before_last(df: DataFrame, key: str, order: str, condition: Column, inclusive: bool = False) -> DataFrame:
    """WIN-05: rows before the last one that meets the condition; none if none does. The place is aggregated, then joined."""
    at = df.where(condition).groupBy(key).agg(F.max(order).alias("_at"))
    return df.join(at, key).where(F.col(order) <= F.col("_at") if inclusive else F.col(order) < F.col("_at")).drop("_at")


def numbered_duplicates(df: DataFrame, name: str, order: list[Column], out: str, left: str = " (", right: str = ")") -> DataFrame:
    """WIN-06: from its second occurrence on, whatever the case, a name carries its number."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(name), F.lit(left), n.cast("string"), F.lit(right))).otherwise(F.col(name)))


def folded(df: DataFrame, key: str, order: list[str], columns: list[str], fresh: Callable[[], Callable], out: str) -> DataFrame:
    """Rows of each key in order through a function of its own that ``fresh`` makes: from the values of ``columns`` to the result's values after key and id, or None for no row."""
    src = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    src = src.repartition("_key").sortWithinPartitions("_key", *[f"_o{i}" for i in range(len(order))]).select("_key", *[f"_c{i}" for i in range(len(columns))])
    schema = f"{key} {src.schema['_key'].dataType.simpleString()}, {columns[0]} {src.schema['_c0'].dataType.simpleString()}, {out}"
    names = [key, columns[0], *[x.split()[0] for x in out.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            rows: list[tuple[int, tuple]] = []
            for i, (k, *values) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if step is None or k != now:
                    now, step = k, fresh()
                got = step(*values)
                if got is not None:
                    rows.append((i, got))
            at = pa.array([i for i, _ in rows], pa.int64())
            results = [pa.array([g[n] for _, g in rows], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]]) for n, x in enumerate(out.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *results], names=names)

    return src.mapInArrow(run, schema)


def _hot(df: DataFrame, key: str, cost: str, hot: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows to fold key by key, rows of hot keys or None, their number); costs are longs in ``_cost``."""
    rows = df.withColumn("_cost", F.col(cost).cast("long"))
    keys = hot_folds.hot_keys(rows, key, "_cost", hot)
    if keys is None:
        return rows, None, 0
    large, small = hot_folds.split(rows, key, keys)
    return small, large, keys.agg(F.sum("_n")).first()[0]


def _budget_step(limit: int) -> Callable:
    def fresh() -> Callable:
        used = n = 0

        def step(_: object, c: int | None) -> tuple | None:
            nonlocal used, n
            if n and (c is None or used + c > limit):
                return None
            used, n = used + (c or 0), n + 1
            return (n - 1,)

        return step

    return fresh


def budget(df: DataFrame, key: str, order: list[str], cost: str, ids: str, limit: int, hot: int = hot_folds.HOT_ROWS, block: int = hot_folds.BLOCK_ROWS) -> DataFrame:
    """WIN-07: greedy budget that skips what does not fit and goes on; the first item is always kept. One row a kept item: key, id, position."""
    small, large, n = _hot(df, key, cost, hot)
    by = [*order, ids, "_cost"]
    out = folded(small, key, by, [ids, "_cost"], _budget_step(limit), "position int").select(key, "position", ids)
    if large is None:
        return out
    t = hot_folds.placed(large, key, by, n, block)
    first = checkpoints.cut(t.groupBy(key).agg(F.min_by(F.struct("_m", F.coalesce("_cost", F.lit(0)).alias("_c")), "_m").alias("_f")).select(key, F.col("_f._m").alias("_after"), (F.lit(limit) - F.col("_f._c")).alias("_left")))
    f = first.select(F.col(key).alias("_fk"), F.col("_after").alias("_first"), F.col("_left").alias("_second_left"))
    t1 = t.join(F.broadcast(f), t[key].eqNullSafe(f["_fk"])).drop("_fk")
    see = t1.where("_m = _first").select(key, "_m", "_cost").unionByName(hot_folds.relevant(t, key, first, F.lit(False), 0).select(key, "_m", "_cost"))
    taken = folded(see, key, ["_m"], ["_m", "_cost"], _budget_step(limit), "position int").select(F.col("_m").alias("_tm"))
    # Items that cost nothing are kept wherever they stand, unless the first overran the limit.
    free = (F.col("_cost") == 0) & (F.col("_m") > F.col("_first")) & (F.col("_second_left") >= 0)
    kept = checkpoints.cut(t1.join(taken, F.col("_m") == F.col("_tm"), "left").where(F.col("_tm").isNotNull() | free).select(key, ids, "_m", "_part"))
    parts = kept.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = parts.select(F.col(key).alias("_bk"), F.col("_part").alias("_bp"), (F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_m"))
    kept = kept.join(F.broadcast(before), kept[key].eqNullSafe(before["_bk"]) & (kept["_part"] == before["_bp"])).withColumn("position", (F.col("_before") + inside - 1).cast("int"))
    return out.unionByName(kept.select(key, "position", ids))


def pack(df: DataFrame, key: str, order: list[str], cost: str, ids: str, limit: int, may_cut: str, least: int = 100, hot: int = hot_folds.HOT_ROWS, block: int = hot_folds.BLOCK_ROWS) -> DataFrame:
    """WIN-08: (id, action, tokens): taken if it fits, cut if that is allowed and over ``least`` remains, else dropped; once nothing remains, the fold ends. An item without a cost is dropped."""

    def fresh() -> Callable:
        left = limit

        def step(_: object, c: int | None, may: bool) -> tuple | None:
            nonlocal left
            if left <= 0:
                return None
            if c is None:
                return "dropped", 0
            action, used = ("taken", c) if c <= left else ("cut", left) if may and left > least else ("dropped", 0)
            left -= used
            return action, used

        return step

    small, large, n = _hot(df, key, cost, hot)
    by = [*order, ids, "_cost"]
    out = folded(small, key, by, [ids, "_cost", may_cut], fresh, "action string, tokens long")
    if large is None:
        return out
    t = hot_folds.placed(large, key, by, n, block)
    start = t.select(key).distinct().select(key, F.lit(-1).cast("long").alias("_after"), F.lit(limit).cast("long").alias("_left"))
    see = hot_folds.relevant(t, key, start, F.col(may_cut), least)
    done = checkpoints.cut(folded(see, key, ["_m"], ["_m", "_cost", may_cut], fresh, "action string, tokens long").where("tokens > 0"))
    end = done.groupBy(key).agg(F.sum("tokens").alias("_sum"), F.max("_m").alias("_end")).where(F.col("_sum") >= limit).select(F.col(key).alias("_ek"), "_end")
    d = done.select(F.col("_m").alias("_dm"), "action", "tokens")
    rows = t.join(F.broadcast(end), t[key].eqNullSafe(end["_ek"]), "left").where(F.coalesce(F.col("_m") <= F.col("_end"), F.lit(limit > 0))).join(d, F.col("_m") == F.col("_dm"), "left")
    action = F.coalesce("action", F.when(F.col("_cost") == 0, "taken"), F.lit("dropped"))
    return out.unionByName(rows.select(key, ids, action.alias("action"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))


def batches(df: DataFrame, key: str, order: list[str], cost: str, ids: str, capacity: int, fill: float = 0.8, hot: int = hot_folds.HOT_ROWS, block: int = hot_folds.BLOCK_ROWS) -> DataFrame:
    """WIN-09, UDF-05: (id, batch_no): a new batch starts where the next item would overflow, or once ``fill`` of the capacity is used. ``cost`` names any column: an estimator is an expression of the caller. An item without a cost counts as 0."""
    full = int(capacity * fill)

    def fresh() -> Callable:
        batch, used = 1, 0

        def step(_: object, c: int | None) -> tuple:
            nonlocal batch, used
            c = c or 0
            if used > 0 and (used + c > capacity or used >= full):
                batch, used = batch + 1, 0
            used += c
            return (batch,)

        return step

    small, large, n = _hot(df, key, cost, hot)
    by = [*order, ids, "_cost"]
    out = folded(small, key, by, [ids, "_cost"], fresh, "batch_no int")
    return out if large is None else out.unionByName(hot_folds.batches(large, key, by, ids, n, capacity, full, block, folded))


def assigned(modules: DataFrame, entries: DataFrame, module: str, path: str, score: str, each: int = 2, most: int = 30) -> DataFrame:
    """WIN-15: (worker, modules, key_files, n_files): every ``each`` modules in order of name are one worker's, with the files of highest score."""
    placed = graph.ranked(modules.select(module).distinct(), [F.col(module)], "_at").withColumn("worker", F.floor((F.col("_at") - 1) / each).cast("int") + 1)
    files = entries.join(placed.select(module, "worker"), module)
    ranked = ordinal(files, ["worker"], [F.col(score).desc(), F.col(path)], "_rank")
    lists = ranked.groupBy("worker").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, F.struct("_rank", path)))), lambda x: x[path]).alias("key_files"), F.count("*").alias("n_files"))
    names = placed.groupBy("worker").agg(F.array_sort(F.collect_set(module)).alias("modules"))
    return names.join(lists, "worker", "left").select("worker", "modules", F.coalesce("key_files", F.array().cast("array<string>")).alias("key_files"), F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


def fixed_batches(df: DataFrame, key: str, order: list[Column], size: int, out: str = "batch_no") -> DataFrame:
    """WIN-11: every ``size`` rows of a group are a batch."""
    return df.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))


def superseded(df: DataFrame, keys: list[str], order: list[Column], out: str = "is_latest") -> DataFrame:
    """WIN-12: whether a row is the last of its group; ``order`` is from the last on."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def prefix_within(df: DataFrame, key: str, order: list[Column], cost: Column, limit: int) -> DataFrame:
    """WIN-13: rows up to the first that overflows the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(cost).over(w)).where(F.col("_sum") <= limit).drop("_sum")


def cap(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """WIN-14: the first n rows of each group."""
    return last_n(df, key, order, n)


def ordinal(df: DataFrame, keys: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """WIN-16: position within a group, from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def merge_least(df: DataFrame, section: str, order: list[Column], low: Column, target: int) -> DataFrame:
    """WIN-17: pages of low importance give way, section by section, until no more than ``target`` pages remain.

    Section s may merge as many as still have to go after the sections before it: a running sum, no loop. Merged pages of a
    section share the bucket 0, which counts as a page; others have a bucket each.
    """
    flagged = df.withColumns({"_low": F.coalesce(low, F.lit(False))})
    ranked = flagged.withColumn("_k", F.when(F.col("_low"), F.row_number().over(Window.partitionBy(section, "_low").orderBy(*order))))
    sizes = ranked.groupBy(section).agg(F.count("*").alias("_n"), F.count_if("_low").alias("_l")).withColumn("_save", F.greatest(F.lit(0), F.col("_l") - 1))
    saved = graph.running_total(sizes, [F.col(section)], "_save", "_before")
    total = saved.agg(F.sum("_n").alias("_total"))
    quota = saved.join(F.broadcast(total)).select(section, F.greatest(F.lit(0), F.least(F.col("_save"), F.col("_total") - target - F.col("_before"))).alias("_quota"))
    merged = F.col("_low") & (F.col("_quota") > 0) & (F.col("_k") <= F.col("_quota") + 1)
    return ranked.join(quota, section).withColumn("bucket", F.when(merged, 0).otherwise(F.row_number().over(Window.partitionBy(section).orderBy(*order)))).drop("_low", "_k", "_quota")
