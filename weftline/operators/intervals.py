"""Joins of intervals within a key, ends included, by dyadic bins.

Two intervals meet if and only if one contains the other's start; of equal starts the first side counts as the container. An
interval falls into at most two aligned bins of each power of two that fits in it, which do not overlap; a point lies in one bin
of each power. So each pair meets in exactly one bin, a bin holds no pair that does not meet, and a key of any number of
intervals is spread over its bins. Bounds are whole numbers; rows where a bound or the key is null meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import checkpoints

#: Intervals of one key from which on it is joined by bins.
HOT_INTERVALS = 20_000


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def _powers(start: Column, end: Column) -> Column:
    """Bits of the length; 0 for an empty interval."""
    n = end - start + 1
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def bins(start: Column, end: Column) -> Column:
    """array<struct(power, bin)>: the bins that make up an interval."""
    s, e = start.cast("long"), end.cast("long")

    def of(p: Column) -> Column:
        low = _shift(s + F.call_function("shiftleft", F.lit(1).cast("long"), p) - 1, p)
        high = _shift(e + 1, p)
        some = low < high
        left = F.when(some & (low.bitwiseAND(F.lit(1)) == 1), F.struct(p.alias("power"), low.alias("bin")))
        right = F.when(some & (high.bitwiseAND(F.lit(1)) == 1), F.struct(p.alias("power"), (high - 1).alias("bin")))
        return F.array_compact(F.array(left, right))

    powers = _powers(s, e)
    return F.when(powers > 0, F.flatten(F.transform(F.sequence(F.lit(0), powers - 1), of)))


def bins_of_point(at: Column, powers: Column) -> Column:
    """array<struct(power, bin)>: the bins of the first ``powers`` powers in which a point lies."""
    x = at.cast("long")
    return F.when(powers > 0, F.transform(F.sequence(F.lit(0), powers - 1), lambda p: F.struct(p.alias("power"), _shift(x, p).alias("bin"))))


def _containing(a: DataFrame, b: DataFrame, on: str, start: Column, end: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(key, _bin, row of a) and (key, _bin, row of b), each with the bins of a's intervals and b's points."""
    most = a.agg(F.coalesce(F.max(_powers(start.cast("long"), end.cast("long"))), F.lit(0)).alias("_powers"))
    left = a.select(on, F.explode(bins(start, end)).alias("_bin"), F.struct(*a.columns).alias("_a"))
    right = b.join(F.broadcast(most)).select(on, F.explode(bins_of_point(at, F.col("_powers"))).alias("_bin"), F.struct(*b.columns).alias("_b"))
    return left, right


def _by_bins(a: DataFrame, b: DataFrame, on: str, start: str, end: str, other_start: str, other_end: str) -> DataFrame:
    l1, r1 = _containing(a, b, on, F.col(start), F.col(end), F.col(other_start))
    l2, r2 = _containing(b, a, on, F.col(other_start) + 1, F.col(other_end), F.col(start))
    first = l1.join(r1, [on, "_bin"]).select(on, "_a", "_b")
    return first.unionByName(l2.join(r2, [on, "_bin"]).select(on, F.col("_b").alias("_a"), F.col("_a").alias("_b")))


def overlap(a: DataFrame, b: DataFrame, on: str, start: str, end: str, other_start: str, other_end: str, hot: int = HOT_INTERVALS) -> DataFrame:
    """JN-08: pairs of equal key whose intervals meet. Keys of more than ``hot`` intervals of ``b`` go by bins, others by the key alone. Intervals that end before they start meet what their bounds say. Columns of one name stand twice, as in any join."""
    keys = checkpoints.cut(b.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(on))
    if keys.isEmpty():
        return a.join(b, on).where((F.col(other_start) <= F.col(end)) & (F.col(other_end) >= F.col(start)))
    few = a.join(keys, on, "left_anti").select(on, F.struct(*a.columns).alias("_a")).join(b.join(keys, on, "left_anti").select(on, F.struct(*b.columns).alias("_b")), on)
    some = _by_bins(a.join(keys, on, "left_semi"), b.join(keys, on, "left_semi"), on, start, end, other_start, other_end)
    met = few.unionByName(some).where((F.col(f"_b.{other_start}") <= F.col(f"_a.{end}")) & (F.col(f"_b.{other_end}") >= F.col(f"_a.{start}")))
    return met.select(on, *[F.col(f"_a.{c}").alias(c) for c in a.columns if c != on], *[F.col(f"_b.{c}").alias(c) for c in b.columns if c != on])


def _first_by_sweep(a: DataFrame, b: DataFrame, on: str, start: str, end: str, other_start: str, other_end: str, order: list[str], value: str, kinds: dict[str, Column]) -> DataFrame:
    """``first_overlap`` where the order begins with the start.

    Of the rows of ``b`` that end at ``start`` or later the first in order meets the row of ``a``, or none does. So rows of both
    sides stand by key and falling place, each range in one task, and take the running minimum; what it was at a range's
    beginning comes from the ranges before it, for the keys that stand in more than one. Rows are neither paired nor multiplied.
    """
    spark, names = a.sparkSession, [f"_k{i}" for i in range(len(kinds))]
    row = F.struct(*a.columns)
    able = F.col(on).isNotNull() & F.coalesce(F.col(start) <= F.col(end), F.lit(False))
    spots = a.where(able).select(on, F.col(start).alias("_at"), F.lit(1).alias("_side"), row.alias("_a"))
    other = [F.when(k, F.struct(*order, F.col(value).alias("_value"))).alias(n) for n, k in zip(names, kinds.values(), strict=True)]
    marks = b.where(F.col(on).isNotNull() & (F.col(other_start) <= F.col(other_end))).select(on, F.col(other_end).alias("_at"), F.lit(0).alias("_side"), *other)
    by = [F.col(on), F.col("_at").desc(), F.col("_side")]
    both = spots.unionByName(marks, allowMissingColumns=True).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    path = checkpoints.new_folder(spark, "sweep")
    both.write.parquet(path)
    placed = spark.read.schema(both.schema).parquet(path)
    parts = placed.groupBy("_part", on).agg(*[F.min(n).alias(n) for n in names])
    before = Window.partitionBy(on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most two rows a range.
    come = parts.withColumn("_parts", F.count("*").over(Window.partitionBy(on))).where("_parts > 1").select("_part", on, *[F.min(n).over(before).alias(f"{n}_") for n in names])
    upto = Window.partitionBy("_part", on).orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = placed.select("_part", on, "_side", "_a", *[F.min(n).over(upto).alias(n) for n in names]).where("_side = 1")
    least = swept.join(F.broadcast(come), ["_part", on], "left").select("_a", *[F.least(n, f"{n}_").alias(n) for n in names])
    met = least.select("_a.*", *[F.when(F.col(f"{n}.{order[0]}") <= F.col(f"_a.{end}"), F.col(f"{n}._value")).alias(name) for n, name in zip(names, kinds, strict=True)])
    none = [F.lit(None).cast(b.schema[value].dataType).alias(name) for name in kinds]
    return met.unionByName(a.where(~able).select("*", *none))


def first_overlap(a: DataFrame, b: DataFrame, on: str, ids: list[str], start: str, end: str, other_start: str, other_end: str, order: list[str], value: str, kinds: dict[str, Column]) -> DataFrame:
    """JN-08: each row of ``a`` with, for each name of ``kinds``, the ``value`` of the first row of ``b`` in ``order`` that meets it and the condition, else null. ``ids`` tell rows of ``a`` apart within a key. Intervals that end before they start meet nothing.

    No pair is built: where ``order`` begins with the start, both sides are swept once; else a bin keeps its first row of each kind, and a row of ``a`` takes the first of its bins.
    """
    if order[0] == other_start:
        return _first_by_sweep(a, b, on, start, end, other_start, other_end, order, value, kinds)
    best = [F.min(F.when(k, F.struct(*order, F.col(value).alias("_value")))).alias(f"_k{i}") for i, k in enumerate(kinds.values())]
    found, rest = None, a
    a, b = a.where(F.col(start) <= F.col(end)), b.where(F.col(other_start) <= F.col(other_end))
    points, inside = _containing(a, b, on, F.col(start), F.col(end), F.col(other_start)), _containing(b, a, on, F.col(other_start) + 1, F.col(other_end), F.col(start))
    for rows, others, left, right in [(*points, "_a", "_b"), (inside[1], inside[0], "_b", "_a")]:
        firsts = others.select(on, "_bin", *[F.col(f"{right}.{c}").alias(c) for c in b.columns if c != on])
        hits = rows.select(on, "_bin", *[F.col(f"{left}.{c}").alias(c) for c in ids]).join(firsts.groupBy(on, "_bin").agg(*best), [on, "_bin"]).drop("_bin")
        found = hits if found is None else found.unionByName(hits)
    each = found.groupBy(on, *ids).agg(*[F.min(f"_k{i}").alias(f"_k{i}") for i in range(len(kinds))])
    return rest.join(each, [on, *ids], "left").select(*rest.columns, *[F.col(f"_k{i}._value").alias(name) for i, name in enumerate(kinds)])
