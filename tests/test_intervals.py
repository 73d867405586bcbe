"""Interval joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import intervals

A, B = "f string, s long, e long, x long", "f string, s2 long, e2 long, x long, kind string"


@pytest.fixture(scope="module")
def sides():
    """One key of most rows; lengths from one to very long; bounds below zero, reversed, null; repeated rows."""
    r = random.Random(5)

    def one(i: int) -> tuple:
        s = r.randint(-300, 3000)
        e = s + r.choice([0, 0, 1, 3, 17, 64, 900]) - (5 if i % 50 == 3 else 0)
        return r.choice(["hot"] * 8 + ["a", None]), None if i % 41 == 7 else s, None if i % 43 == 9 else e

    a = [(*one(i), i) for i in range(300)]
    b = [(*one(i), i, r.choice(["class", "method", "field"])) for i in range(400)]
    return a + a[:10], b + b[:10]


def _meet(x, y):
    return None not in (x[0], x[1], x[2], y[1], y[2]) and x[0] == y[0] and y[1] <= x[2] and y[2] >= x[1]


@pytest.mark.parametrize("hot", [1, 30, 10**9])
def test_overlap_is_all_pairs_that_meet(spark, sides, hot):
    a, b = sides
    got = intervals.overlap(spark.createDataFrame(a, A), spark.createDataFrame(b, B), "f", "s", "e", "s2", "e2", hot)
    assert sorted(map(tuple, got.collect())) == sorted((*x, *y[1:]) for x in a for y in b if _meet(x, y))


def test_first_overlap_by_kind(spark, sides):
    a, b = sides
    kinds = {"owner": F.col("kind") == "class", "callable": F.col("kind") == "method"}
    got = intervals.first_overlap(spark.createDataFrame(a, A), spark.createDataFrame(b, B).withColumnRenamed("x", "y"), "f", ["x"], "s", "e", "s2", "e2", ["s2", "y"], "y", kinds)
    want = []
    for x in a:
        met = sorted((y[1], y[3], y[4]) for y in b if _meet(x, y) and x[1] <= x[2] and y[1] <= y[2])
        want.append((*x, *(next((m[1] for m in met if m[2] == k), None) for k in ("class", "method"))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_sides(spark):
    a, b = spark.createDataFrame([], A), spark.createDataFrame([], B).withColumnRenamed("x", "y")
    assert intervals.overlap(a, b, "f", "s", "e", "s2", "e2", 0).count() == 0
    one = spark.createDataFrame([("f", 1, 2, 3)], A)
    assert intervals.first_overlap(one, b, "f", ["x"], "s", "e", "s2", "e2", ["s2"], "y", {"k": F.lit(True)}).first()["k"] is None


def test_bins_make_up_the_interval(spark):
    rows = spark.createDataFrame([(s, e) for s in range(-9, 10) for e in range(s, 20)], "s long, e long")
    for s, e, bins in rows.select("s", "e", intervals.bins(F.col("s"), F.col("e"))).collect():
        assert sorted(v for p, b in bins for v in range(b << p, (b + 1) << p)) == list(range(s, e + 1))


@pytest.mark.parametrize("order", [["s2", "y"], ["y"]])
def test_first_overlap_over_many_ranges(spark, monkeypatch, order):
    """One key over all ranges, others in one; rows stay as many as they are where the order begins with the start."""
    r = random.Random(5)
    a = [(f, s, s + r.randrange(-1, 40), i) for i in range(400) for f in (r.choice("uuuvw"),) for s in (r.randrange(2000),)] + [(None, 1, 2, 900), ("u", None, 5, 901)]
    b = [(f, s, s + r.randrange(-1, 60), i, r.choice(["p", "q"])) for i in range(300) for f in (r.choice("uuuv"),) for s in (r.randrange(2000),)]
    df, other = spark.createDataFrame(a, "f string, s long, e long, x int"), spark.createDataFrame(b, "f string, s2 long, e2 long, y int, kind string")
    if order[0] == "s2":
        monkeypatch.setattr(intervals, "bins", None)
    got = intervals.first_overlap(df, other, "f", ["x"], "s", "e", "s2", "e2", order, "y", {"p": F.col("kind") == "p", "q": F.col("kind") == "q"})
    want = []
    for f, s, e, x in a:
        met = sorted(((y[1], y[3]) if order[0] == "s2" else (y[3],), y[3], y[4]) for y in b if f == y[0] and s is not None and s <= e and y[1] <= y[2] and y[1] <= e and y[2] >= s)
        want.append((f, s, e, x, *(next((m[1] for m in met if m[2] == k), None) for k in "pq")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
