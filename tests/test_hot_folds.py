"""Folds of hot keys against the fold in one task."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators import hot_folds
from weftline.operators import windows as W


def _fold(costs, capacity, full, used=0, batch=1):
    out = []
    for c in costs:
        if used > 0 and (used + c > capacity or used >= full):
            batch, used = batch + 1, 0
        used += c
        out.append(batch)
    return out, used, batch


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 60), st.floats(0.01, 1.0), st.integers(0, 90))
def test_block_function_is_the_fold(costs, capacity, fill, used):
    full = int(capacity * fill)
    want, left, batch = _fold(costs, capacity, full, used)
    c = np.array(costs)
    assert hot_folds.numbered(c, used, 1, capacity, full).tolist() == want
    piece = [p for p in hot_folds.block_function(c, capacity, full) if p[0] <= used][-1]
    assert (piece[1], used + piece[2] if piece[3] else piece[2]) == (batch - 1, left)


@pytest.fixture(scope="module")
def rows(spark):
    """One key of nine rows in ten, another that is null, small ones; costs of 0, without, large and small ones."""
    r = np.random.default_rng(7)
    out = []
    for i in range(6000):
        key = "hot" if i % 10 else [None, "a", "b"][i // 10 % 3]
        c = None if i % 97 == 5 else 0 if i % 31 == 3 else int(r.choice([1, 5, 40, 300, 2500], p=[0.05, 0.25, 0.3, 0.3, 0.1])) + int(r.integers(0, 4))
        out.append((key, i, c, bool(i % 7 == 0)))
    return spark.createDataFrame(out, "k string, i long, c long, may boolean")


def _same(a, b):
    assert a.dtypes == b.dtypes
    x, y = (sorted(map(str, d.collect())) for d in (a, b))
    assert x and x == y


@pytest.mark.parametrize("capacity", [1, 900, 100_000_000])
def test_batches(rows, capacity):
    _same(W.batches(rows, "k", ["i"], "c", "i", capacity, hot=150, block=500), W.batches(rows, "k", ["i"], "c", "i", capacity))


@pytest.mark.parametrize("limit", [-1, 0, 1, 2000, 30_011, 100_000_000])
def test_budget(rows, monkeypatch, limit):
    monkeypatch.setattr(hot_folds, "FEW", 20)
    _same(W.budget(rows, "k", ["i"], "c", "i", limit, hot=150, block=500), W.budget(rows, "k", ["i"], "c", "i", limit))


@pytest.mark.parametrize("limit", [1, 2000, 30_011, 100_000_000])
def test_pack(rows, monkeypatch, limit):
    monkeypatch.setattr(hot_folds, "FEW", 20)
    for least in (0, 100, 1_000_000):
        _same(W.pack(rows, "k", ["i"], "c", "i", limit, "may", least, hot=150, block=500), W.pack(rows, "k", ["i"], "c", "i", limit, "may", least))


def test_negative_costs_stay_in_one_task(spark):
    df = spark.createDataFrame([("x", i, -3 if i == 9 else 5) for i in range(50)], "k string, i long, c long")
    _same(W.batches(df, "k", ["i"], "c", "i", 12, hot=10, block=7), W.batches(df, "k", ["i"], "c", "i", 12))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, i long, c long, may boolean")
    assert W.batches(df, "k", ["i"], "c", "i", 12).count() == W.budget(df, "k", ["i"], "c", "i", 12).count() == W.pack(df, "k", ["i"], "c", "i", 12, "may").count() == 0
