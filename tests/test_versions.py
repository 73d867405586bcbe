"""Versions of tables: refused second writers, untouched buckets, roll-back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import versions as V

SCHEMA = "k long, name string, v string, t long"


def _files(df):
    return set(df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def _rows(spark, root):
    return {(r["k"], r["name"]): (r["v"], r["t"]) for r in V.read(spark, root, "x").collect()}


def test_merges_are_upserts_of_touched_buckets(spark, tmp_path):
    r, root, want = random.Random(3), str(tmp_path / "s"), {}
    for n in range(4):
        rows = [(r.choice([None, *range(40)]), r.choice("ab"), f"{n}.{i}", r.randint(0, 9) + n) for i in range(60 if n == 0 else 4)]
        before = _files(V.read(spark, root, "x")) if n else set()
        assert V.merge(spark.createDataFrame(rows, SCHEMA), root, "x", ["k", "name"], "t", 16) == n + 1
        for k, name, v, t in rows:
            want[k, name] = max(want.get((k, name), (-1, 0, "")), (t, n, v))
        assert _rows(spark, root) == {key: (v, t) for key, (t, _, v) in want.items()}
        touched = {f"_weft_bucket={b}/" for (b,) in spark.createDataFrame(rows, SCHEMA).select(V.bucket(["k", "name"], 16)).collect()}
        assert {f for f in before if not any(b in f for b in touched)} == before & _files(V.read(spark, root, "x"))
    assert V.read(spark, root, "x", 1).count() <= 60 and V.current(spark, root)[0] == 4


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "s")
    one = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    V.publish({"x": one, "y": one}, root)
    V.merge(one.withColumn("t", F.lit(5).cast("long")), root, "x", ["k"], "t", expected=1)
    data = set(os.listdir(f"{root}/data"))
    for write in (lambda: V.merge(one, root, "x", ["k"], "t", expected=1), lambda: V.publish({"x": one}, root, expected=1)):
        with pytest.raises(V.Conflict):
            write()
    with pytest.raises(V.Conflict):
        V._point(spark, root, 2, {})
    assert set(os.listdir(f"{root}/data")) == data and V.current(spark, root)[0] == 2
    assert _rows(spark, root) == {(1, "a"): ("x", 5)} and V.read(spark, root, "y").count() == 1


def test_race_between_start_and_end(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    one = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    V.publish({"x": one}, root)
    begin = V._begin

    def late(*a):
        at = begin(*a)
        monkeypatch.setattr(V, "_begin", begin)
        V.publish({"x": one.withColumn("v", F.lit("first"))}, root)
        return at

    monkeypatch.setattr(V, "_begin", late)
    with pytest.raises(V.Conflict):
        V.merge(one.withColumn("v", F.lit("second")), root, "x", ["k"], "t")
    assert _rows(spark, root) == {(1, "a"): ("first", 1)}
    left = [f for d in os.listdir(f"{root}/data") for f in os.listdir(f"{root}/data/{d}")]
    assert len(left) == 2 and not [f for f in os.listdir(f"{root}/pointers") if f.startswith(".") and not f.endswith(".crc")]


def test_roll_back_and_edges(spark, tmp_path):
    root = str(tmp_path / "s")
    assert V.current(spark, root) == (0, {}) and V.read(spark, root, "x") is None
    one = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    with pytest.raises(Exception, match="boom"):
        V.publish({"x": one, "y": one.select(F.raise_error(F.lit("boom")).alias("b"))}, root)
    assert V.current(spark, root)[0] == 0 and not any(os.listdir(f"{root}/data/{d}") for d in os.listdir(f"{root}/data"))
    assert V.merge(one, root, "x", ["k"], "t", 4) == 1 and V.merge(one.limit(0), root, "x", ["k"], "t") == 1
    with pytest.raises(ValueError, match="kept by"):
        V.merge(one, root, "x", ["name"], "t")
