"""Captures as a stream: growing files, restarts, partitions inside lines."""

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from weftline.sources import captures, files
from weftline.streaming import tasks


def test_spans_read_every_line_once(tmp_path):
    r = random.Random(4)
    for n in range(30):
        lines = ["".join(r.choice("aé日\r ") for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(r.randint(0, 30))]
        body = "".join(x + "\n" for x in lines).encode() + b"half a li"
        (tmp_path / "c").write_bytes(body)
        reader = captures.CaptureReader(str(tmp_path), r.choice([1, 2, 7, 50, 10_000]))
        end = reader.latestOffset()
        assert end == ({"c": len(body) - 9} if lines else {})
        got = [row for p in reader.partitions({}, end) for row in reader.read(p)]
        assert [v for _, _, v in got] == [x.removesuffix("\r") for x in lines]
        assert [at for _, at, _ in got] == [len("".join(x + "\n" for x in lines[:i]).encode()) for i in range(len(lines))]


def test_blocks_smaller_than_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(captures, "BLOCK", 3)
    (tmp_path / "c").write_bytes(b"abcdefgh\n\nxy\nno end")
    reader = captures.CaptureReader(str(tmp_path), 4)
    end = reader.latestOffset()
    assert end == {"c": 13} and [r[2] for p in reader.partitions({}, end) for r in reader.read(p)] == ["abcdefgh", "", "xy"]
    assert captures.CaptureReader(str(tmp_path / "none"), 4).latestOffset() == {}


def _append(path, rows, tail=""):
    with open(path, "a") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows) + tail)


def test_a_restart_in_the_middle_loses_and_repeats_nothing(spark, tmp_path):
    captures.register(spark)
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    rows = [{"key": i % 3, "n": i, "delta": f"t{i} "} for i in range(90)]

    def run(fail=False):
        stream = spark.readStream.format("captures").option("bytes", 100).load(folder)
        tokens = files.ndjson(stream, "key int, n int, delta string")

        def each(b, i):
            b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{tmp_path}/out/{i}")
            if fail:
                raise RuntimeError("stopped before the commit")

        return tasks.run_once(tokens, f"{tmp_path}/state", each)

    _append(f"{folder}/a", rows[:20])
    assert run().exception() is None
    _append(f"{folder}/a", rows[20:41], json.dumps(rows[41])[:9])
    _append(f"{folder}/b", rows[60:75], "not json\n")
    with pytest.raises(StreamingQueryException, match="stopped"):
        run(fail=True)
    _append(f"{folder}/a", [], json.dumps(rows[41])[9:] + "\n")
    _append(f"{folder}/a", rows[42:60])
    _append(f"{folder}/b", rows[75:])
    for _ in range(3):
        assert run().exception() is None
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()
    assert sorted(r["n"] for r in got) == list(range(90)) and len({r["batch"] for r in got}) >= 3
