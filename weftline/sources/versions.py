"""Tables by version: numbered pointers, copy-on-write of buckets.

``root/data/<id>`` holds what one writer wrote, ``root/pointers/<number>.json`` names the folders that make up a version. A
writer writes its folders, then its pointer under the number after the one that it began from. The pointer is moved to its name
only if that name is free, so that of two writers that began from one version the second is refused (``Conflict``), takes its
folder away and may begin again. Readers see a version whole or not at all. The move is atomic where the store's rename is
(HDFS); on a plain local folder it is checked, then done.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import checkpoints
from weftline.sources import sinks

#: The column of buckets; the tables themselves must not have it.
BUCKET = "_weft_bucket"


class Conflict(RuntimeError):
    """Another writer has published since the version that this one began from."""


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, tables) of the newest version; (0, {}) before the first."""
    fs, folder = sinks._files(spark, f"{root}/pointers")
    if not fs.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    n = max(numbers, default=0)
    return n, json.loads(sinks._read_text(spark, f"{root}/pointers/{n:010d}.json")) if n else {}


def _point(spark: SparkSession, root: str, number: int, tables: dict) -> None:
    fs, target = sinks._files(spark, f"{root}/pointers/{number:010d}.json")
    draft = f"{root}/pointers/.{uuid.uuid4().hex}"
    sinks.write_text(spark, draft, json.dumps(tables, sort_keys=True))
    source = sinks._files(spark, draft)[1]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    context = hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(source, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(target):
            raise Conflict(f"version {number} of {root} exists") from None
        raise


def _begin(spark: SparkSession, root: str, expected: int | None) -> tuple[int, dict]:
    number, tables = current(spark, root)
    if expected is not None and expected != number:
        raise Conflict(f"{root} is at version {number}, not {expected}")
    return number, tables


def publish(frames: dict[str, DataFrame], root: str, expected: int | None = None) -> int:
    """SNK-07: the tables, whole, as the next version: all of them or, on any error, none. ``expected``: the version that they were made from."""
    spark = next(iter(frames.values())).sparkSession
    number, _ = _begin(spark, root, expected)
    base = f"{root}/data/{uuid.uuid4().hex}"
    try:
        for name, df in frames.items():
            df.write.parquet(f"{base}/{name}")
        _point(spark, root, number + 1, {name: {"paths": {"": f"{base}/{name}"}} for name in frames})
    except BaseException:
        sinks.delete_folder(spark, base)
        raise
    return number + 1


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame | None:
    """A table of the newest version, or of the one numbered; None if there is none."""
    tables = current(spark, root)[1] if number is None else json.loads(sinks._read_text(spark, f"{root}/pointers/{number:010d}.json") or "{}")
    return spark.read.parquet(*tables[name]["paths"].values()) if name in tables else None


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(new: DataFrame, root: str, name: str, keys: list[str], order: str, buckets: int = 64, expected: int | None = None) -> int:
    """SNK-05: ``sinks.upsert`` of the rows into a table, as the next version; the buckets of keys that none of them touches stay the files that they are.

    The number of buckets and the keys are those of the table's first merge; other keys are refused. A table that was published
    whole is dealt into buckets by its first merge. No new rows: no new version. Other tables of the root stay as they are.
    """
    spark = new.sparkSession
    if BUCKET in new.columns:
        raise ValueError(f"{BUCKET} is a name of the store")
    number, tables = _begin(spark, root, expected)
    had = tables.get(name)
    if had and had.get("keys", keys) != keys:
        raise ValueError(f"{name} is kept by {had['keys']}")
    buckets = had.get("buckets", buckets) if had else buckets
    new = checkpoints.cut(new.withColumn(BUCKET, bucket(keys, buckets)))
    touched = sorted(str(r[0]) for r in new.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return number
    dealt = bool(had and "buckets" in had)
    olds = [had["paths"][b] for b in touched if b in had["paths"]] if dealt else list(had["paths"].values()) if had else []
    rows = new.drop(BUCKET)
    merged = sinks.upsert(spark.read.parquet(*olds), rows, keys, order) if olds else sinks.upsert(rows.limit(0), rows, keys, order)
    path = f"{root}/data/{uuid.uuid4().hex}/{name}"
    try:
        merged.withColumn(BUCKET, bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        fs, folder = sinks._files(spark, path)
        written = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        paths = {**(had["paths"] if dealt else {}), **{w.split("=")[1]: f"{path}/{w}" for w in written}}
        _point(spark, root, number + 1, {**tables, name: {"keys": keys, "buckets": buckets, "paths": paths}})
    except BaseException:
        sinks.delete_folder(spark, path)
        raise
    return number + 1
