"""Sinks: append, upsert, delete, versioned publishing, files by key, JSON lines, caches, migrations.

Plain Parquet has no row updates: a change is a new version of the table in a folder of its own, made visible by one small
pointer file that is written last (``versions``). All paths go through Spark's own file system layer, so that they may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import scoring, text


def append(df: DataFrame, path: str) -> None:
    """SNK-01."""
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SNK-05: one row a key, the newest; of equal age the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_new").desc(), *[F.col(c).desc_nulls_last() for c in old.columns if c not in keys])
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def increments(deltas: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """SNK-03: counters as sums of appended deltas."""
    return deltas.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def delete(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """SNK-06: (what stays, one row with the number of rows that go). A predicate that is null deletes nothing."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.where(~hit), df.agg(F.count_if(hit).alias("deleted"))


def enqueue(new: DataFrame, existing: DataFrame, keys: list[str], opened: Column) -> DataFrame:
    """SNK-12: new rows for which no open row of the same keys exists, one a key."""
    return new.dropDuplicates(keys).join(existing.where(opened).select(*keys), keys, "left_anti")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """One small text file of the store."""
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(body.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    body = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return body


def delete_folder(spark: SparkSession, path: str) -> None:
    """A folder of the store goes, with all in it."""
    fs, p = _files(spark, path)
    fs.delete(p, True)


def by_folder(df: DataFrame, key: str, path: str) -> None:
    """SNK-08: JSON in a folder for each key; ids are cut to their first eight characters."""
    df.withColumn("id8", scoring.short_id(F.col(key).cast("string"))).write.mode("overwrite").partitionBy("id8").json(path)


def page_file_names(pages: DataFrame, order: str, title: str) -> DataFrame:
    """SNK-08, STR-05, Q-21: 0001_slug.md, unique by its number."""
    return pages.withColumn("file_name", F.concat(text.left_pad_number(order, 4), F.lit("_"), F.coalesce(F.nullif(text.slug(title), F.lit("")), F.lit("page")), F.lit(".md")))


def json_lines(df: DataFrame, path: str) -> None:
    """SNK-09."""
    df.write.mode("append").json(path)


def json_lines_by(df: DataFrame, key: str, order: list[str], path: str) -> None:
    """AGG-25: one folder a key, lines in order; keys are dealt out once and sorted where they land."""
    df.repartition(key).sortWithinPartitions(key, *order).write.mode("overwrite").partitionBy(key).json(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """SRC-14, AST-07: what lies at the path, else made and written there. A folder without its success mark is made again."""
    fs, p = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(**options: object) -> str:
    """AST-07, Q-20: a digest of all options."""
    import hashlib

    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:16]


def migrations(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """SNK-14, FLT-06: (table, pending): rows that have a column's content but no path yet, by (frame, column, path column)."""
    out = None
    for name, (df, have, lack) in tables.items():
        one = df.agg(F.count_if(F.col(have).isNotNull() & F.col(lack).isNull()).alias("pending")).select(F.lit(name).alias("table"), "pending")
        out = one if out is None else out.unionByName(one)
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SNK-11: the columns of a schema in its order, cast; missing ones are null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def stamped(df: DataFrame) -> DataFrame:
    """SNK-02, DAT-01: audit columns."""
    now = F.current_timestamp()
    return df.withColumns({"created_at": F.coalesce(F.col("created_at"), now) if "created_at" in df.columns else now, "updated_at": now})
