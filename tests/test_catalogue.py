"""Every named query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert {c: TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in want.description}
    order = [names.index(c) for c in cols]
    expected = sorted(tuple(_plain(r[i]) for i in order) for r in want.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in df.select(*cols).collect()) == expected


@pytest.mark.parametrize("name", ["stream_dedup", "stream_stage_state", "task_metrics_summary", "source_symbols"])
def test_tables_may_be_folders(spark, tmp_path, db, name):
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        spark.read.parquet(f).repartition(3).write.parquet(f"{tmp_path}/{os.path.basename(f)}")
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == db.execute(f"select count(*) from ({catalogue.ORACLE_SQL[name]})").fetchone()[0]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"] and df.count() > 0
