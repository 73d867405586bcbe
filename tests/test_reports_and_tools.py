import pytest
from pyspark.sql import functions as F

from weftline.operators import reports, tools


def test_tools(spark):
    symbols = spark.createDataFrame([("Foo", "class", "a.cs", 1, 9), ("FooBar", "method", "a.cs", 3, 4), ("foo", "interface", "b.cs", 1, 2)], "name string, kind string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "B")], "caller_symbol string, callee_symbol string")
    files = spark.createDataFrame([("a.cs", "one\ntwo\nthree"), ("e", None)], "file_path string, content string")
    names = tools.register(spark, symbols, edges, files)
    rows = lambda f, *a: [tuple(r) for r in tools.call(spark, f"weft_{f}", *a).collect()]
    assert {r[0] for r in rows("search_symbols", "foo")} == {"Foo", "FooBar", "foo"}
    assert [r[0] for r in rows("search_symbols", "foo", "METHOD")] == ["FooBar"]
    assert {r[1] for r in rows("retrieve_class", "FOO")} == {"a.cs", "b.cs"}
    assert set(rows("query_call_graph", "B")) == {("caller", "A"), ("callee", "C")}
    assert set(rows("find_usages", "C")) == {("B", "C")}
    assert rows("read_code_file", "a.cs", 2, 3) == [(2, "two"), (3, "three")]
    assert tools.available("render") == [] and tools.available("none") == [] and len(tools.available("write")) == len(names)
    with pytest.raises(ValueError):
        tools.call(spark, "weft_find_usages", "C", allowed=tools.available("plan"))
    with pytest.raises(ValueError):
        tools.call(spark, "x; drop", "C")


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double, s string")
    got = reports.call_summary(none, F.lit(1), F.col("v"), F.lit(False)).first()
    assert (got["n_calls"], got["tokens"], got["avg_latency"], got["failure_rate"]) == (0, 0, 0.0, 0.0)
    assert reports.count_map(none, "k").first()["counts"] == {}
    assert reports.quality_report(none, "k", "s", F.lit(False), F.lit(50)).first()["lowest"] == 0
    files = spark.createDataFrame([(["a"], None, [1, 2])], "symbols array<string>, call_edges array<string>, chunks array<int>")
    assert tuple(reports.projection_totals(files).first()) == (1, 1, 0, 2)


def test_structure(spark):
    pages = spark.createDataFrame([(None, "Intro", None, ["b", "b", "x"]), ("B", "b", "s", ["intro", "b"]), (None, "Intro", "t", None), (None, "!!!", "t", [])], "id string, title string, section string, related array<string>")
    got = {r["id"]: (r["section"], r["related"]) for r in reports.normalised_structure(pages, "id", "title", "section", "related").collect()}
    assert got == {"intro": ("general", ["b"]), "b": ("s", ["intro"]), "intro-2": ("t", []), "page": ("t", [])}
    back = {r["id"]: r["related"] for r in reports.linked_back(spark.createDataFrame([("a", ["b"]), ("b", None), ("c", ["a"])], "id string, related array<string>"), "id", "related").collect()}
    assert back == {"a": ["b", "c"], "b": ["a"], "c": ["a"]}
    assert reports.as_json(spark.createDataFrame([(1, "x", None)], "k int, a string, b int"), ["k"]).first()["payload"] == '{"a":"x"}'
