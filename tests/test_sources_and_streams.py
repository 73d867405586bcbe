import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from weftline import schemas
from weftline.sources import files, sinks, versions
from weftline.streaming import tasks


@pytest.fixture
def repo(tmp_path):
    made = {"README.md": "# Title\n## Part\n", "src/core/main.py": "def f():\n    pass\n", "src/core/b.cs": "class B {}", "docs/architecture.md": "text", "node_modules/x.js": "no", "a.csproj": "<Project/>", "img.png": "no", "tests/test_a.py": "x = 1"}
    for k, v in made.items():
        os.makedirs(tmp_path / os.path.dirname(k), exist_ok=True)
        (tmp_path / k).write_text(v)
    return str(tmp_path)


def test_repository(spark, repo):
    found = files.repository(spark, repo)
    assert {r["file_path"] for r in found.collect()} == {"README.md", "src/core/main.py", "src/core/b.cs", "docs/architecture.md", "a.csproj", "tests/test_a.py"}
    idx = {r["file_path"]: r for r in files.index(found).collect()}
    assert idx["src/core/main.py"]["is_entry_point"] and idx["src/core/main.py"]["module_name"] == "src"
    assert [r["file_path"] for r in files.source_files(found, 2).collect()] == ["src/core/b.cs", "src/core/main.py"]
    assert [r["file_path"] for r in files.project_files(spark, repo).collect()] == ["a.csproj"]
    assert [r["file_path"] for r in files.listing(found).orderBy("position").collect()] == ["a.csproj", "docs/architecture.md", "README.md", "src/core/b.cs", "src/core/main.py", "tests/test_a.py"]
    assert files.readme(found).first()["content"].startswith("# Title")
    other = {r["file_path"]: r for r in files.index(found, analysing=True).collect()}
    assert other["src/core/main.py"]["module_name"] == "core" and other["tests/test_a.py"]["file_type"] == "test" and not other["README.md"]["is_entry_point"] and other["src/core/b.cs"]["is_entry_point"]
    assert tuple(files.technology(found).first()) == (".NET", "C# / .NET")
    assert files.by_key(found, "file_path", "a.csproj").count() == 1 and files.by_key(found, "file_path", "none").count() == 0
    assert [r["file_path"] for r in files.known_documents(found).collect()] == ["README.md", "docs/architecture.md"]
    assert files.corpus(found).where("is_implementation").count() == 2
    c = files.content(found)
    assert [tuple(r) for r in files.line_range(c, "src/core/main.py", 2, 9).collect()] == [(2, "    pass"), (3, "")]
    want = spark.createDataFrame([(1, ["src/core/b.cs", "none", "README.md"])], "k int, f array<string>")
    assert files.joined_files(want, "k", "f", c, 5).first()["text"] == "// src/core/b.cs\nclass\n\n// README.md\n# Tit"
    assert files.markdown_titles(c.where("file_path = 'README.md'")).first()["title"] == "Title"


def test_line_formats(spark, tmp_path):
    lines = spark.createDataFrame([("data: {\"text\": \"a\"}",), ("data: [DONE]",), (": note",), ("{\"k\": 1}",), ("{broken",), ("1700000000||Ann||msg || x",), ("bad",)], "value string")
    assert [r["delta"] for r in files.sse(lines).collect()] == ["a"]
    assert [r["k"] for r in files.ndjson(lines, "k int").where("k is not null").collect()] == [1]
    assert [r["message"] for r in files.git_log(lines).where("commit_time is not null").collect()] == ["msg || x"]
    (tmp_path / "c.json").write_text('{"key": "${A}", "other": "${B}"}')
    assert files.json_config(str(tmp_path / "c.json"), {"A": "1"}) == {"key": "1", "other": "${B}"}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.json").write_text(json.dumps({"file_path": "a", "call_edges": [{"caller_symbol": "f"}]}))
    assert files.analysis_files(spark, str(tmp_path / "f")).first()["call_edges"][0]["caller_symbol"] == "f"
    (tmp_path / "s.json").write_text('[{"name": "A"}, {"name": "B"}]')
    assert files.symbol_file(spark, str(tmp_path / "s.json")).count() == 2


def test_recovery(spark):
    art = spark.createDataFrame([("completed", 2, '{"pages": [{"id": "a", "content": "new"}]}'), ("completed", 1, '{"pages": [{"id": "a", "content": "old"}]}'), ("failed", 3, '{"pages": [{"id": "b", "content": "no"}]}'), ("completed", 4, "{broken")], "status string, sequence int, payload_json string")
    pages = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    assert {tuple(r) for r in files.recovered(art, pages).collect()} == {("a", "new"), ("b", "y")}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (1, "late", 0)], "k int, v string, t int")
    assert {(r["k"], r["v"]) for r in sinks.upsert(old, new, ["k"], "t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    rest, n = sinks.delete(old, F.col("k") == 1)
    assert rest.count() == 1 and n.first()["deleted"] == 1
    assert versions.read(spark, f"{tmp_path}/p", "t") is None
    versions.publish({"t": old}, f"{tmp_path}/p")
    versions.publish({"t": new}, f"{tmp_path}/p")
    assert versions.read(spark, f"{tmp_path}/p", "t").count() == 3
    calls = []
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/c", lambda: calls.append(1) or old).count() == 2
    assert calls == [1]
    assert sinks.fingerprint(a=1) != sinks.fingerprint(a=2)
    sinks.json_lines_by(old, "k", ["t"], f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    assert [r["file_name"] for r in sinks.page_file_names(old, "k", "v").collect()] == ["0001_a.md", "0002_b.md"]
    assert sinks.enqueue(new, old, ["k"], F.col("t") == 1).select("k").collect() == [(3,)]
    assert sinks.migrations({"x": (old.withColumn("p", F.lit(None).cast("string")), "v", "p")}).first()["pending"] == 2
    assert sinks.conform(old, schemas.ddl("v string, more double")).columns == ["v", "more"]
    assert schemas.snake_case(spark.createDataFrame([(1,)], "TaskId int")).columns == ["task_id"]


def _write(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def test_streams(spark, tmp_path):
    ddl, src = "k string, ts timestamp, ok boolean", f"{tmp_path}/in"
    import datetime

    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    _write(spark, src, [("a", t(0), False), ("b", t(1), True)], ddl)
    schema = schemas.ddl(ddl)
    each = tasks.write_by_batch(f"{tmp_path}/out", "k", "k")
    stream = lambda: tasks.deduplicated(tasks.read(spark, src, schema), "k", "ts")
    tasks.run_once(stream(), f"{tmp_path}/state", each)
    _write(spark, src, [("a", t(2), False), ("c", t(3), True)], ddl)
    tasks.run_once(stream(), f"{tmp_path}/state", each)  # resumes: a is known, old files are not read again
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["k"] for r in got) == ["a", "b", "c"] and all(len(r["content_hash"]) == 64 for r in got)
    seen = []
    tasks.run_once(tasks.attempts(tasks.read(spark, src, schema), "k", F.col("ok"), 2), f"{tmp_path}/state2", lambda b, i: seen.extend(b.collect()), "update")
    assert {r["key"]: (r["failures"], r["gave_up"]) for r in seen} == {"a": (2, True), "b": (0, False), "c": (0, False)}
    minutes = []
    tasks.run_once(tasks.progress(tasks.read(spark, src, schema), "k", "ts"), f"{tmp_path}/state3", lambda b, i: minutes.extend(b.collect()), "update")
    assert sum(r["n"] for r in minutes) == 4


def test_a_run_that_did_not_end_is_no_result(spark, tmp_path):
    """Past its deadline a run is stopped and raises, as a failed batch does; the next one from the checkpoint has all rows."""
    src, seen = f"{tmp_path}/in", []
    for i in range(2):
        _write(spark, src, [(f"k{i}",)], "k string")
    stream = lambda: tasks.read(spark, src, schemas.ddl("k string"), files_a_batch=1)

    def slow(batch, batch_id):
        time.sleep(4)
        seen.extend(r["k"] for r in batch.collect())

    with pytest.raises(TimeoutError):
        tasks.run_once(stream(), f"{tmp_path}/state", slow, seconds=1)
    with pytest.raises(StreamingQueryException):
        tasks.run_once(stream(), f"{tmp_path}/state", lambda b, i: 1 / 0)
    tasks.run_once(stream(), f"{tmp_path}/state", lambda b, i: seen.extend(r["k"] for r in b.collect()))
    assert set(seen) == {"k0", "k1"}
