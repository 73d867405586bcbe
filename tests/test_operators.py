import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import code, graph, search
from weftline.operators import relational as R
from weftline.operators import windows as W


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    assert R.in_list(df, "k", []).count() == 0
    assert R.in_list(df, "k", list(range(5000)), most=10).count() == 3
    assert R.where_all(df).count() == 3 and R.where_all(df, None, F.col("k") > 1).count() == 2
    assert R.pending(df, "k", "v").count() == 1
    assert [r["total"] for r in R.page_with_total(df, [F.col("k")], 1, 5).collect()] == [3, 3]
    status = {r["k"]: r["status"] for r in R.compare(df, spark.createDataFrame([(2, None), (3, "c"), (4, "d")], "k int, v string"), "k", "v").collect()}
    assert status == {1: "removed", 2: "same", 3: "changed", 4: "added"}


def test_containment_against_loops(spark, monkeypatch):
    r = random.Random(1)
    hay = [(i, "".join(r.choice("abAB ") for _ in range(r.randint(0, 40)))) for i in range(80)] + [(90, None), (91, "İx")]
    needles = [(i, "".join(r.choice("abAB") for _ in range(r.randint(0, 9)))) for i in range(60)] + [(90, None), (91, "")]
    want = {(i, j) for i, h in hay for j, n in needles if h is not None and n is not None and n.lower() in h.lower()}
    a, b = spark.createDataFrame(hay, "i int, _hay string"), spark.createDataFrame(needles, "j int, _needle string")
    got = [(x["i"], x["j"]) for x in R.contains_join(a, b, "_hay", "_needle").collect()]
    assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(R, "AUTOMATON_CHARS", 40)
    monkeypatch.setattr(R, "BROADCAST_NEEDLES", 5)
    got = [(x["i"], x["j"]) for x in R.contains_join(a, b, "_hay", "_needle").collect()]
    assert set(got) == want and len(got) == len(want)
    monkeypatch.undo()
    many = spark.range(100_000).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(";")).alias("_needle"), F.col("id").alias("j"))
    text = spark.createDataFrame([(1, "xn7; N99999; n5 n12345;n")], "i int, _hay string")
    assert sorted(x["j"] for x in R.contains_join(text, many, "_hay", "_needle").collect()) == [7, 12345, 99999]
    assert R.contains_join(a, b.limit(0), "_hay", "_needle").count() == 0 and R.contains_join(a.limit(0), b, "_hay", "_needle").count() == 0


def test_override_strategies(spark):
    base = spark.createDataFrame([(i, "base") for i in range(5)], "k int, c string")
    o = spark.createDataFrame([(0, "x", "replace", 1), (1, "x", "prepend", 1), (2, "x", "append", 1), (3, "x", "merge", 1), (0, "low", "append", 0)], "k int, o string, s string, p int")
    assert [r["resolved"] for r in R.override_or_base(base, o, "k", "c", "o", "s", "p").orderBy("k").collect()] == ["x", "x\nbase", "base\nx", "base", "base"]


def test_folds_against_loops(spark):
    r = random.Random(3)
    rows = [(g, i, r.randint(1, 60), r.random() < 0.5) for g in range(20) for i in range(r.randint(0, 15))]
    df = spark.createDataFrame(rows, "g int, i int, c int, cut boolean")
    kept, packed, batched = set(), set(), set()
    for g in range(20):
        mine = [x for x in rows if x[0] == g]
        used, n, left, b, size = 0, 0, 100, 1, 0
        for _, i, c, cut in mine:
            if n == 0 or used + c <= 100:
                used, n = used + c, n + 1
                kept.add((g, i))
            if left > 0:
                took = c if c <= left else left if cut and left > 20 else 0
                packed.add((g, i, "taken" if c <= left else "cut" if took else "dropped", took))
                left -= took
            if size > 0 and (size + c > 100 or size >= 80):
                b, size = b + 1, 0
            size += c
            batched.add((g, i, b))
    assert {(x["g"], x["i"]) for x in W.budget(df, "g", ["i"], "c", "i", 100).collect()} == kept
    assert {tuple(x) for x in W.pack(df, "g", ["i"], "c", "i", 100, "cut", 20).collect()} == packed
    assert {tuple(x) for x in W.batches(df, "g", ["i"], "c", "i", 100).collect()} == batched


def test_search_filters_and_chunks(spark):
    docs = spark.createDataFrame([("auth/a.cs", "auth", "login user password", 1), ("data/b.cs", "data", "query user table", 1), ("data/b.cs", "data", "the last chunk of the file", 2)], "path string, module string, text string, line int")
    last = search.build(docs, "path", F.col("text"), last=[F.col("line")])
    ask = spark.createDataFrame([(1, "user login"), (2, "chunk"), (3, "")], "q int, t string")
    hits = {(r["q"], r["doc"]) for r in search.search(last, ask, "q", "t").collect()}
    assert hits == {(1, "auth/a.cs"), (2, "data/b.cs")}
    assert search.search(last, ask, "q", "t", keep=F.lower("module") == "data").select("doc").distinct().count() == 1
    ranked = search.hybrid(last, ask, "q", "t", F.col("path").contains("auth"), F.lit(10), k=2, max_tokens=5)
    assert ranked.where("q = 1").count() == 1  # the first is always kept
    text = search.render(search.search(last, ask, "q", "t").join(docs.dropDuplicates(["path"]).select(F.col("path").alias("doc"), "text"), "doc"), "q", "doc", "text", "rank").where("q = 1").first()["text"]
    assert text.startswith("### auth/a.cs\n```")
    chunks = search.snippets(spark.createDataFrame([("f", "\n".join(map(str, range(170))))], "p string, c string"), "p", "c").collect()
    assert [(c["start_line"], c["end_line"]) for c in chunks] == [(1, 80), (81, 160), (161, 170)]


def test_snippets_take_the_whole_file(spark):
    chunks = search.snippets(spark.createDataFrame([("f", "\n".join(["x" * 5000] * 100))], "p string, c string"), "p", "c").collect()
    assert [(c["start_line"], c["end_line"], len(c["content"])) for c in chunks] == [(1, 80, 80 * 5001 - 1), (81, 100, 20 * 5001 - 1)]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (5, 1), (6, 7)], "a int, b int")
    assert {tuple(r["path"]) for r in graph.cycles(edges, "a", "b").collect()} == {(1, 2, 3, 1), (4, 4)}
    assert {r["node"] for r in graph.on_cycle(edges, "a", "b").collect()} >= {1, 2, 3, 4}
    depth = {r["root"]: r["depth"] for r in graph.longest_path(edges, "a", "b").collect()}
    assert depth == {5: 4, 6: 1}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (8, 9), (9, 8)], "id int, p int")
    assert {r["id"]: r["level"] for r in graph.levels(tree, "id", "p").collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {(r["id"], r["ancestor"], r["distance"]) for r in graph.ancestors(tree, "id", "p").where("id < 8").collect()} == {(2, 1, 1), (3, 1, 1), (4, 2, 1), (4, 1, 2)}
    fixed = {r["id"]: r["p"] for r in graph.break_cycles(tree, "id", "p").collect()}
    assert fixed == {1: None, 2: 1, 3: 1, 4: 2, 8: None, 9: None}
    assert [r["id"] for r in graph.tree_order(tree, "id", "p", ["id"]).orderBy("position").collect()] == [1, 2, 3, 4, 8, 9]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "n string")
    assert graph.architecture(names("Web.Api", "Core", "Infra.Data"), "n").first()[0] == "layered"
    assert graph.architecture(names("Api", "data"), "n").first()[0] == graph.architecture(names(), "n").first()[0] == "modular"
    assert {r["id"]: (r["children"], r["depth"]) for r in graph.trees(tree, "id", "p").collect()} == {1: ([2, 3], 0), 2: ([4], 1), 3: ([], 1), 4: ([], 2)}
    assert graph.levels(tree.limit(0), "id", "p").count() == 0


def test_deep_chains(spark):
    """No depth and no number of rounds ends a walk early."""
    n = 900
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id int, p int")
    assert {r["id"]: (r["root"], r["level"]) for r in graph.levels(chain, "id", "p").collect()} == {i: (0, i) for i in range(n)}
    assert graph.on_cycle(chain, "id", "p").count() == 0
    assert graph.break_cycles(chain, "id", "p").where("p is null").count() == 1
    short = chain.where("id < 80")
    assert graph.ancestors(short, "id", "p").count() == 80 * 79 // 2
    ring = spark.createDataFrame([(i, (i + 1) % 300) for i in range(300)] + [(1000 + i, 1001 + i if i < 199 else 7) for i in range(200)] + [(5000, 5001)], "id int, p int")
    assert {r["node"] for r in graph.on_cycle(ring, "id", "p").collect()} == set(range(300))
    forked = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(i, i + 2) for i in range(29)], "a int, b int")
    assert graph.on_cycle(forked, "a", "b").count() == 0
    assert {r["root"]: r["depth"] for r in graph.longest_path(forked, "a", "b").collect()} == {0: 30}


def test_running_total_and_workers(spark):
    rows = [(i * 7 % 50, i % 5) for i in range(50)]
    got = {r["k"]: r["before"] for r in graph.running_total(spark.createDataFrame(rows, "k int, v int").repartition(6), [F.col("k")], "v", "before").collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}
    entries = spark.createDataFrame([("a", f"a{i}", i) for i in range(40)] + [("b", "b0", 99), ("c", "c0", 1)], "m string, f string, s int")
    work = {r["worker"]: r for r in W.assigned(entries.select("m"), entries, "m", "f", "s").collect()}
    assert work[1]["modules"] == ["a", "b"] and work[1]["key_files"][:2] == ["b0", "a39"] and len(work[1]["key_files"]) == 30 and work[1]["n_files"] == 41
    assert (work[2]["modules"], work[2]["key_files"]) == (["c"], ["c0"])
    calls = spark.createDataFrame([("f", "g", "x.cs", 0.9), ("f", "h", "a.cs", 0.7), ("g", "h", "b.cs", 0.7)], "caller string, callee string, file string, c double")
    assert tuple(graph.top_callers(calls, "caller", "callee", 1, file="file", confidence="c").first()) == ("f", 2, ["g", "h"], "a.cs", 0.9)


def test_search_cache_and_lookups(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma")], "k int, t string")
    index = search.build(docs, "k", F.col("t"), tf="count", path=f"{tmp_path}/index")
    assert {(r["doc"], r["token"], r["tf"]) for r in index.postings.collect()} == {(1, "alpha", 1), (1, "beta", 1), (2, "beta", 1), (2, "gamma", 2)}
    ask = spark.createDataFrame([(1, "gamma")], "q int, t string")
    first = search.cached_search(index, ask, "q", "t", 5, f"{tmp_path}/cache").collect()
    again = search.cached_search(index, ask, "q", "t", 5, f"{tmp_path}/cache").collect()
    assert first == again and [r["doc"] for r in first] == [2]
    assert search.cached_search(index, ask, "q", "t", 4, f"{tmp_path}/cache").count() == 1
    import os

    assert len(os.listdir(tmp_path / "cache")) == 2
    index.drop()
    assert not os.path.exists(tmp_path / "index")
    big = search.search(search.build(docs, "k", F.col("t")), ask, "q", "t")
    try:
        search.BROADCAST_TOKENS = 0
        assert search.search(search.build(docs, "k", F.col("t")), ask, "q", "t").collect() == big.collect()
    finally:
        search.BROADCAST_TOKENS = 500_000
    files = spark.createDataFrame([("b.cs", ["UserService"]), ("a.cs", ["userservicetests", "X"]), ("c.cs", [])], "file_path string, exported_symbols array<string>")
    assert [r["file_path"] for r in search.definitions_like(files, "UserService").collect()] == ["a.cs", "b.cs"]


PYTHON = "import os\nclass A:\n    def f(self):\n        return g(1)\n\ndef g(x):\n    return os.path.join(x)\n"


def test_code(spark):
    files = spark.createDataFrame([("src/a.py", PYTHON), ("b.cs", "using X.Y;\npublic class Foo : IBar {\n public int Run(int a) { }\n}"), ("bad.py", "def ("), ("c.txt", None)], "file_path string, content string")
    a = {r["file_path"]: r for r in code.analyse(files).collect()}
    assert a["src/a.py"]["types"] == ["A"] and a["src/a.py"]["functions"] == ["f", "g"] and a["src/a.py"]["imports"] == ["os"]
    assert (a["b.cs"]["types"], a["b.cs"]["functions"], a["b.cs"]["imports"]) == (["Foo"], ["Run"], ["X.Y"])
    assert len(a["src/a.py"]["chunks"]) == 1
    rows = code.python_symbols(files)
    defs = rows.where("kind <> 'call'")
    assert {(r["kind"], r["name"], r["parent"], r["start_line"]) for r in defs.collect()} == {("class", "A", "", 2), ("function", "f", "A", 3), ("function", "g", "", 6)}
    edges = code.call_edges(defs, rows.where("kind = 'call'")).collect()
    assert [(e["caller_symbol"], e["callee_symbol"], e["confidence"]) for e in edges] == [("f", "g", 0.9)]
    assert code.hierarchy(defs).first()["methods"] == ["f"]
    assert code.symbols(code.analyse(files)).where("kind = 'type'").count() == 2


CSHARP = """using System.Linq;
[Serializable]
public abstract class UserRepository : BaseRepo, IUserRepository
{
    private static readonly UserRepository Instance = null;
    private UserRepository() { }
    [HttpGet]
    public async Task<User> Find(int id)
    {
        if (id > 0) { return Load(id); }
        return new User(id);
    }
    public static void Load(int id) => Log(id);
}
public interface IHandler { }
public class A : IHandler { }
public class B : IHandler { }
"""


def test_symbols_of_all_languages(spark):
    texts = {
        "r/a.cs": CSHARP,
        "a.ts": "import x from 'lib';\nexport class Foo extends Bar {\n}\nexport function run(a) {\n  go(a);\n}\n",
        "a.js": "const y = require('z');\nfunction f() { g(); }\n",
        "a.go": "package m\nimport (\n\"fmt\"\n)\ntype T struct {\n}\nfunc (t T) Run() {\n  fmt.Println(1)\n}\n",
        "a.rs": "use std::io;\npub struct S { x: i32 }\npub fn run() { help(); }\n",
        "A.java": "import java.util.List;\n@Entity\npublic class A extends B implements C {\n  public int run(int x) { return other(x); }\n}\n",
        "a.cpp": "#include <vector>\nclass K : public L {\n};\nint run(int a) {\n  return help(a);\n}\n",
        "a.c": "#include \"h.h\"\nint run(int a) {\n  return help(a);\n}\n",
        "a.php": "<?php require_once 'b.php';\nclass P extends Q { function run() { help(); } }\n",
        "a.rb": "require 'json'\nclass R < S\n  def run(x)\n    help(x)\n  end\nend\n",
        "a.swift": "import UIKit\nclass V: W {\n  func run() { help() }\n}\n",
        "a.scala": "import a.b\ntrait X {\n  def run(y: Int) = { help(y) }\n}\n",
        "a.py": "import os\nclass Y(Z):\n    def run(self):\n        help(1)\n\nx = 1\n",
        "a.txt": "class No {}",
        "n.cs": None,
    }
    df = spark.createDataFrame(list(texts.items()), "file_path string, content string")
    rows = code.source_symbols(df)
    got = {}
    for r in rows.collect():
        got.setdefault(r["file_path"], []).append(r)
    assert set(got) == set(texts) - {"a.txt", "n.cs"}
    for path in set(got) - {"r/a.cs"}:
        names = {(r["kind"], r["name"], r["callee"]) for r in got[path]}
        called = [r for r in got[path] if r["kind"] == "call"]
        assert any(k == "function" for k, *_ in names) and [c["callee"] for c in called] == [{"a.ts": "go", "a.js": "g", "a.go": "Println", "A.java": "other"}.get(path, "help")], (path, names)
    by = {(r["kind"], r["name"]): r for r in got["r/a.cs"] if r["kind"] != "call"}
    top = by["class", "UserRepository"]
    assert (top["start_line"], top["end_line"], top["modifiers"], top["bases"], top["attributes"]) == (3, 14, ["public", "abstract"], ["BaseRepo", "IUserRepository"], ["[Serializable]"])
    find = by["function", "Find"]
    assert (find["parent"], find["signature"], find["start_line"], find["end_line"], find["attributes"]) == ("UserRepository", "public async Task<User> Find(int id)", 8, 12, ["[HttpGet]"])
    calls = {(r["name"], r["callee"]) for r in got["r/a.cs"] if r["kind"] == "call"}
    assert calls == {("UserRepository.Find", "Load"), ("UserRepository.Find", "User"), ("UserRepository.Load", "Log")}
    assert [(r["bases"]) for r in got["A.java"] if r["kind"] == "class"] == [["B", "C"]] and [(r["bases"]) for r in got["a.rb"] if r["kind"] == "class"] == [["S"]] and [(r["bases"]) for r in got["a.py"] if r["kind"] == "class"] == [["Z"]]
    assert [(r["start_line"], r["end_line"], r["parent"]) for r in got["a.py"] if r["kind"] == "function"] == [(3, 4, "Y")]
    imports = {r["file_path"]: r["imports"] for r in code.analyse(df).collect()}
    assert imports["a.rs"] == ["std::io"] and imports["a.c"] == ["h.h"] and imports["a.rb"] == ["json"] and imports["a.php"] == ["b.php"]
    hints = code.pattern_hints(rows, df)
    assert {(r["pattern"], r["detail"], r["confidence"]) for r in hints.where("file_path = 'r/a.cs'").collect()} == {("Repository", "UserRepository", 0.95), ("Singleton", "UserRepository", 0.9), ("Strategy", "IHandler", 0.85)}
    assert {(r["pattern"], r["module"], r["n_files"]) for r in code.patterns(hints).collect()} == {("Repository", "r", 1), ("Singleton", "r", 1), ("Strategy", "r", 1)}
    text = code.hierarchy_report(rows).where("file_path = 'r/a.cs'").first()["text"]
    assert text.startswith("- class `UserRepository` : BaseRepo, IUserRepository\n") and "  - `public async Task<User> Find(int id)`" in text
    edges = code.call_edges(rows.where("kind <> 'call'").select("name", "file_path"), rows.where("kind = 'call'").drop("parent"))
    assert [r["line"] for r in code.call_report(edges, 1).collect()][0].startswith("- `")


def test_more_patterns(spark):
    texts = {"f.cs": "public class ShapeFactory { public object Make(int a) { return new Shape(); } }", "o.cs": "public class Hub { public event Action Done; }", "b.cs": "public class QueryBuilder { public string Build() { return null; } }", "m.cs": "public class TaskMediator {\n private int a;\n private int b;\n private int c;\n}", "x.cs": "public class TaskMediator {\n private int a;\n}"}
    df = spark.createDataFrame(list(texts.items()), "file_path string, content string")
    assert {(r["file_path"], r["pattern"]) for r in code.pattern_hints(code.source_symbols(df), df).collect()} == {("f.cs", "Factory"), ("o.cs", "Observer"), ("b.cs", "Builder"), ("m.cs", "Mediator")}


def test_patterns_and_references(spark):
    rows = spark.createDataFrame([("m/a.cs", "type", "UserFactory"), ("m/b.cs", "type", "Plain")], "file_path string, kind string, name string")
    files = spark.createDataFrame([("a.csproj", '<PackageReference Include="P" /><ProjectReference Include="../b/b.csproj" />'), ("package.json", json.dumps({"dependencies": {"x": "1", "@types/x": "1"}})), ("s.sln", 'Project("{1}") = "Core", "c"')], "file_path string, content string")
    assert {(r["kind"], r["name"]) for r in code.project_references(files).collect()} == {("package", "P"), ("project", "../b/b.csproj"), ("package", "x"), ("project", "Core")}
    pages = spark.createDataFrame([(1, "`UserFactory` and `Ghost`"), (2, "none")], "k int, t string")
    got = {r["k"]: (r["checked"], r["rate"], r["unknown"]) for r in code.authenticity(pages, "k", "t", rows, "name").collect()}
    assert got == {1: (2, 0.5, ["Ghost"]), 2: (0, 1.0, [])}


def test_folds_take_items_without_a_cost(spark):
    from weftline.operators import windows

    df = spark.createDataFrame([("k", 1, 30, True), ("k", 2, None, True), ("k", 3, 80, True), ("k", 4, None, False)], "key string, id int, c int, may boolean")
    assert {(r["id"], r["action"], r["tokens"]) for r in windows.pack(df, "key", ["id"], "c", "id", 200, "may").collect()} == {(1, "taken", 30), (2, "dropped", 0), (3, "taken", 80), (4, "dropped", 0)}
    assert {(r["id"], r["batch_no"]) for r in windows.batches(df, "key", ["id"], "c", "id", 100).collect()} == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_best_candidate_compares_values_once(spark):
    """By what condition and score read of a row, nulls too, as by rows."""
    rows = spark.range(400).selectExpr("id as k", "if(id % 7 = 0, null, cast(id % 5 as int)) as size")
    cands = spark.range(60).selectExpr("id as cand", "cast(id % 6 as int) as s")
    args = (cands, F.col("s") == F.col("size") - 1, F.when(F.col("cand") % 3 == F.col("k") % 3, 10).otherwise(5), ["k"], [F.col("cand")])
    each, once = R.best_candidate(rows, *args), R.best_candidate(rows, *args, by=[F.col("size"), F.col("k") % 3])
    want = {(k, k % 5, min((c for c in range(60) if c % 6 == k % 5 - 1), key=lambda c: (c % 3 != k % 3, c))) for k in range(400) if k % 7 and k % 5}
    assert {(r["k"], r["size"], r["cand"]) for r in each.collect()} == {(r["k"], r["size"], r["cand"]) for r in once.collect()} == want
