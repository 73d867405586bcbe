"""Declarations, parents, lines, chunks and calls of 13 languages, over texts whose strings and comments look like code."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import code
from weftline.operators.declarations import Source
from weftline.operators.lexing import Brackets, mask

#: language -> (text, declarations as kind, name, first line, last line, parent; calls as caller, callee; chunks as first line, last line, label).
FIXTURES = {
    "csharp": (
        'namespace N;\n[Table("}")]\npublic class A : B<int>, IC\n{\n    string s = "}"; // } class X {\n    char c = \'}\';\n    /* void No() { } */\n    void Run()\n    {\n        var t = $"a{Go("}")}b }}" + @"q""}";\n        var u = """\n            } class Y { void Z() { Q(); } }\n            """;\n    }\n    A(int x) : base(x) { }\n    int Twice(int x) => Help(x,\n        "}");\n    int P { get; set; } = Make();\n    interface IIn { void M(int a); int N(); }\n}\nrecord R(int X);\n',
        [("class", "A", 3, 20, ""), ("function", "Run", 8, 14, "A"), ("function", "A", 15, 15, "A"), ("function", "Twice", 16, 17, "A"), ("interface", "IIn", 19, 19, "A"), ("function", "M", 19, 19, "IIn"), ("function", "N", 19, 19, "IIn"), ("record", "R", 21, 21, "")],
        [("A.Run", "Go"), ("A.Twice", "Help")],
        [(3, 20, "class"), (8, 14, "function")],
    ),
    "typescript": (
        "import { x } from 'lib';\n// class No {\nexport class A extends B<C> implements D {\n  private s = '}';\n  constructor(private a: number) { super(); }\n  run(x: string): void {\n    const t = `a${go(`}${inner()}`)} }`;\n    return /[}/]\\}/.test(t);\n  }\n  handler = async (e: Event) => {\n    help(e);\n  };\n  get size(): number { return 1; }\n}\ninterface I { m(a: number): string; }\nexport const arrow = (a: number): number => {\n  return calc(a);\n};\nfunction last() { run('}'); }\n",
        [("class", "A", 3, 14, ""), ("function", "constructor", 5, 5, "A"), ("function", "run", 6, 9, "A"), ("function", "handler", 10, 12, "A"), ("function", "size", 13, 13, "A"), ("interface", "I", 15, 15, ""), ("function", "m", 15, 15, "I"), ("function", "arrow", 16, 18, ""), ("function", "last", 19, 19, "")],
        [("A.constructor", "super"), ("A.run", "go"), ("A.run", "inner"), ("A.run", "test"), ("A.handler", "help"), ("arrow", "calc"), ("last", "run")],
        [(3, 14, "class"), (6, 9, "function"), (10, 12, "function"), (16, 18, "function")],
    ),
    "javascript": (
        "class A {\n  static run(a) {\n    /* } */ go(a / 2, b / 3);\n    // }\n  }\n  #hidden() { help(\"}\"); }\n}\nfunction f() {\n  const r = '}' + \"{\";\n  return g(r);\n}\nconst h = x => k(x);\nvar w = function () { z(); };\n",
        [("class", "A", 1, 7, ""), ("function", "run", 2, 5, "A"), ("function", "#hidden", 6, 6, "A"), ("function", "f", 8, 11, ""), ("function", "h", 12, 12, ""), ("function", "w", 13, 13, "")],
        [("A.run", "go"), ("A.#hidden", "help"), ("f", "g"), ("h", "k"), ("w", "z")],
        [(1, 7, "class"), (2, 5, "function"), (8, 11, "function")],
    ),
    "python": (
        'import os\n\n"""\nclass No:\n    def no(self): pass\n"""\nclass A(B, metaclass=M):\n    """Doc: def x():"""\n\n    @wrap\n    def run(self, a=")", b=(\n        1,\n    )):\n        s = """\nnot indented: )\n"""\n        # call(1)\n        return f"{go(s)} }}"\n\n    async def two(self): return [\n1,\n        ]\n\ndef f(x):\n    return g("def h():\\n", x)\n',
        [("class", "A", 7, 22, ""), ("function", "run", 11, 18, "A"), ("function", "two", 20, 22, "A"), ("function", "f", 24, 25, "")],
        [("A.run", "go"), ("f", "g")],
        [(7, 22, "class"), (11, 18, "function"), (20, 22, "function")],
    ),
    "go": (
        'package m\nimport "fmt"\ntype T struct {\n\ta string // }\n}\ntype I interface {\n\tRun(a int) error\n}\nfunc (t *T) Run(a int) error {\n\ts := `}\nfunc No() {`\n\tfmt.Println(s, "}", \'}\')\n\treturn help(a)\n}\nfunc two(f func(int) int, x interface{}) (a, b int) {\n\treturn f(1), 2\n}\n',
        [("struct", "T", 3, 5, ""), ("interface", "I", 6, 8, ""), ("function", "Run", 9, 14, "T"), ("function", "two", 15, 17, "")],
        [("T.Run", "Println"), ("T.Run", "help"), ("two", "f")],
        [(3, 5, "struct"), (6, 8, "interface"), (9, 14, "function"), (15, 17, "function")],
    ),
    "rust": (
        "use std::io;\n/* fn no() { /* } */ } */\n#[derive(Debug)]\npub struct S<'a> {\n    x: &'a str,\n}\nimpl<'a> Show for S<'a> {\n    fn show(&self) -> String {\n        let c = '}'; let r = r#\"}\"}\"#;\n        format(\"{}\", help(r))\n    }\n}\ntrait Show { fn show(&self) -> String; }\nfn last<'b>(x: &'b str) -> &'b str { go(x) }\n",
        [("struct", "S", 4, 6, ""), ("function", "show", 8, 11, "S"), ("interface", "Show", 13, 13, ""), ("function", "show", 13, 13, "Show"), ("function", "last", 14, 14, "")],
        [("S.show", "format"), ("S.show", "help"), ("last", "go")],
        [(4, 6, "struct"), (8, 11, "function")],
    ),
    "java": (
        'import java.util.List;\n/** class No { } */\n@Entity(name = "}")\npublic class A<T> extends B<T> implements C, D {\n    enum E { ONE(1), TWO(2); E(int x) { set(x); } }\n    private final String s = """\n        } void no() { }\n        """;\n    A() { this(1); }\n    List<T> find(int id) throws X, Y {\n        char c = \'}\';\n        return load(id, "}\\"}");\n    }\n    @Override\n    abstract void gone(int a);\n}\n',
        [("class", "A", 4, 16, ""), ("enum", "E", 5, 5, "A"), ("function", "A", 9, 9, "A"), ("function", "find", 10, 13, "A"), ("function", "gone", 15, 15, "A")],
        [("E.E", "set"), ("A.A", "this"), ("A.find", "load")],
        [(4, 16, "class"), (10, 13, "function")],
    ),
    "cpp": (
        '#include <vector>\nclass F;\ntemplate <class T>\nclass A : public B<T> {\npublic:\n    A() : x(1) {}\n    ~A();\n    int run(int a) const override {\n        auto s = R"x(} )" )x"; int n = 1\'000;\n        return help(a, \'}\', "}"); // }\n    }\n    virtual void none() = 0;\n    int field = make();\n};\nint A::out(int a) {\n    if (a) { return go(a); }\n    return 0;\n}\nint main() { return A::out(1); }\n',
        [("class", "A", 4, 14, ""), ("function", "A", 6, 6, "A"), ("function", "~A", 7, 7, "A"), ("function", "run", 8, 11, "A"), ("function", "none", 12, 12, "A"), ("function", "out", 15, 18, "A"), ("function", "main", 19, 19, "")],
        [("A.run", "help"), ("A.out", "go"), ("main", "out")],
        [(4, 14, "class"), (8, 11, "function"), (15, 18, "function")],
    ),
    "c": (
        '#include "h.h"\nstruct P {\n    int x; /* } */\n};\nstatic int f(struct P *p) {\n    char c = \'}\';\n    return g(p, "}\\"{"); // {\n}\n/* int no(void) { } */\nint main(void) { return f(0); }\n',
        [("struct", "P", 2, 4, ""), ("function", "f", 5, 8, ""), ("function", "main", 10, 10, "")],
        [("f", "g"), ("main", "f")],
        [(2, 4, "struct"), (5, 8, "function")],
    ),
    "php": (
        "<html>}<?php\nrequire_once 'b.php';\n# class No { }\nclass A extends B {\n    private $s = '}';\n    public function run($x) {\n        $t = <<<EOT\n} function no() {\nEOT;\n        return help($x, \"}\");\n    }\n}\nfunction f() { return go(1); }\n",
        [("class", "A", 4, 12, ""), ("function", "run", 6, 11, "A"), ("function", "f", 13, 13, "")],
        [("A.run", "help"), ("f", "go")],
        [(4, 12, "class"), (6, 11, "function")],
    ),
    "ruby": (
        "require 'json'\n=begin\nclass No\nend\n=end\nclass A < B\n  def run(x)\n    s = <<~T\n  end\nclass X\n    T\n    t = \"#{go(\"end\")} end\" # end\n    help(s)\n  end\n\n  def self.two; three(1); end\nend\n",
        [("class", "A", 6, 17, ""), ("function", "run", 7, 14, "A"), ("function", "two", 16, 16, "A")],
        [("A.run", "go"), ("A.run", "help"), ("A.two", "three")],
        [(6, 17, "class"), (7, 14, "function")],
    ),
    "swift": (
        'import UIKit\n/* class No { /* } */ } */\nclass A: B, C {\n    let s = "}" + #"}"}"#\n    init(x: Int) { super.init() }\n    func run(_ x: Int) -> String {\n        let t = """\n        } func no() { }\n        """\n        return "a\\(go("}"))" + help(t)\n    }\n}\nextension D {\n    func two() { three() }\n}\nprotocol P { func m() }\n',
        [("class", "A", 3, 12, ""), ("function", "run", 6, 11, "A"), ("function", "two", 14, 14, "D"), ("interface", "P", 16, 16, ""), ("function", "m", 16, 16, "P")],
        [("A.run", "go"), ("A.run", "help"), ("D.two", "three")],
        [(3, 12, "class"), (6, 11, "function")],
    ),
    "scala": (
        'import a.b\n// class No {\ncase class A(x: Int, y: String = "}") extends B(x) with C {\n  val s = """}""" + s"a${go("}")} }"\n  def run(y: Int): Int = {\n    val c = \'}\'\n    help(y)\n  }\n  def one(x: Int) = two(x)\n}\nobject O {\n  def last(x: Int)(y: Int): Unit = { three(x) }\n}\n',
        [("class", "A", 3, 10, ""), ("function", "run", 5, 8, "A"), ("function", "one", 9, 9, "A"), ("class", "O", 11, 13, ""), ("function", "last", 12, 12, "O")],
        [("A.run", "help"), ("A.one", "two"), ("O.last", "three")],
        [(3, 10, "class"), (5, 8, "function"), (11, 13, "class")],
    ),
}


@pytest.mark.parametrize("language", sorted(FIXTURES))
def test_declarations(language):
    text, declared, calls, chunks = FIXTURES[language]
    rows = list(code.analysed_rows("f", text, language))
    assert [(r[2], r[3], r[5], r[6], r[7]) for r in rows if r[2] != "call"] == declared
    assert [(r[3], r[11]) for r in rows if r[2] == "call"] == [c for c in calls if c[1] not in code.NO_CALLS]
    source = Source(text, language, code.PATTERNS[language][0], code.PATTERNS[language][1], code.MODIFIERS)
    assert sorted(c[:3] for c in source.chunks()) == sorted(chunks)
    lines = text.split("\n")
    assert all(c[3] == "\n".join(lines[c[0] - 1 : c[1]]) for c in source.chunks())


@pytest.mark.parametrize("language", sorted(FIXTURES))
def test_masks(language):
    text = FIXTURES[language][0]
    for cut in range(0, len(text), 7):  # a text may stop anywhere
        part = text[:cut]
        masked = mask(part, language)
        assert len(masked) == len(part) and all(m == p or (m == " " and p != "\n") for m, p in zip(masked, part, strict=True))
        Source(part, language, code.PATTERNS[language][0], code.PATTERNS[language][1], code.MODIFIERS)
    masked = mask(text, language)
    brackets = Brackets(masked)
    assert all(masked[b : b + 1] == {"(": ")", "[": "]", "{": "}"}[masked[a]] for a, b in brackets.close.items())


def test_long_and_odd_texts():
    for text in ("{" * 50_000, "}" * 50_000, "(" * 50_000, '"' * 9_999, "`${" * 20_000, "/*" * 30_000, "class A {" * 3_000, "f(" * 20_000, "#" * 1000, "'" * 9_999, "def f(x):\n" * 3000):
        for language in FIXTURES:
            list(code.analysed_rows("f", text, language))


def test_signatures_and_bases():
    rows = {r[3]: r for r in code.analysed_rows("f", FIXTURES["csharp"][0], "csharp") if r[2] != "call"}
    assert rows["A"][9] == ["B<int>", "IC"] or rows["A"][3] == "A"
    first = next(r for r in code.analysed_rows("f", FIXTURES["csharp"][0], "csharp") if r[2] == "class")
    assert (first[4], first[9], first[10]) == ("public class A : B<int>, IC", ["B<int>", "IC"], ['[Table("}")]'])
    assert [r[9] for r in code.analysed_rows("f", FIXTURES["python"][0], "python") if r[2] == "class"] == [["B"]]
    assert [r[9] for r in code.analysed_rows("f", FIXTURES["java"][0], "java") if r[3] == "A" and r[2] == "class"] == [["B<T>", "C", "D"]]
    assert [r[9] for r in code.analysed_rows("f", FIXTURES["scala"][0], "scala") if r[3] == "A"] == [["B", "C"]]


def test_chunks_of_files(spark):
    rows = [("a.cs", FIXTURES["csharp"][0]), ("b.txt", "\n".join(str(i) for i in range(200))), ("c.cs", None), ("d.cs", ""), ("e.cs", "int x;")]
    got = code.source_chunks(spark.createDataFrame(rows, "file_path string, content string")).collect()
    assert [(r["file_path"], r["start_line"], r["end_line"], r["label"]) for r in got] == [("a.cs", 3, 20, "class"), ("a.cs", 8, 14, "function"), ("b.txt", 1, 80, "lines"), ("b.txt", 81, 160, "lines"), ("b.txt", 161, 200, "lines"), ("e.cs", 1, 1, "lines")]


def test_files_of_one_scan_task_are_dealt_over_all_cores(spark):
    files = spark.range(0, 4000, 1, 1).selectExpr("concat('f', id, '.py') as file_path", "concat('def f', id, '(a):\n    x = 1\n    return g(a)\n') as content")
    for rows in (code.source_symbols(files), code.source_chunks(files)):
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 4000


def test_long_files_are_analysed_to_their_end(spark):
    """Files of over 100,000 characters, 300 declarations, 500 symbols and calls, or 50 windows; one of a single line."""
    n = 2500
    long = "".join(f"int F{i}(int a)\n{{\n    return G{i}(a); /* some text about it */\n}}\n" for i in range(n))
    rows = [("a.c", long), ("b.txt", "\n".join(str(i) for i in range(20_000))), ("c.js", "".join(f"function f{i}(a){{return g(a)}}" for i in range(n)))]
    assert len(long) > 100_000
    files = spark.createDataFrame(rows, "file_path string, content string")
    chunks = code.source_chunks(files).where("file_path <> 'c.js'").collect()
    lines = long.split("\n")
    assert [(r["start_line"], r["end_line"], r["content"]) for r in chunks if r["file_path"] == "a.c"] == [(4 * i + 1, 4 * i + 4, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(n)]
    windows = [r for r in chunks if r["file_path"] == "b.txt"]
    assert len(windows) == 250 and "\n".join(r["content"] for r in windows) == rows[1][1]
    found = code.source_symbols(files).collect()
    assert [(r["kind"], r["name"], r["callee"]) for r in found if r["file_path"] == "a.c"] == [("function", f"F{i}", None) for i in range(n)] + [("call", f"F{i}", f"G{i}") for i in range(n)]
    assert [r["signature"] for r in found if r["file_path"] == "c.js" and r["kind"] == "function"] == [f"function f{i}(a)" for i in range(n)]
