import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import jsonx, paths, scoring, text, tokens


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()] or ["id"]).select(column.alias("r")).first()["r"]


def test_search_tokens(spark):
    got = one(spark, tokens.search_tokens("x"), x="HelloWorld get_user_name, a b; 漢字検索 x_y")
    assert got == ["helloworld", "get_user_name", "漢字検索", "x_y", "get", "user", "name", "漢字", "字検", "検索", "漢", "字", "検", "索"]
    assert one(spark, tokens.search_tokens("x"), x="") == []


@pytest.mark.parametrize("x,a,b,c", [("", 0, 0, 0), ("abc", 1, 1, 0), ("abcdefgh", 2, 2, 2), ("漢字検", 2, 1, 0), ("漢a", 2, 1, 0)])
def test_estimates(spark, x, a, b, c):
    assert (one(spark, tokens.estimate("x"), x=x), one(spark, tokens.estimate_quarter("x"), x=x), one(spark, tokens.estimate_floor("x"), x=x)) == (a, b, c)


@pytest.mark.parametrize("x", ["a" * 50, "漢" * 50, "a漢" * 30, ""])
def test_truncation_is_the_longest_prefix(spark, x):
    import math

    cost = lambda s: math.ceil(s.count("漢") / 1.5) + math.ceil(s.count("a") / 4)
    want = max((x[:n] for n in range(len(x) + 1) if cost(x[:n]) <= 7), key=len)
    assert one(spark, tokens.truncate_to("x", 7), x=x) == want


@pytest.mark.parametrize("n,size,overlap,want", [(7, 4, 1, ["a b c d", "d e f g"]), (3, 4, 1, ["a b c"]), (0, 4, 1, []), (4, 2, 2, ["a b", "b c", "c d"])])
def test_word_windows(spark, n, size, overlap, want):
    assert one(spark, tokens.word_windows("x", size, overlap), x=" ".join("abcdefg"[:n])) == want


def test_slugs_and_names(spark):
    assert one(spark, text.slug("x"), x="  Hello, World! ") == "hello-world"
    assert one(spark, text.slug_unicode("x"), x="Über die Höhe") == "über-die-höhe"
    assert one(spark, text.humanize("x"), x="myHTTPServer_nameFoo") == "my HTTPServer name Foo"
    assert one(spark, text.anchor("x"), x="What's New? (v2)") == "whats-new-v2"
    assert one(spark, text.safe_file_name("x"), x="a/b:c d") == "a-b-c-d"


def test_markdown(spark):
    assert one(spark, text.normalise_markdown("x"), x="<think>no</think>\n```json\n{}\n```\n") == "{}"
    got = one(spark, text.outline("x", "t"), x="# A\n## One\ntext\n### Two b\n####### no", t="T")
    assert [(r["level"], r["title"], r["anchor"]) for r in got] == [(1, "T", "t"), (2, "One", "one"), (3, "Two b", "two-b")]
    assert one(spark, text.code_references("x"), x="`Foo.bar()` and **Baz** `foo.bar` `not this`") == ["Foo.bar", "Baz"]
    assert one(spark, text.summary("x"), x="one\n\n```\ncode\n```\n\ntwo\n\nthree") == "one\n\ntwo"
    made = one(spark, text.front_matter({"title": F.col("t")}, {"files": F.col("f"), "none": F.array().cast("array<string>")}, "x"), t='a "b"', f=["p", "q"], x="body")
    assert made == '---\ntitle: "a \\"b\\""\nfiles:\n  - "p"\n  - "q"\nnone: []\n---\n\nbody'


def test_front_matter_is_read_back(spark):
    doc = '---\ntitle: "T x"\nfiles:\n  - "p"\n  - q\ntags: [a, "b"]\n---\n# H\n'
    assert one(spark, jsonx.front_matter_value("x", "title"), x=doc) == "T x"
    assert one(spark, jsonx.front_matter_list("x", "files"), x=doc) == ["p", "q"]
    assert one(spark, jsonx.front_matter_list("x", "tags"), x=doc) == ["a", "b"]
    assert one(spark, jsonx.title_of("x"), x="# Only heading\n") == "Only heading"


def test_small_text_functions(spark):
    assert one(spark, text.escape_xml("x"), x="<a b=\"c\">&'") == "&lt;a b=&quot;c&quot;&gt;&amp;&apos;"
    assert one(spark, text.interpolate("x", F.create_map(F.lit("a"), F.lit("1"))), x="{{a}} {{b}}") == "1 {{b}}"
    assert one(spark, text.numbered_lines("x", 1, 2), x="a\nb\nc") == "     1 | a\n     2 | b\n... (1 more lines)"
    assert one(spark, text.multi_line_list("x"), x=" a%20b \n\n c%zz ") == ["a b", "c%zz"]
    got = one(spark, text.numbered_outline("x"), x='Plan\n1. **Intro**: what "it" is\n2) Next - more\n')
    assert [(r["title"], r["description"]) for r in got] == [("Intro", "what it is"), ("Next", "more")]
    assert one(spark, text.parse_hint("x"), x="Factory|0.8|a.cs|x|y")["detail"] == "x|y"
    assert one(spark, text.parse_hint("x"), x="Factory|no")["confidence"] is None
    assert one(spark, text.fixed_chunks("x", 2), x="abcde") == ["ab", "cd", "e"]
    assert one(spark, text.signature("x"), x="public int  F(int a)\n  => a;") == "public int F(int a)"
    assert one(spark, text.merge_distinct("a", "b"), a=[" A", "b", ""], b=["a", "C"]) == ["A", "b", "C"]
    assert one(spark, text.applies("a", "X"), a=["x"]) and one(spark, text.applies("a", "X"), a=[]) and not one(spark, text.applies("a", "X"), a=["y"])


@pytest.mark.parametrize("path,kind,lang,score", [("src/main.go", "source", "go", 17), ("a/tests/x.py", "test", "python", 2), ("docs/a.md", "doc", "markdown", 3), ("Dockerfile", "config", "text", 4), ("x/.env", "config", "text", 4), ("x/a.g.cs", "generated", "csharp", 1), ("Program.cs", "source", "csharp", 15), ("x/.eslintrc.js", "source", "javascript", 5), ("a/spec/b.rb", "test", "ruby", 2), ("x/docs/b.cs", "doc", "csharp", 3), ("src/startup.cs", "source", "csharp", 15), ("a/x.yml", "config", "yaml", 4), ("A/Generated/b.cs", "generated", "csharp", 1)])
def test_paths(spark, path, kind, lang, score):
    assert (one(spark, paths.file_type("x"), x=path), one(spark, paths.language("x"), x=path), one(spark, paths.importance("x"), x=path)) == (kind, lang, score)


@pytest.mark.parametrize(
    "path,kind,lang,score,module",
    [("src/core/main.go", "source", "go", 15, "core"), ("lib/a.rb", "source", "ruby", 8, "root"), ("tests/a/b.py", "test", "python", 2, "a"), ("README.md", "doc", "other", 1, "root"), ("a/x.gen.go", "generated", "go", 5, "a"), ("interfaces/IUser.cs", "source", "csharp", 7, "interfaces"), ("web/app.tsx", "source", "typescript", 15, "web"), ("src/latest.cs", "test", "csharp", 5, "root"), ("a/b.scala", "source", "scala", 5, "a"), ("x.config", "source", "other", 5, "root")],
)
def test_paths_of_the_analysing_index(spark, path, kind, lang, score, module):
    got = (paths.file_type_analysis("x"), paths.language("x", "index"), paths.importance_analysis("x"), paths.module_second("x"))
    assert tuple(one(spark, f, x=path) for f in got) == (kind, lang, score, module)


def test_projects_and_urls(spark):
    assert one(spark, paths.project_type("x"), x=["Cargo.toml"]) == "rust" and one(spark, paths.project_type("x"), x=["a/Cargo.toml"]) == "generic"
    assert one(spark, paths.project_type("x"), x=["a.py", "b/x.CSPROJ", "go.mod"]) == "dotnet"
    assert one(spark, paths.tech_stack("x"), x=["a.tsx", "b.csproj", "next.config.js"]) == ".NET/React+TypeScript/Next.js" and one(spark, paths.tech_stack("x"), x=[]) == "未知"
    assert tuple(one(spark, paths.detected("x"), x="a/Dockerfile")) == ("Containerized", "Docker") and tuple(one(spark, paths.detected("x"), x="a/b.csproj")) == (".NET", "C# / .NET") and one(spark, paths.detected("x"), x="a.txt") is None
    assert [one(spark, paths.language("x", "analysis"), x=f"a{e}") for e in (".tsx", ".cshtml", ".md")] == ["tsx", "razor", ""]
    url = "https://github.com/Own/Repo.git"
    assert [one(spark, f("x"), x=url) for f in (paths.repo_name, paths.repo_owner, paths.provider, paths.provider_key)] == ["Repo", "Own", "github", "github:own/repo"]
    assert one(spark, paths.file_url("u", "k", "b", "p"), u=url, k="github", b="main", p="a.cs") == "https://github.com/Own/Repo/blob/main/a.cs"
    raw = lambda u: one(spark, paths.raw_file_url("u", "b", "p"), u=u, b="main", p="src/a b.cs")
    assert raw(url) == "https://api.github.com/repos/Own/Repo/contents/src/a b.cs"
    assert raw("https://gitlab.com/g/sub/r.git/") == "https://gitlab.com/api/v4/projects/g%2Fsub%2Fr/repository/files/src%2Fa%20b.cs/raw?ref=main"
    assert raw("https://bitbucket.org/o/r") == "https://api.bitbucket.org/2.0/repositories/o/r/src/main/src/a b.cs" and raw("/local/x") is None
    assert one(spark, paths.owner_path("u"), u="https://gitlab.com/g/sub/r.git") == "g/sub"
    assert [one(spark, f("x"), x="src/core/a/b.cs") for f in (paths.module_first, paths.module_second, paths.module_last, paths.module_dir)] == ["src", "core", "a", "src/core/a"]
    assert one(spark, paths.module_of("x", F.array(F.lit("b"), F.lit("core"))), x="src/core/a/b.cs") == "core"
    assert one(spark, paths.skipped("x"), x="a/node_modules/b.js") and one(spark, paths.skipped("x"), x="TMP/a.cs") and not one(spark, paths.skipped("x"), x="a/b.js")
    assert one(spark, paths.skipped_analysis("x"), x="a/.gradle/b.js") and one(spark, paths.skipped_analysis("x"), x="a.pdb") and not one(spark, paths.skipped_analysis("x"), x="tmp/b.js")
    assert one(spark, paths.skipped_document("x"), x="a/.git/b") and one(spark, paths.skipped_document("x"), x=".x/b") and not one(spark, paths.skipped_document("x"), x="node_modules/b.js")


def test_scores(spark):
    assert one(spark, scoring.ratio("a", "b"), a=1, b=0) == 0.0
    assert one(spark, scoring.percent("a", "b"), a=2, b=3) == 66
    assert one(spark, scoring.context_budget("a", "b", "c"), a=1000, b=0.5, c=700) == 0
    assert one(spark, scoring.cost_by_keyword("p", "a", "b"), p="my-Claude", a=1_000_000, b=0) == 3.0
    assert one(spark, scoring.page_quality("x", F.lit(3), F.lit(8), F.lit(False)), x="## a\n```\n" + "y" * 3001) == 95
    assert one(spark, scoring.page_quality("x", F.lit(0), F.lit(0), F.lit(True)), x="") == 0
    assert one(spark, scoring.request_hash("a", F.lit(None).cast("string"), "b"), a="x", b="y") == __import__("hashlib").sha256(b"x||y").hexdigest()
    assert one(spark, scoring.short_id("x"), x="0190-abcd-ef01") == "0190abcd"


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8), st.data())
def test_repair_of_any_prefix_is_valid(value, data):
    import json

    whole = json.dumps({"k": value})
    assert json.loads(jsonx.repair(whole)) == {"k": value}
    cut = whole[: data.draw(st.integers(1, len(whole)))]
    got = jsonx.repair(cut)
    assert got is None or isinstance(json.loads(got), dict)


@pytest.mark.parametrize("raw,want", [('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": "x', {"a": "x"}), ('{"a": 1, "b": ', {"a": 1}), ("", None), ("nothing", None)])
def test_repair(raw, want):
    import json

    got = jsonx.repair(raw)
    assert (None if got is None else json.loads(got)) == want


def test_json_and_xml(spark):
    assert one(spark, jsonx.block("x"), x='a\n```json\n{"b": 1}\n```\n```\nno\n```') == '{"b": 1}'
    assert one(spark, jsonx.block("x"), x='say {"b": {"c": 1}} ok') == '{"b": {"c": 1}}'
    assert one(spark, jsonx.block("x"), x="none") is None
    assert one(spark, jsonx.probe("x", "$.no", "$.a"), x='{"a": 2}') == "2"
    assert one(spark, jsonx.or_raw("x", "$.a"), x="plain") == "plain"
    xml = "```xml\n<wiki><page id='1'><title>A & B</title></page><page><title>C</title></page></wiki>\n```"
    assert one(spark, jsonx.xml_pages("x"), x=xml) == ["A & B", "C"]
    assert one(spark, jsonx.xml_pages_by_pattern("x"), x="<page><title>A</title><page x=1><title> B </title>") == ["A", "B"]
    assert one(spark, jsonx.bytes_to_floats(jsonx.floats_to_bytes(F.array(F.lit(1.5), F.lit(-2.0)))), x="") == [1.5, -2.0]


def test_order_of_a_locale(spark):
    titles = ["深圳", "上海", "天津", "广州", "北京", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    ordered = lambda locale: [r["t"] for r in df.orderBy(text.in_locale("t", locale)).collect()]
    assert ordered("zh") == [None, "北京", "广州", "上海", "深圳", "天津"]
    swedish = spark.createDataFrame([(t,) for t in ("öl", "zebra", "ål", "apa")], "t string")
    assert [r["t"] for r in swedish.orderBy(text.in_locale("t", "sv")).collect()] == ["apa", "zebra", "ål", "öl"]
