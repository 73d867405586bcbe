"""Named queries over the files of a repository: documents stand for files, under paths of several kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import jsonx, text, tokens
from weftline.operators import checkpoints, code, graph, reports, search, windows
from weftline.plans.catalogue import Tables, query
from weftline.sources import files as sources
from weftline.sources import sinks

_FORMS = ["src/{s}/main{n}.go", "{s}/tests/t{n}.py", "docs/{s}-{n}.md", "{s}/app{n}.config.json", "lib/I{n}Interface.cs", "web/{s}/app.tsx", "README-{n}.md", "Program{n}.cs"]
_PATH = "CASE doc_id%8 " + " ".join(f"WHEN {i} THEN replace(replace('{f}','{{s}}',source),'{{n}}',doc_id::VARCHAR)" for i, f in enumerate(_FORMS)) + " END"
_FILES = f"f AS (SELECT doc_id, source, {_PATH} AS file_path, text FROM documents WHERE text IS NOT NULL)"


def _files(t: Tables) -> DataFrame:
    d = t("documents").where("text is not null")
    p = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % 8 + 1).cast("int"))
    p = F.replace(F.replace(p, F.lit("{s}"), F.col("source")), F.lit("{n}"), F.col("doc_id").cast("string"))
    return d.select("doc_id", p.alias("file_path"), F.octet_length("text").cast("long").alias("size_bytes"), F.encode("text", "UTF-8").alias("raw"))


@query(f"""WITH {_FILES} SELECT file_path, CASE WHEN contains(file_path,'/') THEN split_part(file_path,'/',1) ELSE 'root' END AS module_name,
CASE doc_id%8 WHEN 1 THEN 'test' WHEN 2 THEN 'doc' WHEN 3 THEN 'config' WHEN 6 THEN 'doc' ELSE 'source' END AS file_type, CASE doc_id%8 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 3 THEN 'json' WHEN 4 THEN 'csharp' WHEN 5 THEN 'typescript' WHEN 7 THEN 'csharp' ELSE 'other' END AS language,
(CASE doc_id%8 WHEN 0 THEN 7 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 15 WHEN 6 THEN 3 ELSE 5 END)::INT AS importance_score, doc_id%8=5 AS is_entry_point FROM f""")
def file_index(t: Tables) -> DataFrame:
    return sources.index(_files(t)).drop("size_bytes")


@query(f"""WITH {_FILES}, x AS (SELECT file_path, CASE doc_id%8 WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN 'root' WHEN 3 THEN source WHEN 4 THEN 'root' WHEN 5 THEN 'web' ELSE 'root' END AS module_name,
CASE doc_id%8 WHEN 1 THEN 'test' WHEN 2 THEN 'doc' WHEN 6 THEN 'doc' ELSE 'source' END AS file_type, (CASE doc_id%8 WHEN 0 THEN 8 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 10 WHEN 5 THEN 15 WHEN 6 THEN 1 ELSE 5 END)::INT AS importance_score FROM f),
e AS (SELECT file_path FROM (SELECT DISTINCT * FROM x) WHERE file_type='source' AND importance_score>=8 ORDER BY importance_score DESC, file_path LIMIT 10)
SELECT DISTINCT *, file_path IN (SELECT file_path FROM e) AS is_entry_point FROM x""")
def file_index_analysing(t: Tables) -> DataFrame:
    f = _files(t).dropDuplicates(["file_path"])
    return sources.index(f, analysing=True).drop("size_bytes", "language")


@query(f"""WITH {_FILES} SELECT file_path, sha256(text[1:50000]) AS content FROM (SELECT CASE WHEN doc_id%8=5 THEN 'web/'||doc_id||'/app.tsx' ELSE file_path END AS file_path, doc_id, text FROM f WHERE doc_id%8 IN (0,1,4,5,7) ORDER BY 1 LIMIT 500)""")
def source_file_window(t: Tables) -> DataFrame:
    one = _files(t).withColumn("file_path", F.when(F.col("doc_id") % 8 == 5, F.concat(F.lit("web/"), F.col("doc_id"), F.lit("/app.tsx"))).otherwise(F.col("file_path")))
    return sources.source_files(one).select("file_path", F.sha2("content", 256).alias("content"))


@query(f"""WITH {_FILES}, c AS (SELECT file_path, doc_id, doc_id%8 IN (0,1,4,5,7) AS is_code, (ceil((length(text)-length(regexp_replace(text,'{tokens.CJK}','','g')))/1.5)+ceil(length(regexp_replace(text,'{tokens.CJK}','','g'))/4.0))::INT AS token_count FROM f)
SELECT doc_id, file_path, is_code, token_count, is_code AND doc_id%8<>1 AS is_implementation FROM c WHERE token_count<=CASE WHEN is_code THEN 81920 ELSE 8192 END""")
def corpus_reader(t: Tables) -> DataFrame:
    return sources.corpus(_files(t)).select("doc_id", "file_path", "is_code", "token_count", "is_implementation")


@query(f"""WITH {_FILES} SELECT row_number() OVER (ORDER BY lower(file_path), file_path)::INT AS position, file_path FROM (SELECT DISTINCT file_path FROM f)""")
def repository_listing(t: Tables) -> DataFrame:
    return sources.listing(_files(t).select("file_path").distinct())


@query(f"""WITH {_FILES} SELECT 'readme' AS kind, 0 AS position, file_path FROM (SELECT * FROM f WHERE doc_id%8=6 ORDER BY length(file_path), file_path LIMIT 1) UNION ALL
SELECT 'known', row_number() OVER (ORDER BY file_path)::INT, file_path FROM (SELECT DISTINCT file_path FROM f WHERE doc_id%8 IN (2,6))""")
def readme_and_documents(t: Tables) -> DataFrame:
    f = _files(t).dropDuplicates(["file_path"])
    known = graph.ranked(sources.known_documents(f).select("priority", "file_path"), [F.col("priority"), F.col("file_path")], "position")
    return sources.readme(f).select(F.lit("readme").alias("kind"), F.lit(0).alias("position"), "file_path").unionByName(known.select(F.lit("known").alias("kind"), "position", "file_path"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS x, unnest(range(1,len(string_split(text,chr(10)))+1)) AS i, len(string_split(text,chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, string_agg(printf('%6d | %s', i, x), chr(10) ORDER BY i) FILTER (WHERE i BETWEEN 2 AND 11) || CASE WHEN max(n)>11 THEN printf(chr(10)||'... (%d more lines)', max(n)-11) ELSE '' END AS shown FROM l GROUP BY doc_id HAVING max(n)>=2""")
def line_gutter(t: Tables) -> DataFrame:
    d = t("documents").where("text is not null").where(F.size(F.split("text", "\n")) >= 2)
    return d.select("doc_id", text.numbered_lines("text", 2, 10).alias("shown"))


@query("""WITH w AS (SELECT n_nationkey AS k, unnest([n_nationkey, n_nationkey+1, -5, n_nationkey+2]) AS doc, unnest([0,1,2,3]) AS i FROM nation)
SELECT k, string_agg('// f'||doc_id||chr(10)||text[1:300], chr(10)||chr(10) ORDER BY i) AS text FROM w JOIN documents ON doc_id=doc WHERE text IS NOT NULL GROUP BY k""")
def joined_sources(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    want = t("nation").select(k.alias("k"), F.transform(F.array(k, k + 1, F.lit(-5), k + 2), lambda x: F.concat(F.lit("f"), x.cast("string"))).alias("list"))
    f = t("documents").where("text is not null").select(F.concat(F.lit("f"), "doc_id").alias("file_path"), F.col("text").alias("content"))
    return sources.joined_files(want, "k", "list", f, 300)


_MD = "'# T'||doc_id||chr(10)||'## First *part* '||doc_id||chr(10)||text[1:80]||chr(10)||'### Über `Sub`'||chr(10)||'####### none'"


@query(f"""WITH d AS (SELECT doc_id, replace(replace({_MD}, chr(13), ' '), '#x', 'x') AS m FROM documents WHERE text IS NOT NULL AND NOT contains(text[1:80], chr(10)))
SELECT doc_id, 'T'||doc_id||'|1|t'||doc_id||';First *part* '||doc_id||'|2|first-part-'||doc_id||';Über `Sub`|3|über-sub' AS outline FROM d""")
def markdown_outline(t: Tables) -> DataFrame:
    d = t("documents").where("text is not null").where(~F.contains(F.left("text", F.lit(80)), F.lit("\n")))
    m = F.concat(F.lit("# T"), "doc_id", F.lit("\n## First *part* "), "doc_id", F.lit("\n"), F.left("text", F.lit(80)), F.lit("\n### Über `Sub`\n####### none"))
    o = text.outline(m, F.concat(F.lit("T"), "doc_id"))
    return d.select("doc_id", F.array_join(F.transform(o, lambda x: F.concat_ws("|", x["title"], x["level"].cast("string"), x["anchor"])), ";").alias("outline"))


@query("""SELECT p_partkey, 2::BIGINT AS checked, CASE WHEN p_partkey%3=0 THEN 1 ELSE 2 END::BIGINT AS valid, CASE WHEN p_partkey%3=0 THEN 0.5 ELSE 1.0 END::DOUBLE AS rate, CASE WHEN p_partkey%3=0 THEN 'Ghost'||p_partkey ELSE '' END AS unknown FROM part""")
def authenticity(t: Tables) -> DataFrame:
    p = t("part")
    ghost = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Ghost"), "p_partkey")).otherwise(F.concat(F.lit("other"), "p_partkey"))
    pages = p.select("p_partkey", F.concat(F.lit("See `Part"), "p_partkey", F.lit("` and `"), ghost, F.lit("()` or `part"), "p_partkey", F.lit("`.")).alias("body"))
    known = p.select(F.concat(F.lit("Part"), "p_partkey").alias("name")).unionByName(p.select(F.concat(F.lit("Other"), "p_partkey").alias("name")))
    return code.authenticity(pages, "p_partkey", "body", known, "name").withColumn("unknown", F.array_join("unknown", ","))


@query("""SELECT p_partkey, p_name AS title, p_brand||'|'||p_type AS tags, 'a "'||p_partkey||'" & <b>' AS quoted, 'a &quot;'||p_partkey||'&quot; &amp; &lt;b&gt;' AS escaped FROM part""")
def front_matter_roundtrip(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit('a "'), "p_partkey", F.lit('" & <b>'))
    page = text.front_matter({"title": F.col("p_name"), "key": F.col("p_partkey")}, {"tags": F.array("p_brand", "p_type")}, F.concat(F.lit("# Other\n"), quoted))
    return t("part").select("p_partkey", jsonx.title_of(page).alias("title"), F.array_join(jsonx.front_matter_list(page, "tags"), "|").alias("tags"), F.regexp_extract(page, r"(?s)# Other\n(.*)$", 1).alias("quoted"), text.escape_xml(quoted).alias("escaped"))


@query("""SELECT item_id, CASE WHEN ceil(length(text)/4.0)<=10 THEN text ELSE text[1:40] END AS head, length(text)>0 AS any FROM benchmark""")
def truncated_to_tokens(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", tokens.truncate_to("text", 10).alias("head"), (F.length("text") > 0).alias("any"))


@query("""SELECT p_partkey, lpad(p_partkey::VARCHAR,7,'0') AS padded, p_name||','||p_brand AS lines, p_brand||'='||p_name AS plan, p_name||' '||p_brand AS collapsed, p_brand||'|'||(p_size/100.0)||'|a.cs|x|y' AS hint, p_name[1:5] AS first_chunk, 'public '||p_brand||' Run(int a)' AS signature, regexp_matches(lower(p_name||p_type),'steel|ring') AS any_word FROM part""")
def text_tools(t: Tables) -> DataFrame:
    p = t("part")
    name, brand = F.col("p_name"), F.col("p_brand")
    listed = F.array_join(text.multi_line_list(F.concat(F.lit("  "), name, F.lit("\r\n\n"), F.url_encode(brand), F.lit(" \n"))), ",")
    plan = text.numbered_outline(F.concat(F.lit('intro\n1. **"'), brand, F.lit('"**: '), name, F.lit("\n- no")))
    hint = text.parse_hint(F.concat_ws("|", brand, (F.col("p_size") / 100.0).cast("string"), F.lit(" a.cs "), F.lit("x|y")))
    return p.select(
        "p_partkey",
        text.left_pad_number("p_partkey", 7).alias("padded"),
        listed.alias("lines"),
        F.array_join(F.transform(plan, lambda x: F.concat_ws("=", x["title"], x["description"])), ";").alias("plan"),
        text.collapse(F.concat(F.lit(' "'), name, F.lit(" \n\t "), brand, F.lit("' "))).alias("collapsed"),
        F.concat_ws("|", hint["name"], hint["confidence"].cast("string"), hint["file"], hint["detail"]).alias("hint"),
        F.get(text.fixed_chunks(name, 5), 0).alias("first_chunk"),
        text.signature(F.concat(F.lit("public  "), brand, F.lit("\n Run(int a)\n { return 1; }"))).alias("signature"),
        text.has_any(F.concat(name, "p_type"), ["STEEL", "ring"]).alias("any_word"),
    )


@query("""SELECT p_partkey, p_name||'|'||p_brand||' & co' AS parsed, p_name||'|'||p_brand||' & co' AS matched FROM part""")
def xml_structure(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("Here:\n```xml\n<wiki><page id='1'><title>"), "p_name", F.lit("</title></page><page id='2'><title> "), "p_brand", F.lit(" & co</title></page></wiki>\n```\nDone"))
    clean = lambda a: F.array_join(F.transform(a, lambda x: F.trim(x)), "|")
    return t("part").select("p_partkey", clean(jsonx.xml_pages(noisy)).alias("parsed"), clean(jsonx.xml_pages_by_pattern(noisy)).alias("matched"))


@query("""SELECT 's'||s_suppkey||'.csproj' AS file_path, 'package' AS kind, 'Pack.N'||s_nationkey AS name FROM supplier UNION ALL SELECT 's'||s_suppkey||'.csproj', 'project', '../n'||s_nationkey||'.csproj' FROM supplier
UNION ALL SELECT 'n'||n_nationkey||'/package.json', 'package', lower(n_name) FROM nation UNION ALL SELECT 'r'||r_regionkey||'.sln', 'project', r_name FROM region""")
def project_references(t: Tables) -> DataFrame:
    s, n, r = t("supplier"), t("nation"), t("region")
    cs = s.select(F.concat(F.lit("s"), "s_suppkey", F.lit(".csproj")).alias("file_path"), F.concat(F.lit('<PackageReference Include="Pack.N'), "s_nationkey", F.lit('" Version="1"/><ProjectReference Include="../n'), "s_nationkey", F.lit('.csproj"/>')).alias("content"))
    js = n.select(F.concat(F.lit("n"), "n_nationkey", F.lit("/package.json")).alias("file_path"), F.concat(F.lit('{"dependencies": {"'), F.lower("n_name"), F.lit('": "1", "@types/x": "2"}}')).alias("content"))
    sln = r.select(F.concat(F.lit("r"), "r_regionkey", F.lit(".sln")).alias("file_path"), F.concat(F.lit('Project("{1}") = "'), "r_name", F.lit('", "x.csproj"')).alias("content"))
    return code.project_references(cs.unionByName(js).unionByName(sln))


def _sources(t: Tables) -> DataFrame:
    """A C# file for each supplier: a class with a base, two methods, a call each."""
    k = F.col("s_suppkey")
    body = F.concat(F.lit("using Lib.N"), "s_nationkey", F.lit(";\n[Table]\npublic class Supplier"), k, F.lit("Repository : Base"), "s_nationkey", F.lit("\n{\n    public int Find"), k, F.lit("(int id)\n    {\n        return Help"), k % 7, F.lit("(id);\n    }\n    private static void Run"), k, F.lit("()\n    {\n        Find"), k, F.lit("(1);\n    }\n}\n"))
    return t("supplier").select(F.concat(F.lit("m"), "s_nationkey", F.lit("/s"), k, F.lit(".cs")).alias("file_path"), body.alias("content"), k.alias("s_suppkey"))


_SRC = "s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'm'||s_nationkey||'/s'||s_suppkey||'.cs' AS file_path FROM supplier)"


@query(f"""WITH {_SRC} SELECT file_path, 'class' AS kind, 'Supplier'||k||'Repository' AS name, 'public class Supplier'||k||'Repository : Base'||n AS signature, 3 AS start_line, 13 AS end_line, '' AS parent, 'public' AS modifiers, 'Base'||n AS bases, '[Table]' AS attributes, NULL AS callee FROM s
UNION ALL SELECT file_path, 'function', 'Find'||k, 'public int Find'||k||'(int id)', 5, 8, 'Supplier'||k||'Repository', 'public', '', '', NULL FROM s UNION ALL SELECT file_path, 'function', 'Run'||k, 'private static void Run'||k||'()', 9, 12, 'Supplier'||k||'Repository', 'private static', '', '', NULL FROM s
UNION ALL SELECT file_path, 'call', 'Supplier'||k||'Repository.Find'||k, NULL, 7, 7, NULL, '', '', '', 'Help'||k%7 FROM s UNION ALL SELECT file_path, 'call', 'Supplier'||k||'Repository.Run'||k, NULL, 11, 11, NULL, '', '', '', 'Find'||k FROM s""")
def source_symbols(t: Tables) -> DataFrame:
    rows = code.source_symbols(_sources(t)).drop("language")
    return rows.withColumns({c: F.array_join(c, " ") for c in ("modifiers", "bases", "attributes")})


#: Lines of a source file for each part, in three languages, with strings and comments that look like code; {k} the key, {b} the brand, {g} the key modulo 5.
_TRICKY = {
    "cs": ["public class P{k} : {b}", "{{", '    string s = "}}}} class X{k} {{"; // }} void No() {{', "    int Size{k}(int a)", "    {{", '        return Go{g}("(" + a); /* Hid() }} */', "    }}", "}}"],
    "py": ["class P{k}:", '    """class No{k}: {b}"""', '    def size{k}(self, a=")"):', "        # Hid()", "        return go{g}(a)", "", "X = 'def no(): pass'"],
    "ts": ["export function run{k}(a: string) {{", "  const t = `}}${{go{g}(a)}} {{`;", "  return t; // }} {b}", "}}"],
}


def _tricky_sources(t: Tables) -> DataFrame:
    values = {"{k}": F.col("p_partkey").cast("string"), "{b}": F.regexp_replace("p_brand", "\\W", ""), "{g}": (F.col("p_partkey") % 5).cast("string")}

    def text(lines: list[str]) -> Column:
        out = F.lit("\n".join(lines).replace("{{", "{").replace("}}", "}"))
        for name, value in values.items():
            out = F.replace(out, F.lit(name), value)
        return out

    n, body = F.col("p_partkey") % 3, {k: text(v) for k, v in _TRICKY.items()}
    end = F.when(n == 0, "cs").when(n == 1, "py").otherwise("ts")
    return t("part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit("."), end).alias("file_path"), F.when(n == 0, body["cs"]).when(n == 1, body["py"]).otherwise(body["ts"]).alias("content"))


def _tricky_text(ext: str, first: int, last: int) -> str:
    lines = "\n".join(_TRICKY[ext][first - 1 : last]).replace("{{", "{").replace("}}", "}").replace("'", "''")
    parts = lines.replace("{k}", "'||k||'").replace("{b}", "'||b||'").replace("{g}", "'||g||'").replace("\n", "'||chr(10)||'")
    return f"'{parts}'"


_TRICKY_SQL = "p AS (SELECT p_partkey AS k, regexp_replace(p_brand, '[^0-9A-Za-z_]', '', 'g') AS b, p_partkey % 5 AS g, p_partkey % 3 AS n FROM part)"


@query(f"""WITH {_TRICKY_SQL} SELECT 'src/p'||k||'.cs' AS file_path, 'class' AS kind, 'P'||k AS name, 1 AS start_line, 8 AS end_line, '' AS parent FROM p WHERE n = 0
UNION ALL SELECT 'src/p'||k||'.cs', 'function', 'Size'||k, 4, 7, 'P'||k FROM p WHERE n = 0 UNION ALL SELECT 'src/p'||k||'.py', 'class', 'P'||k, 1, 5, '' FROM p WHERE n = 1
UNION ALL SELECT 'src/p'||k||'.py', 'function', 'size'||k, 3, 5, 'P'||k FROM p WHERE n = 1 UNION ALL SELECT 'src/p'||k||'.ts', 'function', 'run'||k, 1, 4, '' FROM p WHERE n = 2""")
def lexed_symbols(t: Tables) -> DataFrame:
    """Declarations of texts whose strings and comments hold brackets, keywords and calls."""
    return code.source_symbols(_tricky_sources(t)).where("kind <> 'call'").select("file_path", "kind", "name", "start_line", "end_line", "parent")


@query(f"""WITH {_TRICKY_SQL} SELECT CASE n WHEN 0 THEN 'P'||k||'.Size'||k WHEN 1 THEN 'P'||k||'.size'||k ELSE 'run'||k END AS caller, CASE n WHEN 0 THEN 'Go' ELSE 'go' END||g AS callee, CASE n WHEN 0 THEN 6 WHEN 1 THEN 5 ELSE 2 END AS line FROM p""")
def lexed_calls(t: Tables) -> DataFrame:
    return code.source_symbols(_tricky_sources(t)).where("kind = 'call'").select(F.col("name").alias("caller"), "callee", F.col("start_line").alias("line"))


@query(f"""WITH {_TRICKY_SQL} SELECT 'src/p'||k||'.cs' AS file_path, 1 AS start_line, 8 AS end_line, 'class' AS label, sha256({_tricky_text("cs", 1, 8)}) AS content FROM p WHERE n = 0
UNION ALL SELECT 'src/p'||k||'.cs', 4, 7, 'function', sha256({_tricky_text("cs", 4, 7)}) FROM p WHERE n = 0 UNION ALL SELECT 'src/p'||k||'.py', 1, 5, 'class', sha256({_tricky_text("py", 1, 5)}) FROM p WHERE n = 1
UNION ALL SELECT 'src/p'||k||'.py', 3, 5, 'function', sha256({_tricky_text("py", 3, 5)}) FROM p WHERE n = 1 UNION ALL SELECT 'src/p'||k||'.ts', 1, 4, 'function', sha256({_tricky_text("ts", 1, 4)}) FROM p WHERE n = 2""")
def declaration_chunks(t: Tables) -> DataFrame:
    return code.source_chunks(_tricky_sources(t)).withColumn("content", F.sha2("content", 256))


@query(f"""WITH {_SRC} SELECT 'Supplier'||k||'Repository.Run'||k AS caller_symbol, 'Find'||k AS callee_symbol, file_path AS callee_file_path, CAST(0.9 AS DOUBLE) AS confidence FROM s""")
def call_edges(t: Tables) -> DataFrame:
    rows = code.source_symbols(_sources(t))
    return code.call_edges(rows.where("kind = 'function'").select("name", "file_path"), rows.where("kind = 'call'").select("name", "file_path", "callee")).select("caller_symbol", "callee_symbol", "callee_file_path", F.col("confidence").cast("double").alias("confidence"))


@query(f"""WITH {_SRC} SELECT file_path, '- class `Supplier'||k||'Repository` : Base'||n||chr(10)||'  - `public int Find'||k||'(int id)`'||chr(10)||'  - `private static void Run'||k||'()`' AS text FROM s""")
def type_hierarchy(t: Tables) -> DataFrame:
    return code.hierarchy_report(code.source_symbols(_sources(t)))


@query(f"""WITH {_SRC} SELECT 'Repository' AS pattern, 'm'||n AS module, CAST(0.95 AS DOUBLE) AS confidence, count(*) AS n_files, array_to_string(list_sort(list(DISTINCT 'Supplier'||k||'Repository'))[1:5], ',') AS evidence FROM s GROUP BY n""")
def pattern_evidence(t: Tables) -> DataFrame:
    f = _sources(t)
    return code.patterns(code.pattern_hints(code.source_symbols(f), f)).withColumns({"evidence": F.array_join("evidence", ","), "confidence": F.col("confidence").cast("double")})


@query(f"""WITH {_SRC}, c AS (SELECT 'Find'||k AS name, 'function' AS kind, file_path FROM s UNION ALL SELECT 'Supplier'||k||'Repository', 'class', file_path FROM s)
SELECT 'search' AS tool, name, file_path FROM (SELECT * FROM c WHERE contains(lower(name),'find1') AND kind='function' ORDER BY name, file_path LIMIT 10) UNION ALL SELECT 'class', name, file_path FROM (SELECT * FROM c WHERE lower(name)='supplier3repository' AND kind='class' LIMIT 5)
UNION ALL SELECT 'like', 'Supplier'||k||'Repository', file_path FROM (SELECT * FROM s WHERE contains(lower('Supplier'||k||'Repository'), 'supplier1') ORDER BY file_path LIMIT 5)""")
def symbol_lookups(t: Tables) -> DataFrame:
    rows = code.source_symbols(_sources(t)).where("kind <> 'call'")
    out = search.symbols(rows, "FIND1", "Function").select(F.lit("search").alias("tool"), "name", "file_path")
    out = out.unionByName(search.definitions(rows, "supplier3repository").select(F.lit("class").alias("tool"), "name", "file_path"))
    exported = rows.where("kind = 'class'").groupBy("file_path").agg(F.collect_set("name").alias("exported_symbols"))
    return out.unionByName(search.definitions_like(exported, "SUPPLIER1").select(F.lit("like").alias("tool"), F.get("exported_symbols", 0).alias("name"), "file_path"))


@query("""WITH m AS (SELECT CASE n_nationkey%3 WHEN 0 THEN 'Web.Api' WHEN 1 THEN 'Core' ELSE 'Data' END AS n FROM nation)
SELECT CASE WHEN bool_or(regexp_matches(n,'Api|Controller')) AND bool_or(regexp_matches(n,'Core|Service')) AND bool_or(regexp_matches(n,'Repository|Data')) THEN 'layered' ELSE 'modular' END AS architecture FROM m""")
def architecture(t: Tables) -> DataFrame:
    names = F.element_at(F.array(F.lit("Web.Api"), F.lit("Core"), F.lit("Data")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return graph.architecture(t("nation").select(names.alias("n")), "n")


@query("""WITH l AS (SELECT doc_id, string_split(text,chr(10)) AS ls FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, ls, unnest(range(0, greatest(0, ceil((len(ls)-5)/5.0)::INT*5)+1, 5)) AS i FROM l)
SELECT doc_id, (i+1)::INT AS start_line, least(i+5,len(ls))::INT AS end_line, sha256(array_to_string(ls[i+1:i+5],chr(10))) AS content FROM s WHERE i//5<3""")
def snippet_corpus(t: Tables) -> DataFrame:
    d = t("documents").where("text is not null").select("doc_id", "text")
    return search.snippets(d, "doc_id", "text", 5, 3).select("doc_id", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.sha2("content", 256).alias("content"))


@query("""WITH h AS (SELECT c_nationkey AS q, 'f'||(c_custkey%3) AS p, c_name AS c, c_custkey AS i FROM customer WHERE c_custkey%10=0), b AS (SELECT q, p, min(i) AS f, string_agg('```'||chr(10)||c||chr(10)||'```', chr(10) ORDER BY i) AS b FROM h GROUP BY 1,2)
SELECT q, string_agg('### '||p||chr(10)||b, chr(10)||chr(10) ORDER BY f) AS text FROM b GROUP BY q""")
def rendered_hits(t: Tables) -> DataFrame:
    h = t("customer").where("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("q"), F.concat(F.lit("f"), F.col("c_custkey") % 3).alias("p"), F.col("c_name").alias("c"), F.col("c_custkey").alias("i"))
    return search.render(h, "q", "p", "c", "i")


@query("""WITH m AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) AS r FROM (SELECT DISTINCT c_nationkey FROM customer)), w AS (SELECT c_nationkey, ((r-1)//2+1)::INT AS worker FROM m),
f AS (SELECT worker, c_name, row_number() OVER (PARTITION BY worker ORDER BY c_acctbal DESC, c_name) AS k FROM customer JOIN w USING (c_nationkey))
SELECT worker, (SELECT string_agg(c_nationkey, ',' ORDER BY c_nationkey) FROM w x WHERE x.worker=f.worker) AS modules, string_agg(c_name, ',' ORDER BY k) FILTER (WHERE k<=30) AS key_files, count(*) AS n_files FROM f GROUP BY worker""")
def worker_assignment(t: Tables) -> DataFrame:
    c = t("customer")
    out = windows.assigned(c.select("c_nationkey"), c, "c_nationkey", "c_name", "c_acctbal")
    return out.select("worker", F.array_join(F.col("modules").cast("array<string>"), ",").alias("modules"), F.array_join("key_files", ",").alias("key_files"), "n_files")


@query("""SELECT n_nationkey||'.md' AS file_path, n_name AS content, length('# '||n_name)::BIGINT AS size_bytes FROM nation""")
def repository_scan(t: Tables) -> DataFrame:
    """25 files under a folder of the store, and two that a scan leaves out; read back as binary files."""
    n = t("nation")
    spark = n.sparkSession
    root = checkpoints.new_folder(spark, "repository")
    for r in n.select("n_nationkey", "n_name").collect():  # a dimension table of 25 rows
        sinks.write_text(spark, f"{root}/{r['n_nationkey']}.md", f"# {r['n_name']}")
    sinks.write_text(spark, f"{root}/node_modules/x.md", "no")
    sinks.write_text(spark, f"{root}/yarn.lock", "no")
    f = sources.content(sources.repository(spark, root))
    return f.select("file_path", F.regexp_extract("content", "^# (.*)$", 1).alias("content"), "size_bytes")


@query("""SELECT s_nationkey AS module, count(*)*2 AS symbols, count(*) AS files FROM supplier GROUP BY 1 UNION ALL SELECT -1, count(*)*2, count(*) FROM supplier""")
def analysis_artifacts(t: Tables) -> DataFrame:
    """Artifacts of files written as JSON and scanned by their fixed schema; totals by module, and of all (module -1)."""
    s = t("supplier")
    spark = s.sparkSession
    symbol = lambda p: F.struct(F.concat(F.lit(p), "s_suppkey").alias("name"), F.lit("class").alias("kind"))
    path = checkpoints.new_folder(spark, "artifacts")
    sinks.json_lines(s.select(F.concat("s_nationkey", F.lit("/x.cs")).alias("file_path"), F.array(symbol("A"), symbol("B")).alias("symbols")), path)
    scanned = spark.read.schema(sources.schemas.AST_FILE).json(path)
    keyed = scanned.withColumn("module", F.split("file_path", "/")[0].cast("int"))
    by = keyed.groupBy("module").agg(F.sum(F.size("symbols")).cast("long").alias("symbols"), F.count("*").alias("files"))
    whole = reports.projection_totals(scanned).select(F.lit(-1).alias("module"), F.col("symbols").cast("long").alias("symbols"), "files")
    return by.unionByName(whole)
