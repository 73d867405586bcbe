"""Source analysis by regular expressions, and by Python's own parser for Python files.

Native parsers of other languages are not at hand; their declarations are found in the code that a lexical automaton leaves
(`lexing`), with scopes by brackets, by ``end``, or by indentation (`declarations`). A file is analysed on its own, all of it; files are
independent rows. Patterns alone (`analyse`), and Python's own parser, take its first MOST_CHARS characters.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import paths, tokens
from weftline.functions.text import _C, col
from weftline.operators.declarations import Source

_BRACES_TYPE = r"\b(?:class|interface|struct|record|enum|trait|protocol)\s+(\w+)"
_JS_FUNCTION = r"\bfunction\s+(\w+)"
_JS_IMPORT = r"(?:\bfrom\s+|require\(|\bimport\s+)['\"]([^'\"]+)['\"]"
#: AST-02: for each of the 13 languages, patterns of one group for types, functions, imports and calls.
PATTERNS = {
    "csharp": (_BRACES_TYPE, r"\b(?:public|private|protected|internal|static|async|override|virtual)\s+[\w<>\[\],?]+\s+(\w+)\s*\(", r"(?m)^\s*using\s+([\w.]+)\s*;", r"(\w+)\s*\("),
    "typescript": (r"\b(?:class|interface|enum|type)\s+(\w+)", _JS_FUNCTION, _JS_IMPORT, r"(\w+)\s*\("),
    "javascript": (r"\bclass\s+(\w+)", _JS_FUNCTION, _JS_IMPORT, r"(\w+)\s*\("),
    "python": (r"(?m)^[^\S\n]*class\s+(\w+)", r"(?m)^[^\S\n]*(?:async\s+)?def\s+(\w+)", r"(?m)^\s*(?:from|import)\s+([\w.]+)", r"(\w+)\s*\("),
    "go": (r"(?m)^type\s+(\w+)\s+(?:struct|interface)", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", r"(?m)^\s*(?:import\s+)?\"([\w./-]+)\"\s*$", r"(\w+)\s*\("),
    "rust": (r"\b(?:struct|trait|enum)\s+(\w+)", r"\bfn\s+(\w+)", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", r"(\w+)\s*\("),
    "java": (_BRACES_TYPE, r"\b(?:public|private|protected|static)\s+[\w<>\[\]]+\s+(\w+)\s*\(", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", r"(\w+)\s*\("),
    "cpp": (r"\b(?:class|struct)\s+(\w+)", r"(?m)^[\w:<>*&~ \t]+[\s*&:](\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{", r"(?m)^\s*#include\s+[<\"]([^>\"]+)[>\"]", r"(\w+)\s*\("),
    "c": (r"\bstruct\s+(\w+)\s*\{", r"(?m)^[\w* \t]+[\s*](\w+)\s*\([^;{}]*\)\s*\{", r"(?m)^\s*#include\s+[<\"]([^>\"]+)[>\"]", r"(\w+)\s*\("),
    "php": (r"\b(?:class|interface|trait)\s+(\w+)", _JS_FUNCTION, r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", r"(\w+)\s*\("),
    "ruby": (r"(?m)^[^\S\n]*(?:class|module)\s+(\w+)", r"(?m)^[^\S\n]*def\s+(?:self\.)?(\w+[?!]?)", r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"(\w+[?!]?)\s*\("),
    "swift": (r"\b(?:class|struct|protocol|enum)\s+(\w+)", r"\bfunc\s+(\w+)", r"(?m)^\s*import\s+([\w.]+)", r"(\w+)\s*\("),
    "scala": (r"\b(?:class|trait|object)\s+(\w+)", r"\bdef\s+(\w+)", r"(?m)^\s*import\s+([\w.]+)", r"(\w+)\s*\("),
}
#: Words before brackets that are no calls, and words before a declaration's keyword or name that modify it.
NO_CALLS = frozenset(["if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock", "fixed", "sizeof", "typeof", "nameof", "function", "func", "fn", "def", "new", "elif", "except", "with", "and", "or", "not", "in", "match", "when", "guard", "print"])
MODIFIERS = frozenset(["public", "private", "protected", "internal", "static", "async", "override", "virtual", "abstract", "sealed", "partial", "readonly", "final", "export", "default", "pub", "open", "unsafe", "const", "extern", "inline", "fileprivate", "synchronized"])
#: Symbols, imports and chunks that one file yields at most to patterns alone, types and functions apart.
MOST_TYPES, MOST_FUNCTIONS, MOST_IMPORTS, CHUNK_LINES, MOST_CHUNKS = 50, 50, 30, 80, 50
MOST_CHARS = 100_000
#: Characters of rows that are handed on at once.
FRAME_CHARS = 8_000_000


def _language(path: _C) -> Column:
    return F.replace(paths.language(path, "analysis"), F.lit("tsx"), F.lit("typescript"))


def _by_language(lang: _C, source: _C, which: int, most: int) -> Column:
    out = F.array().cast("array<string>")
    for name, patterns in reversed(PATTERNS.items()):
        out = F.when(col(lang) == name, F.slice(F.regexp_extract_all(F.left(col(source), F.lit(MOST_CHARS)), F.lit(patterns[which]), 1), 1, most)).otherwise(out)
    return out


def analyse(files: DataFrame, path: str = "file_path", source: str = "content", lang: str | None = None) -> DataFrame:
    """AST-01, STR-29: path, language, types, functions, imports, chunks; languages without patterns have chunks alone."""
    named = files.withColumn("language", F.col(lang) if lang else _language(path))
    arrays = {"types": (0, MOST_TYPES), "functions": (1, MOST_FUNCTIONS), "imports": (2, MOST_IMPORTS)}
    return named.select(path, "language", *[F.array_distinct(_by_language("language", source, w, m)).alias(k) for k, (w, m) in arrays.items()], F.slice(tokens.line_windows(source, CHUNK_LINES, 0), 1, MOST_CHUNKS).alias("chunks"))


def symbols(analysed: DataFrame, path: str = "file_path") -> DataFrame:
    """AST-03: (file_path, language, kind, name), one row a symbol."""
    each = lambda kind, c: analysed.select(F.col(path).alias("file_path"), "language", F.lit(kind).alias("kind"), F.explode(c).alias("name"))
    return each("type", "types").unionByName(each("function", "functions"))


def _source(text: str | None, language: str) -> Source:
    return Source(text or "", language, PATTERNS[language][0], PATTERNS[language][1], MODIFIERS)


def analysed_rows(path: str | None, text: str | None, language: str) -> Iterator[tuple]:
    """Rows of one file: a declaration each, then a call each, with the callable around it; none for a language without patterns."""
    if language not in PATTERNS:
        return
    source, seen = _source(text, language), set()
    for d in source.declarations:
        key = (source.line(d.at), source.line(max(d.at, d.end - 1)), d.name)
        if key in seen:
            continue
        seen.add(key)
        yield path, language, d.kind, d.name, d.signature, key[0], key[1], source.parent(d), d.modifiers, d.bases, d.attributes, None
    places, calls = {d.at for d in source.declarations}, set()
    for m in re.finditer(PATTERNS[language][3], source.code):
        if m[1] in NO_CALLS or m.start(1) in places or m[1][0].isdigit():
            continue
        caller = source.caller(m.start(1))
        if caller is None:
            continue
        owner = source.parent(caller)
        name = f"{owner}.{caller.name}" if owner else caller.name
        if (name, m[1]) not in calls:
            calls.add((name, m[1]))
            yield path, language, "call", name, None, source.line(m.start(1)), source.line(m.start(1)), None, [], [], [], m[1]


_SYMBOL = "file_path string, language string, kind string, name string, signature string, start_line int, end_line int, parent string, modifiers array<string>, bases array<string>, attributes array<string>, callee string"


#: Tasks for each core among which the files of an analysis are dealt.
TASKS_A_CORE = 8


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt evenly over all cores: sources are small beside the work that they make, so that scans give them to few tasks."""
    return files.repartition(TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism)


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of some FRAME_CHARS characters, however many a file yields."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= FRAME_CHARS:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    yield pd.DataFrame(held, columns=names)


def source_symbols(files: DataFrame, path: str = "file_path", source: str = "content") -> DataFrame:
    """AST-01, AST-03, AST-05 for all languages of PATTERNS: a row for each declaration (kind class, interface, struct, record, enum or function) and each distinct call (kind call, name of the callable around it).

    Null or empty texts, and languages without patterns, give no rows.
    """
    names = [x.split()[0] for x in _SYMBOL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _frames((r for x in zip(b["p"], b["s"], b["g"], strict=True) for r in analysed_rows(*x)), names)

    return _dealt(files.select(F.col(path).alias("p"), F.col(source).alias("s"), _language(path).alias("g"))).mapInPandas(run, _SYMBOL)


#: AST-06, fixed values: pattern, confidence, pattern of a type's name (case aside), and of a text that must be there as well.
HEURISTICS = [
    ("Factory", 0.9, "factory", r"\bnew\s+\w"),
    ("Observer", 0.8, "", r"\bevent\s"),
    ("Builder", 0.85, "builder", r"(?i)\bbuild\("),
    ("Repository", 0.95, "repository", ""),
    ("Mediator", 0.8, "mediator|orchestrator|coordinator", ""),
]
STRATEGY = ("Strategy", 0.85, "strategy|policy|handler|processor", 2)
SINGLETON, MEDIATOR_FIELDS = ("Singleton", 0.9), 3


def chunk_rows(path: str | None, text: str | None, language: str) -> Iterator[tuple]:
    """Rows of one file: a chunk for each declaration, or its lines in windows."""
    if not text:
        return
    found = False
    for chunk in _source(text, language).chunks() if language in PATTERNS else ():
        found = True
        yield path, *chunk
    if not found:
        lines = text.split("\n")
        for i in range(0, len(lines), CHUNK_LINES):
            yield path, i + 1, min(i + CHUNK_LINES, len(lines)), "lines", "\n".join(lines[i : i + CHUNK_LINES])


def source_chunks(files: DataFrame, path: str = "file_path", source: str = "content") -> DataFrame:
    """AST-04: (file_path, start_line, end_line, label, content): a chunk for each declaration of three lines or more, of the whole text.

    A file without any, or in a language without patterns, is cut into windows of CHUNK_LINES lines (label lines), all of it.
    Null or empty texts give no rows.
    """
    names = ["file_path", "start_line", "end_line", "label", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _frames((r for x in zip(b["p"], b["s"], b["g"], strict=True) for r in chunk_rows(*x)), names)

    return _dealt(files.select(F.col(path).alias("p"), F.col(source).alias("s"), _language(path).alias("g"))).mapInPandas(run, "file_path string, start_line int, end_line int, label string, content string")


def pattern_hints(symbol_rows: DataFrame, files: DataFrame, path: str = "file_path", source: str = "content") -> DataFrame:
    """AST-06: (file_path, pattern, confidence, detail): the seven heuristics, each at most once a file, with the first type it holds for.

    ``symbol_rows`` as of ``source_symbols``. Types are in the order of their lines; Repository takes any type, Strategy an
    interface with two classes of the same file or more that have it as a base, the others a class.
    """
    types = symbol_rows.where(F.col("kind").isin("class", "interface", "record", "struct"))
    kept = F.struct("start_line", "name", "kind", "bases")
    by_file = types.groupBy("file_path").agg(F.array_sort(F.collect_set(kept)).alias("types")).join(files.select(F.col(path).alias("file_path"), F.col(source).alias("_x")), "file_path")
    classes = F.filter("types", lambda t: t["kind"] == "class")
    first = lambda items, pattern: F.get(F.transform(F.filter(items, lambda t: F.lower(t["name"]).rlike(pattern)), lambda t: t["name"]), 0)
    fields = F.size(F.regexp_extract_all("_x", F.lit(r"(?m)^\s*(?:(?:private|public|protected|internal|static|readonly)\s+)+[\w<>\[\],?]+\s+\w+\s*(?:=[^;\n]*)?;"), 0))
    hints = []
    for name, confidence, pattern, also in HEURISTICS:
        detail = first(F.col("types") if name == "Repository" else classes, pattern)
        ok = F.col("_x").rlike(also) if also else fields >= MEDIATOR_FIELDS if name == "Mediator" else F.lit(True)
        hints.append((name, confidence, F.when(ok, detail)))
    only = first(classes, "")
    holds = lambda x: F.regexp_like("_x", F.concat(F.lit(x[0]), only, F.lit(x[1])))
    hints.append((*SINGLETON, F.when(holds((r"private\s+", r"\s*\(")) & holds((r"static\s+(?:readonly\s+)?", r"\s+\w*Instance")), only)))
    name, confidence, pattern, least = STRATEGY
    implementers = lambda i: F.filter(classes, lambda c: F.exists(c["bases"], lambda b: F.lower(b) == F.lower(i["name"])))
    interface = F.get(F.filter("types", lambda t: (t["kind"] == "interface") & F.lower(t["name"]).rlike(pattern)), 0)
    hints.append((name, confidence, F.when(F.size(implementers(interface)) >= least, interface["name"])))
    each = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(c).alias("confidence"), d.alias("detail")) for n, c, d in hints])
    return by_file.select("file_path", F.explode(F.filter(each, lambda h: h["detail"].isNotNull())).alias("h")).select("file_path", "h.*")


def call_report(edges: DataFrame, most: int = 30, callees: int = 10) -> DataFrame:
    """AGG-14 as text: (position, line) of the callers with most calls: name, first file, first callees, highest confidence."""
    from weftline.operators import graph

    e = edges.where("caller_symbol <> '' and callee_symbol <> ''")
    top = graph.top_callers(e, "caller_symbol", "callee_symbol", most, callees, "caller_file_path", "confidence")
    quoted = F.array_join(F.transform("callees", lambda c: F.concat(F.lit("`"), c, F.lit("`"))), ", ")
    text = F.concat(F.lit("- `"), "caller_symbol", F.lit("` ("), paths.base_name("first_file"), F.lit(") → "), quoted, F.lit(" ["), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit(" %]"))
    return top.select(F.struct(-F.col("n_calls"), "caller_symbol").alias("position"), text.alias("line"))


def hierarchy_report(symbol_rows: DataFrame, most: int = 20) -> DataFrame:
    """JN-10 as text: (file_path, text) of a file's types with their bases and their first methods' signatures."""
    types = symbol_rows.where(F.col("kind").isin("class", "interface", "struct", "record", "enum")).select("file_path", F.col("name").alias("type"), "kind", "bases", F.col("start_line").alias("_at"))
    methods = symbol_rows.where("kind = 'function' and parent <> ''").groupBy("file_path", F.col("parent").alias("type")).agg(F.transform(F.array_sort(F.collect_set(F.struct("start_line", "signature"))), lambda x: x["signature"]).alias("methods"))
    j = types.join(methods, ["file_path", "type"], "left")
    none = F.array().cast("array<string>")
    head = F.concat(F.lit("- "), "kind", F.lit(" `"), "type", F.lit("`"), F.when(F.size("bases") > 0, F.concat(F.lit(" : "), F.array_join("bases", ", "))).otherwise(F.lit("")))
    rows = F.transform(F.slice(F.coalesce("methods", none), 1, most), lambda m: F.concat(F.lit("  - `"), m, F.lit("`")))
    more = F.size(F.coalesce("methods", none)) - most
    tail = F.when(more > 0, F.array(F.concat(F.lit("  - ... "), more.cast("string"), F.lit(" more")))).otherwise(none)
    lines = F.array_join(F.concat(F.array(head), rows, tail), "\n")
    return j.select("file_path", F.struct("_at", "type", lines.alias("_t")).alias("_s")).groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["_t"]), "\n").alias("text"))


def python_symbols(files: DataFrame, path: str = "file_path", source: str = "content") -> DataFrame:
    """AST-03, AST-05 for Python: (file_path, kind, name, parent, start_line, end_line, callee) by its own parser; files that do not parse give no row.

    kind is class, function or call; a call has the enclosing function as its name.
    """

    def walk(tree: ast.AST, parent: str) -> Iterator[tuple]:
        for node in ast.iter_child_nodes(tree):
            name = parent
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                yield kind, node.name, parent, node.lineno, node.end_lineno, None
                name = node.name
            elif isinstance(node, ast.Call):
                f = node.func
                callee = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if callee:
                    yield "call", parent, None, node.lineno, node.end_lineno, callee
            yield from walk(node, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, s in zip(b[path], b[source], strict=True):
                try:
                    rows += [(p, *x) for x in walk(ast.parse((s or "")[:MOST_CHARS]), "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["file_path", "kind", "name", "parent", "start_line", "end_line", "callee"])

    return files.select(path, source).mapInPandas(run, "file_path string, kind string, name string, parent string, start_line int, end_line int, callee string")


def call_edges(symbol_rows: DataFrame, calls: DataFrame) -> DataFrame:
    """AST-05, JN-09: calls resolved to (name, file) of a definition: same file first (confidence 0.9), else the first of that name (0.7)."""
    defs = symbol_rows.select("name", "file_path").distinct()
    anywhere = defs.groupBy("name").agg(F.min("file_path").alias("_any"))
    here = defs.select(F.col("name").alias("callee"), F.col("file_path"), F.lit(True).alias("_here"))
    j = calls.join(here, ["callee", "file_path"], "left").join(anywhere.withColumnRenamed("name", "callee"), "callee")
    return j.select(F.col("name").alias("caller_symbol"), F.col("file_path").alias("caller_file_path"), F.col("callee").alias("callee_symbol"), F.when(F.col("_here"), F.col("file_path")).otherwise(F.col("_any")).alias("callee_file_path"), F.when(F.col("_here"), 0.9).otherwise(0.7).alias("confidence"))


def patterns(hints: DataFrame) -> DataFrame:
    """AGG-24: (pattern, module, confidence, n_files, evidence): hints of files by pattern and module, with the first of their details."""
    named = hints.withColumn("module", paths.module_last("file_path"))
    return named.groupBy("pattern", "module").agg(F.max("confidence").alias("confidence"), F.countDistinct("file_path").alias("n_files"), F.slice(F.array_sort(F.collect_set("detail")), 1, 5).alias("evidence"))


def project_references(files: DataFrame, path: str = "file_path", source: str = "content") -> DataFrame:
    """STR-30: (file_path, kind, name): package and project references of csproj, solution and package.json files."""
    c = F.col(source)
    kinds = {
        ("package", ".csproj"): F.regexp_extract_all(c, F.lit(r"<PackageReference\s+Include=\"([^\"]+)\""), 1),
        ("project", ".csproj"): F.regexp_extract_all(c, F.lit(r"<ProjectReference\s+Include=\"([^\"]+)\""), 1),
        ("project", ".sln"): F.regexp_extract_all(c, F.lit(r"(?m)^Project\([^)]*\)\s*=\s*\"([^\"]+)\""), 1),
        ("package", "package.json"): F.filter(F.map_keys(F.from_json(F.coalesce(F.get_json_object(c, "$.dependencies"), F.lit("{}")), "map<string,string>")), lambda k: ~k.startswith("@types/")),
    }
    out = None
    for (kind, end), found in kinds.items():
        df = files.where(F.lower(path).endswith(end)).select(F.col(path).alias("file_path"), F.lit(kind).alias("kind"), F.explode(found).alias("name"))
        out = df if out is None else out.unionByName(df)
    return out.distinct()


def authenticity(content: DataFrame, key: str, text: str, known: DataFrame, name: str) -> DataFrame:
    """AGG-23: (key, checked, valid, rate, unknown): references in a text that are known symbols; the rate is 1 where there is none."""
    from weftline.functions.text import code_references

    refs = content.select(key, F.explode(code_references(text)).alias("_r"))
    k = known.select(F.lower(name).alias("_k")).distinct().withColumn("_ok", F.lit(True))
    g = refs.join(k, F.lower("_r") == F.col("_k"), "left").groupBy(key).agg(F.count("*").alias("checked"), F.count_if(F.col("_ok")).alias("valid"), F.array_sort(F.collect_set(F.when(F.col("_ok").isNull(), F.col("_r")))).alias("unknown"))
    out = content.select(key).join(g, key, "left")
    n = F.coalesce("checked", F.lit(0))
    return out.select(key, n.alias("checked"), F.coalesce("valid", F.lit(0)).alias("valid"), F.when(n > 0, F.col("valid") / n).otherwise(1.0).alias("rate"), F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))


def hierarchy(symbol_rows: DataFrame) -> DataFrame:
    """JN-10: (file_path, type, methods): methods under the type that they name as parent, in order of their lines."""
    types = symbol_rows.where("kind = 'class'").select("file_path", F.col("name").alias("type"))
    methods = symbol_rows.where("kind = 'function'").groupBy("file_path", F.col("parent").alias("type")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("methods"))
    return types.join(methods, ["file_path", "type"], "left")
